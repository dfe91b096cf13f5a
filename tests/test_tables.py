"""Filters, documents, conversations and scaling helpers against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from atlasloom.operators import chat, docs, filters, scale


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def paths(spark, *names):
    return spark.createDataFrame([("r", n) for n in names], "repo_id string, file_path string")


def test_exclusion_is_literal(spark):
    df = paths(
        spark, "src/a.py", "node_modules/x.js", "lib/docs/b.md", "yarn.lock", "x.min.js", "a/.git/c.md", "venv", "git/a.py"
    )
    kept = {r.file_path for r in filters.filter_paths(df).collect()}
    assert kept == {"src/a.py", "x.min.js", "a/.git/c.md"}
    assert {r.file_path for r in filters.filter_paths(df, glob=True).collect()} == {"src/a.py", "a/.git/c.md"}


def test_inclusion_ignores_exclusions(spark):
    df = paths(spark, "src/a.py", "node_modules/x.js", "docs/b.md", "c.min.js")
    pick = lambda **k: {r.file_path for r in filters.filter_paths(df, mode="include", **k).collect()}
    assert pick(dirs=["./node_modules/"]) == {"node_modules/x.js"}
    assert pick(names=[".min.js", "a.py"]) == {"src/a.py", "c.min.js"}
    assert pick(dirs=["docs"], names=["a.py"]) == {"docs/b.md", "src/a.py"}
    assert len(pick()) == 4


def test_rules_per_repository(spark):
    files = spark.createDataFrame(
        [(r, p) for r in "abc" for p in ("src/a.py", "docs/b.md", "c.js")], "repo_id string, file_path string"
    )
    rules = spark.createDataFrame(
        [("a", "excluded_dir", "./docs/"), ("a", "excluded_file", "c.js"), ("b", "included_file", ".md"),
         ("b", "excluded_dir", "docs")], "repo_id string, kind string, pattern string",
    )
    got = rows(filters.filter_paths_by_rules(files, filters.union_rules(rules, rules)), "repo_id", "file_path")
    assert got == [("a", "src/a.py"), ("b", "docs/b.md"), ("c", "c.js"), ("c", "docs/b.md"), ("c", "src/a.py")]


def test_rules_looked_up_equal_rules_folded(spark):
    r = random.Random(3)
    part = lambda: r.choice(["a", "b", "src", "x.py", "y.md", ".py", "md", "node", ""])
    files = spark.createDataFrame(
        [(f"r{r.randrange(9)}", i, "/".join(part() or "z" for _ in range(r.randint(1, 4)))) for i in range(600)], "repo_id string, doc_ord int, file_path string"
    )
    kinds = ["excluded_dir", "excluded_file", "included_dir", "included_file"]
    rules = spark.createDataFrame(
        [(f"r{i}", r.choice(kinds[: 2 if i % 2 else 4]), r.choice(["./{}/", "{}"]).format(part())) for i in range(8) for _ in range(4)], "repo_id string, kind string, pattern string"
    )
    folded = sorted(map(tuple, filters.filter_paths_by_rules(files, rules).collect()))
    looked_up = sorted(map(tuple, filters.filter_paths_by_rules(files, rules, max_rows=0).collect()))
    assert looked_up == folded and 0 < len(folded) < 600


def test_default_rules_equal_the_default_filter(spark):
    files = paths(spark, "src/a.py", "node_modules/x.js", "yarn.lock", "x.min.js")
    by_rules = filters.filter_paths_by_rules(files, filters.default_rules(files.select("repo_id").distinct()))
    assert rows(by_rules, "file_path") == rows(filters.filter_paths(files), "file_path")


def test_languages(spark):
    df = spark.createDataFrame([("fr",), ("xx",), (None,)], "language string")
    got = filters.resolve_language(df).collect()
    assert [(r.language, r.language_name) for r in got] == [("fr", "Français (French)"), ("en", "English"), ("en", "English")]
    assert [r.error for r in filters.check_language(df).collect()] == [None, "Language is not supported", "Language is not supported"]


def test_doc_columns_and_size_guard(spark):
    names = ["a.py", "test_a.py", "app_a.py", "src/latest.py", "src/app_x.py", "doc/test.md", "x.lock", "Makefile", "a.min.js"]
    df = paths(spark, *names).withColumn("text", F.lit("x" * 40_000)).withColumn("doc_ord", F.lit(0))
    got = docs.derive_doc_columns(df)
    assert {(r.file_path, r.type, r.is_code, r.is_implementation, r.token_count) for r in got.collect()} == {
        ("a.py", "py", True, True, 10_000), ("test_a.py", "py", True, False, 10_000),
        ("app_a.py", "py", True, False, 10_000), ("src/latest.py", "py", True, False, 10_000),
        ("src/app_x.py", "py", True, True, 10_000), ("doc/test.md", "md", False, False, 10_000),
        ("a.min.js", "js", True, True, 10_000),
    }
    assert "doc/test.md" not in {r.file_path for r in docs.drop_oversized(got).collect()}
    assert docs.drop_oversized(got).count() == 6


def hot_rows(n=900):
    """A third of the rows under one key."""
    rng = random.Random(3)
    keys = ["hot" if i % 3 == 0 else f"k{rng.randrange(40)}" for i in range(n)]
    seen, out = {}, []
    for k in keys:
        seen[k] = seen.get(k, -1) + 1
        out.append((k, seen[k], f"{k}:{seen[k]};"))
    rng.shuffle(out)
    return out


def test_ordered_text_splits_hot_keys_without_loss(spark):
    data = hot_rows()
    df = spark.createDataFrame(data, "k string, pos int, t string")
    want = {}
    for k, pos, t in sorted(data):
        want.setdefault(k, []).append(t)
    for size, shift in ((7, 0), (10_000, 0), (7, 1_000_000)):
        rows = scale.ordered_text(df.withColumn("pos", F.col("pos") + shift), ["k"], "pos", "t", "text", "|", span=size).collect()
        assert len(rows) == len(want)
        assert {r.k: r.text for r in rows} == {k: "|".join(v) for k, v in want.items()}


def test_positions(spark):
    data = [(k, pos * 7 + 3, t) for k, pos, t in hot_rows()]
    df = spark.createDataFrame(data, "k string, pos int, t string")
    want = {}
    for k, pos, _ in sorted(data):
        want.setdefault(k, []).append(pos)
    want = sorted((k, p, i) for k, ps in want.items() for i, p in enumerate(ps))
    assert rows(scale.dense_index(df, ["k"], ["pos"], "i", span=50), "k", "pos", "i") == want
    assert rows(scale.sorted_index(df, ["k"], ["pos"], "i"), "k", "pos", "i") == want
    batches = docs.assign_batches(df.withColumnsRenamed({"pos": "doc_ord"}).withColumn("chunk_no", F.lit(0)), 10, ["k"])
    assert rows(batches, "k", "doc_ord", "batch_no") == [(k, p, i // 10) for k, p, i in want]


def test_latest_wins(spark):
    data = [(k, pos, t) for k, pos, t in hot_rows()]
    df = spark.createDataFrame(data, "k string, v int, t string")
    best = {}
    for k, v, t in data:
        best[k] = max(best.get(k, (-1, "")), (v, t))
    assert rows(scale.latest_wins(df, ["k"], "v"), "k", "v", "t") == sorted((k, *b) for k, b in best.items())


def conversations(spark, n=60):
    rng = random.Random(5)
    data = []
    for c in range(n):
        for turn in range(300 if c == 0 else rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system"])
            text = rng.choice(["hi", "[DEEP RESEARCH] topic ", "continue the Research", "what", "[DEEP RESEARCH] continue research", ""])
            data.append((f"c{c}", turn, role, f"{text}{rng.randrange(9)}" if text else ""))
    by = {}
    for c, turn, role, text in data:
        by.setdefault(c, []).append((role, text))
    rng.shuffle(data)
    return spark.createDataFrame(data, "conv_id string, turn int, role string, content string"), by


def test_pairs_and_history(spark):
    df, by = conversations(spark)
    strict, adjacent, history = [], [], {}
    for c, m in by.items():
        for i in range(len(m) - 1):
            if m[i][0] == "user" and m[i + 1][0] == "assistant":
                adjacent.append((c, i, m[i][1], m[i + 1][1]))
                if i % 2 == 0:
                    strict.append(adjacent[-1])
                    history[c] = history.get(c, "") + (
                        f"<turn>\n<user>{m[i][1]}</user>\n<assistant>{m[i + 1][1]}</assistant>\n</turn>\n"
                    )
    cols = ("conv_id", "turn_no", "user_text", "assistant_text")
    turns = chat.pair_turns(df)
    assert rows(turns, *cols) == sorted(strict)
    assert rows(chat.pair_turns(df, "adjacent"), *cols) == sorted(adjacent)
    assert set(strict) <= set(adjacent)
    assert {r.conv_id: r.history for r in chat.fold_history(turns).collect()} == history


def test_research_state(spark):
    tag = "[DEEP RESEARCH]"
    df, by = conversations(spark)
    want = {}
    for c, m in by.items():
        deep = any(tag in t for _, t in m)
        n = sum(r == "assistant" for r, _ in m) + 1 if deep else 1
        last = m[-1][1].replace(tag, "").strip() if tag in m[-1][1] else m[-1][1]
        topic = None
        if deep and "continue" in last.lower() and "research" in last.lower():
            topic = next((t.replace(tag, "").strip() for r, t in m if r == "user" and "continue" not in t.lower()), None) or None
        phase = "answer" if not deep else "first" if n == 1 else "final" if n >= 5 else "intermediate"
        want[c] = (m[-1][0], deep, n, phase, topic, topic or last)
    got = {r.conv_id: tuple(r)[1:7] for r in chat.conversation_state(df).collect()}
    assert got == want
    seen = {r.conv_id: (r.is_research, r.last_content) for r in chat.detect_research(df).collect()}
    assert seen == {
        c: (w[1], by[c][-1][1].replace(tag, "").strip() if tag in by[c][-1][1] else by[c][-1][1]) for c, w in want.items()
    }


def test_validation(spark):
    df = spark.createDataFrame(
        [("a", 0, "user", "x"), ("b", 0, "user", "x"), ("b", 1, "assistant", "y"), ("c", 0, "user", "z" * 32_004),
         ("d", 0, "user", "z" * 32_003)],
        "conv_id string, turn int, role string, content string",
    )
    requests = spark.createDataFrame([("a",), ("e",)], "conv_id string").unionByName(df.select("conv_id"))
    got = {r.conv_id: (r.error, r.too_large) for r in filters.validate_requests(df, requests).collect()}
    assert got == {
        "a": (None, False), "b": ("Error: Last message must be from the user", False), "c": (None, True),
        "d": (None, False), "e": ("Error: No messages provided", False),
    }


def test_focus_file(spark):
    req = spark.createDataFrame(
        [("1", "r", "a.py", "q1"), ("2", "r", None, "q2"), ("3", "r", "gone.py", "q3"), ("4", "r", "", "q4")],
        "conv_id string, repo_id string, file_path string, query string",
    )
    texts = spark.createDataFrame([("r", "a.py", "A"), ("s", "a.py", "B")], "repo_id string, file_path string, text string")
    got = rows(chat.focus_file(req, texts), "conv_id", "rag_query", "file_content")
    assert got == [
        ("1", "Contexts related to a.py", "A"), ("2", "q2", None), ("3", "Contexts related to gone.py", None), ("4", "q4", None),
    ]


def test_stages(spark):
    df = spark.createDataFrame(
        [("c", 1, "plan", "t", "x", 0), ("c", 2, "update", "t", "y", 1), ("c", 1, "plan", "t", "z", 2)],
        "conv_id string, iteration int, type string, title string, content string, seq int",
    )
    got = rows(chat.upsert_stages(df), "seq", "type", "content")
    assert got == [(0, "plan", "z"), (1, "update", "y")]


def test_classify_responses(spark):
    from atlasloom.plans.chat import classify_responses

    texts = ["## Research Plan\n", "## Research Update 2\n", "none", "## Research Update 4", "still open"]
    data = [("c", 2 * i, "user", "q") for i in range(5)] + [("c", 2 * i + 1, "assistant", t) for i, t in enumerate(texts)]
    data += [("d", 0, "user", "q"), ("d", 1, "assistant", "In conclusion, yes")]
    df = spark.createDataFrame(data, "conv_id string, turn int, role string, content string")
    stages, done = classify_responses(df)
    assert rows(stages, "conv_id", "iteration", "type") == [("c", 1, "plan"), ("c", 2, "update"), ("c", 4, "update")]
    assert rows(done, "conv_id", "iterations", "complete", "forced") == [("c", 5, True, True), ("d", 1, True, False)]


def test_even_slices_with_one_order_value_on_half_of_the_rows(spark):
    df = spark.range(40_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 7 ELSE id END AS ord", "CAST(NULL AS STRING) AS note")
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(key, value)
    try:
        placed = scale.sorted_index(df, [], ["ord"], "pos").withColumn("task", F.spark_partition_id()).checkpoint()
        slices = df.repartitionByRange("ord", F.xxhash64("id", "ord", "note")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert max(r["count"] for r in slices) <= 2 * 40_000 / 16
    rows = sorted((r.pos, r.ord) for r in placed.collect())
    assert [p for p, _ in rows] == list(range(40_000)) and [o for _, o in rows] == sorted(o for _, o in rows)


@pytest.mark.parametrize("span", [1, 7, 10_000])
def test_running_total(spark, span):
    rows = [(k, i, (i * 7) % 5) for k, n in (("a", 50), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    got = {(r.k, r.pos): r.before for r in scale.running_total(df, ["k"], "pos", "v", "before", span).collect()}
    assert got == {(k, p): sum(v for q, i, v in rows if q == k and i < p) for k, p, _ in rows}


def test_ordered_md5(spark):
    """The digest is that of the joined texts in order, also across the batches of a task and for keys with nulls."""
    rng = random.Random(11)
    data = [(rng.choice(["a", "b", None]), i % 2, rng.randrange(-50, 50) * 1000 + i, rng.choice(["", "é\n", None, "x" * 50])) for i in range(3000)] + [("c", 0, 0, None)]
    df = spark.createDataFrame(data, "k string, l int, pos long, t string").repartition(4)
    want = {}
    for k, l, _, t in sorted((r for r in data if r[3] is not None), key=lambda r: r[2:]):
        want.setdefault((k, l), []).append(t)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = scale.ordered_md5(df, ["k", "l"], "pos", "t", "md5", "|").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.k, r.l): (r.n, r.md5) for r in got} == {k: (len(t), hashlib.md5("|".join(t).encode()).hexdigest()) for k, t in want.items()}
    assert len(got) == len(want) and scale.ordered_md5(df.limit(0), ["k"], "pos", "t", "md5").count() == 0
