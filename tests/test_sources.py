"""Files, stored tables and streams."""

import base64
import json
import os
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from atlasloom.constants import EXCLUDED_DIRS, EXCLUDED_FILES
from atlasloom.plans.chat import assemble_requests, prepare_requests
from atlasloom.plans.corpus import build_chunks, index_corpus, repo_dimension
from atlasloom.session import BATCH_BYTES
from atlasloom.sources import corpus, index_store, wiki_cache
from atlasloom.streaming import sse


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("repos")
    files = {
        "one/src/a.py": b"x = 1\r\ny = 2\rz\n", "one/src/__init__.py": b"", "one/README.md": b"# One", "one/docs/readme.MD": b"deep",
        "one/.git/c.py": b"no", "one/bad.py": b"\xff\xfe\x00", "one/_site/p.md": b"p", "one/sp ace/d+e%20.md": "é".encode(),
        "one/node_modules/m.js": b"m", "one/a.bin": b"bin", "one/.hidden.md": b"h", "two/b/c/d/e/f.ts": b"deep file", "two/x.yml": b"k: v",
    }
    for name, content in files.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(base)


def test_scan(spark, root):
    got = {(r.repo_id, r.file_path): (r.doc_ord, r.text) for r in corpus.scan_corpus(spark, root).collect()}
    assert {k: v[1] for k, v in got.items()} == {
        ("one", "src/a.py"): "x = 1\ny = 2\nz\n", ("one", "src/__init__.py"): "", ("one", "README.md"): "# One",
        ("one", "_site/p.md"): "p", ("one", "sp ace/d+e%20.md"): "é", ("one", "node_modules/m.js"): "m",
        ("two", "b/c/d/e/f.ts"): "deep file", ("two", "x.yml"): "k: v",
    }
    order = [k[1] for k, _ in sorted(got.items(), key=lambda x: x[1][0]) if k[0] == "one"]
    assert order[-1].endswith(".md") and order[0].endswith(".py")
    single = corpus.scan_corpus(spark, os.path.join(root, "two"), repo_id="solo")
    assert {(r.repo_id, r.file_path) for r in single.collect()} == {("solo", "b/c/d/e/f.ts"), ("solo", "x.yml")}


def test_files_are_read_a_few_at_a_time(spark, root, tmp_path):
    sizes = [1000, 3_000_000, 3_000_000, 9_000_000, 10, 10, 2_000_000]
    for i, n in enumerate(sizes):
        (tmp_path / f"{i}.py").write_bytes(b"x" * n)
    paths = pd.DataFrame({"path": [str(tmp_path / f"{i}.py") for i in range(len(sizes))]})
    found = [[len(c) for c in frame["content"]] for frame in corpus._read_bytes(iter([paths]))]
    assert sum(found, []) == sizes and all(sum(f) <= BATCH_BYTES or len(f) == 1 for f in found)
    own = spark.newSession()
    assert corpus.scan_corpus(own, root).count() == 8
    assert int(own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES


def test_built_in_scan_sees_the_same_except_underscores(spark, root):
    mine = {(r.repo_id, r.file_path) for r in corpus.scan_corpus(spark, root).collect()}
    other = {(r.repo_id, r.file_path) for r in corpus.scan_corpus(spark, root, engine="binaryFile").collect()}
    assert other == {p for p in mine if "/_" not in "/" + p[1]}


def test_trees_and_readme(spark, root):
    listing = corpus._with_repo(corpus.list_files(spark, root), root, None)
    tree = {r.repo_id: r.file_tree for r in corpus.file_tree(listing).collect()}
    assert tree["two"] == "b/c/d/e/f.ts\nx.yml"
    assert tree["one"].split("\n") == sorted(
        ["README.md", "_site/p.md", "a.bin", "bad.py", "docs/readme.MD", "sp ace/d+e%20.md", "src/a.py"]
    )
    readme = {r.repo_id: r.readme for r in corpus.pick_readme(corpus.scan_corpus(spark, root, doc_ext=(".md", ".MD", ".yml"))).collect()}
    assert readme == {"one": "# One", "two": ""}


def test_listings(spark):
    pages = [
        ("r", 2, json.dumps([{"type": "blob", "path": "z"}])), ("r", 1, json.dumps([{"type": "blob", "path": "a"}, {"type": "tree", "path": "d"}, {"type": "blob", "path": "c"}])),
        ("t", 1, json.dumps({"tree": [{"type": "blob", "path": "x"}]})), ("v", 1, json.dumps({"values": [{"type": "commit_file", "path": "y"}]})),
    ]
    df = spark.createDataFrame(pages, "repo_id string, page_no int, payload string")
    assert {r.repo_id: r.file_tree for r in corpus.tree_from_listing(df).collect()} == {"r": "a\nc\nz", "t": "x", "v": "y"}


def test_payloads(spark):
    text = base64.encodebytes("héllo wörld".encode() * 9).decode()
    cases = [
        json.dumps({"content": text, "encoding": "base64"}), json.dumps({"message": "Not Found", "documentation_url": "u"}),
        json.dumps({"content": "x", "encoding": "none"}), json.dumps({"size": 1}), "<html>", json.dumps({"content": base64.b64encode(b"\xff\xfe").decode(), "encoding": "base64"}),
    ]
    got = [(r.text, r.error) for r in corpus.decode_contents(spark.createDataFrame([(c,) for c in cases], "payload string")).collect()]
    assert got[0] == ("héllo wörld" * 9, None)
    assert [e.split(": ", 1)[1] for _, e in got[1:5]] == [
        "GitHub API error: Not Found", "Unexpected encoding: none", "File content not found in GitHub API response", "Invalid response from GitHub API",
    ]
    assert got[5][0] is None and got[5][1]
    raw = ['{"message": "denied"}', '{"message": broken', "plain", '{"a": {"message": 1}}']
    got = [(r.text, r.error) for r in corpus.detect_error_payload(spark.createDataFrame([(c,) for c in raw], "content string")).collect()]
    assert got[0][0] is None and got[0][1].endswith("API error: denied")
    assert [g[0] for g in got[1:]] == raw[1:]


def test_index_is_reused_and_rebuilt(spark, root, tmp_path):
    path = str(tmp_path / "index")
    options = {"size": 5, "overlap": 1, "dim": 8}
    first = index_corpus(spark, root, path, dirs=["./node_modules/"], names=[], **options)
    names = {r.file_path for r in first.select("file_path").distinct().collect()}
    assert "node_modules/m.js" not in names and "src/a.py" in names
    calls = []

    def build(docs):
        calls.append({r.repo_id for r in docs.select("repo_id").distinct().collect()})
        return build_chunks(docs, **options)

    docs = corpus.scan_corpus(spark, root)
    config = {"dirs": [*EXCLUDED_DIRS, "./node_modules/"], "names": list(EXCLUDED_FILES), "mode": "exclude", **options}
    index_store.load_or_build_index(spark, path, docs, build, config)
    assert calls == []
    # files without a word give no usable vector: such a repository is built again, its neighbours stay
    stored = index_store.read_index(spark, path)
    broken = stored.withColumn("vector", F.when(F.col("repo_id") == "one", F.col("vector")).otherwise(F.array().cast("array<float>")))
    index_store.write_index(broken.drop("dim", "config_hash").checkpoint(), path, config)
    again = index_store.load_or_build_index(spark, path, docs, build, config)
    assert calls == [{"two"}]
    assert again.filter("dim = 0").isEmpty() and {r.repo_id for r in again.select("repo_id").distinct().collect()} == {"one", "two"}
    index_store.load_or_build_index(spark, path, docs.filter("repo_id = 'one'"), build, {"other": 1})
    assert calls[-1] == {"one"}
    index_store.load_or_build_index(spark, path, docs, build, {"other": 1})
    assert calls[-1] == {"two"}
    index_store.compact_index(spark, path, path + "2")
    key = lambda df: sorted((r.repo_id, r.file_path, r.chunk_no, r.text, r.config_hash) for r in df.collect())
    assert key(index_store.read_index(spark, path)) == key(index_store.read_index(spark, path + "2"))


def test_repositories_without_chunks_are_built_once(spark, tmp_path):
    calls = []

    def build(docs):
        calls.append({r.repo_id for r in docs.select("repo_id").distinct().collect()})
        return build_chunks(docs.filter("repo_id <> 'none'"), dim=8)

    docs = spark.createDataFrame([("some", 0, "a.py", "x y"), ("none", 0, "b.py", "z")], "repo_id string, doc_ord long, file_path string, text string")
    for _ in range(2):
        rows = index_store.load_or_build_index(spark, str(tmp_path / "i"), docs, build)
        assert [r.repo_id for r in rows.collect()] == ["some"]
    assert calls == [{"some", "none"}]


KEYS = "repo_type string, owner string, repo string, language string"


def test_wiki_cache(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, f"{KEYS}, payload string, updated_at int")
    path = str(tmp_path / "cache")
    wiki_cache.write_wiki_cache(spark, path, rows(("github", "o", "a", "en", "1", 1), ("github", "o", "b", "xx", "2", 1)))
    wiki_cache.write_wiki_cache(spark, path, rows(("github", "o", "a", "en", "3", 2)))
    wiki_cache.write_wiki_cache(spark, path, rows(("github", "o", "a", "en", "3", 2)))
    stored = wiki_cache.read_wiki_cache(spark, path)
    assert {(r.repo, r.language, r.payload) for r in stored.collect()} == {("a", "en", "3"), ("b", "en", "2")}
    keys = spark.createDataFrame([("github", "o", "b", "zz"), ("github", "o", "c", "en")], KEYS)
    assert {(r.repo, r.payload) for r in wiki_cache.read_wiki(stored, keys).collect()} == {("b", "2"), ("c", None)}
    asked = spark.createDataFrame([("github", "o", "a", "en"), ("github", "o", "b", "zz"), ("github", "o", "c", "fr")], KEYS)
    left, status = wiki_cache.delete_wiki(stored, asked)
    assert [r.repo for r in left.collect()] == ["b"]
    assert {r.repo: (r.status, r.deleted) for r in status.collect()} == {
        "a": ("Wiki cache for o/a (en) deleted successfully", True), "b": ("Language is not supported", False), "c": ("Wiki cache not found", False),
    }
    assert {(r.repo, r.deleted) for r in wiki_cache.delete_stored_wikis(spark, path, asked).collect()} == {("a", True), ("b", False), ("c", False)}
    assert [r.repo for r in wiki_cache.read_wiki_cache(spark, path).collect()] == ["b"]
    wiki_cache.compact_rows(spark, path, path + "2", wiki_cache.KEY, "updated_at")
    assert [r.repo for r in wiki_cache.read_wiki_cache(spark, path + "2").collect()] == ["b"]


def test_project_files_and_running_catalogue(spark, tmp_path):
    folder, target = tmp_path / "wikis", str(tmp_path / "catalogue")
    folder.mkdir()
    for name in ("wiki_cache_github_o_r_en.json", "wiki_cache_gitlab_o_a_b_fr.json", "note.json", "wiki_cache_x_en.json"):
        (folder / name).write_text("{}")
    got = wiki_cache.list_projects(spark, str(folder))
    assert {(r.name, r.language) for r in got.collect()} == {("o/r", "en"), ("o/a_b", "fr")}
    for _ in range(2):
        sse.stream_catalogue(spark, str(folder), target, str(tmp_path / "ck")).awaitTermination(120)
        (folder / "wiki_cache_github_o_new_en.json").write_text("{}")
    assert {r.name for r in sse.read_catalogue(spark, target).collect()} == {"o/r", "o/a_b", "o/new"}
    (folder / "wiki_cache_gitlab_o_a_b_fr.json").unlink()
    (folder / "wiki_cache_github_o_more_en.json").write_text("{}")
    sse.stream_catalogue(spark, str(folder), target, str(tmp_path / "ck")).awaitTermination(120)  # its batch notices the deletion
    names = lambda path: {r.name for r in sse.read_catalogue(spark, path).collect()}
    assert names(target) == {"o/r", "o/new", "o/more"}
    (folder / "wiki_cache_github_o_r_en.json").unlink()
    sse.sync_catalogue(spark, str(folder), target)
    assert names(target) == {"o/new", "o/more"}
    back = folder / "wiki_cache_gitlab_o_a_b_fr.json"
    back.write_text("{}")
    os.utime(back, (1_000_000, 1_000_000))  # back, and older than it was
    sse.sync_catalogue(spark, str(folder), target)
    assert names(target) == {"o/new", "o/more", "o/a_b"}
    rows = spark.read.parquet(target).count()
    sse.sync_catalogue(spark, str(folder), target)
    assert spark.read.parquet(target).count() == rows  # nothing has changed, nothing is written
    sse.compact_catalogue(spark, target, str(tmp_path / "compacted"))
    assert names(str(tmp_path / "compacted")) == names(target) and spark.read.parquet(str(tmp_path / "compacted")).count() == 3
    sse.sync_catalogue(spark, str(folder), str(tmp_path / "fresh"))
    assert names(str(tmp_path / "fresh")) == names(target)


def test_the_catalogue_stream_keeps_no_names(spark, tmp_path):
    """Neither its checkpoint nor a listing plan in the driver holds the files of the folder."""
    (tmp_path / "wikis").mkdir()
    (tmp_path / "wikis" / "wiki_cache_github_o_some+thing_en.json").write_text("{}")
    sse.stream_catalogue(spark, str(tmp_path / "wikis"), str(tmp_path / "catalogue"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r.repo for r in sse.read_catalogue(spark, str(tmp_path / "catalogue")).collect()] == ["some+thing"]
    assert not any("some+thing" in f.read_text(errors="replace") for f in (tmp_path / "ck").rglob("*") if f.is_file())
    assert wiki_cache.stored_names(spark, "file:" + str(tmp_path / "wikis")).inputFiles() == []


def stored_page(i, content=""):
    return {"id": f"p{i}", "title": f"T{i}", "content": content, "filePaths": [f"f{i}.py"], "importance": "high", "relatedPages": ["p1"]}


def test_stored_wiki_files_as_tables(spark, tmp_path):
    whole = {
        "wiki_structure": {
            "id": "w", "title": "Wiki é", "description": "D", "pages": [stored_page(2), stored_page(1)],
            "sections": [{"id": "s1", "title": "S", "pages": ["p1"], "subsections": ["s2"]}, {"id": "s2", "title": "S2", "pages": []}], "rootSections": ["s1"],
        },
        "generated_pages": {"p1": stored_page(1, "text one"), "p9": stored_page(9, "kept")},
        "repo": {"owner": "o", "repo": "r", "type": "github", "repoUrl": "https://github.com/o/r"}, "provider": "google", "model": "m",
    }
    old = {"wiki_structure": {"id": "w", "title": "Old", "description": "", "pages": []}, "generated_pages": {}, "repo_url": "https://old"}
    for name, text in {"github_o_r_en": json.dumps(whole, indent=2), "github_o_a+b_en": json.dumps(old), "github_o_cut_en": json.dumps(whole)[:300], "github_o_list_en": "[1, 2]", "short": "{}"}.items():
        (tmp_path / f"wiki_cache_{name}.json").write_text(text)
    got = wiki_cache.read_wiki_files(spark, str(tmp_path))
    projects = {r.repo: r for r in got["projects"].collect()}
    assert set(projects) == {"r", "a+b", "cut", "list"} and {k for k, r in projects.items() if r.malformed is not None} == {"cut", "list"}
    assert projects["cut"].malformed == json.dumps(whole)[:300]
    assert (projects["r"].title, projects["r"].repo_url, projects["a+b"].repo_url) == ("Wiki é", "https://github.com/o/r", "https://old")
    assert {r.id for r in wiki_cache.list_projects(spark, str(tmp_path)).collect()} == {r.id for r in projects.values()}
    pages = sorted((r.page_ord, r.page_id, r.content, r.generated, r.file_paths) for r in got["pages"].collect())
    assert pages == [(0, "p2", "", False, ["f2.py"]), (1, "p1", "text one", True, ["f1.py"]), (2, "p9", "kept", True, ["f9.py"])]
    sections = sorted((r.sec_ord, r.section_id, r.subsections, r.is_root) for r in got["sections"].collect())
    assert sections == [(0, "s1", ["s2"], True), (1, "s2", [], False)]


def test_stored_pages_under_odd_names(spark, tmp_path):
    """Repeated and missing ids, keys that differ from ids, and pages that only the generated part has, in order."""
    pages = [{"id": "a", "title": "A"}, {"id": "a", "title": "A2", "content": "own"}, {"title": "no id"}]
    made = '"a": {"id": "a", "content": "first"}, "a": {"id": "a", "content": "second"}, "k": {"id": "x", "content": "by id"}, "z": {"id": "y", "content": "Z"}, "y": {"id": "q", "content": "Y"}, "n": {"content": "N"}'
    text = '{"wiki_structure": {"pages": ' + json.dumps(pages) + '}, "generated_pages": {' + made + "}}"
    (tmp_path / "wiki_cache_github_o_r_en.json").write_text(text)
    got = sorted((r.page_ord, r.page_id, r.content, r.generated) for r in wiki_cache.read_wiki_files(spark, str(tmp_path))["pages"].collect())
    assert got == [(0, "a", "first", True), (1, "a", "first", True), (2, None, "", False), (3, "q", "Y", False), (4, "x", "by id", False), (5, "y", "Y", True)]


def test_a_document_is_not_copied_for_its_pages(spark, tmp_path):
    (tmp_path / "wiki_cache_github_o_r_en.json").write_text(json.dumps({"wiki_structure": {"pages": []}, "generated_pages": {}}))
    plan = wiki_cache.read_wiki_files(spark, str(tmp_path))["pages"]._jdf.queryExecution().sparkPlan().toString()
    plan = re.sub(r"#\d+L?", "", plan)
    beside = re.findall(r"\[([^\[\]]*)\], false, \[n_listed", plan)  # what the rows of a document carry along
    assert beside and not any(c in x for x in beside for c in ("value", "wiki_structure", "generated_pages"))


def test_files_that_a_read_of_few_repositories_opens(spark, tmp_path):
    path = str(tmp_path / "index")
    for build in range(4):
        rows = [(f"r{build}{i}", i, f"f{i}", 0, f"r{build}{i}#{j}", [1.0]) for i in range(5) for j in range(20)]
        chunks = spark.createDataFrame(rows, "repo_id string, doc_ord long, file_path string, chunk_no int, chunk_id string, vector array<float>")
        index_store.write_index(chunks.repartition(5, "repo_id"), path)
    whole = index_store.read_index(spark, path)
    assert whole.count() == 400
    asked = spark.createDataFrame([("r11",), ("r30",), ("unknown",)], "repo_id string")
    some = index_store.read_index(spark, path, asked)
    assert len(some.inputFiles()) == 2 < len(whole.inputFiles()) and some.columns == whole.columns
    key = lambda df: sorted((r.repo_id, r.chunk_id) for r in df.collect())
    assert key(some) == [k for k in key(whole) if k[0] in ("r11", "r30")]
    assert index_store.read_index(spark, path, asked.filter("repo_id = 'unknown'")).collect() == []
    index_store.compact_index(spark, path, path + "2")
    assert key(index_store.read_index(spark, path + "2", asked)) == key(some)


def sse_lines(n=30, seed=1):
    rng, rows, want = random.Random(seed), [], {}
    for q in range(n):
        seq, text, head = 0, "", ["", "", 0]
        for i in range(60 if q == 0 else rng.randrange(1, 8)):
            kind = rng.randrange(7)
            if kind == 0:
                line = rng.choice(["", ": ping", "event: x", "data: {broken", 'data: {"choices": []}'])
            elif kind == 1:
                line = "data: " + json.dumps({"choices": [{"text": f"t{i}"}]})
                text += f"t{i}"
            else:
                event = {"id": f"id{q}", "model": f"m{i}", "created": i, "choices": [{"delta": {"content": rng.choice([f"w{i} ", "", None])}}]}
                text += event["choices"][0]["delta"]["content"] or ""
                head = [event["id"], event["model"], event["created"] or head[2]]
                line = "  data: " + json.dumps(event)
            rows.append((f"q{q}", seq, line))
            seq += 1
        if q % 5:
            rows.append((f"q{q}", seq, "data: [DONE]"))
            rows.append((f"q{q}", seq + 1, "data: " + json.dumps({"choices": [{"delta": {"content": "late"}}]})))
        want[f"q{q}"] = (text, *head)
    return rows, want


def test_accumulated_responses(spark):
    rows, want = sse_lines()
    df = spark.createDataFrame(rows, "req_id string, seq bigint, line string").orderBy(F.rand(3))
    events = sse.parse_sse(df)
    parts = {r.req_id: (r.response, r.id, r.model, r.created) for r in sse.accumulate(events, span=5).collect()}
    got = {r.req_id: (r.response, r.id, r.model, r.created) for r in sse.accumulate(events).collect()}
    assert parts == got
    assert got == {k: v for k, v in want.items() if k in got}
    assert set(want) - set(got) <= {k for k, v in want.items() if v[0] == "" and v[1] == ""}


def test_stream_equals_batch(spark, tmp_path):
    rows, want = sse_lines(12)
    folder = tmp_path / "in"
    folder.mkdir()
    order = list(rows)
    random.Random(4).shuffle(order)
    for i in range(3):
        with open(folder / f"{i}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("req_id", "seq", "line"), r))) + "\n" for r in order[i::3])
    lines = spark.readStream.schema("req_id string, seq bigint, line string").option("maxFilesPerTrigger", 1).json(str(folder))
    query = (
        sse.accumulate_stream(lines, idle_ms=None, flush_chars=50).writeStream.format("memory").queryName("responses").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    whole = sse.whole_responses(spark.table("responses")).filter("complete").collect()
    done = {r.req_id: (r.response, r.id, r.model, r.created) for r in whole}
    assert done == {k: v for k, v in want.items() if int(k[1:]) % 5}


def test_requests_without_an_event_have_no_response(spark, tmp_path):
    """Streams and tables agree on requests that end at once; an event with an empty text is an event."""
    event, end = "data: " + json.dumps({"choices": [{"text": ""}]}), "data: [DONE]"
    rows = [("none", 0, end), ("none", 1, event), ("skipped", 0, ": ping"), ("skipped", 1, "data: {broken"), ("skipped", 2, end), ("empty", 0, event), ("empty", 1, end)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.json").write_text("".join(json.dumps(dict(zip(("req_id", "seq", "line"), r))) + "\n" for r in rows))
    schema = "req_id string, seq bigint, line string"
    query = (
        sse.accumulate_stream(spark.readStream.schema(schema).json(str(folder)), idle_ms=None).writeStream.format("memory").queryName("events_none")
        .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    found = {r.req_id for r in sse.whole_responses(spark.table("events_none")).filter("complete").collect()}
    assert found == {r.req_id for r in sse.accumulate(sse.parse_sse(spark.createDataFrame(rows, schema))).collect()} == {"empty"}


def test_silent_requests_are_released(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = "data: " + json.dumps({"choices": [{"text": "half"}]})
    # the second line waits behind a gap
    (folder / "0.json").write_text("".join(json.dumps({"req_id": "q", "seq": seq, "line": line}) + "\n" for seq in (0, 2)))
    lines = spark.readStream.schema("req_id string, seq bigint, line string").json(str(folder))
    query = (
        sse.accumulate_stream(lines, idle_ms=1).writeStream.format("memory").queryName("silent").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    )
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if spark.table("silent").count():
                break
        assert [(r.response, r.complete) for r in spark.table("silent").collect()] == [("halfhalf", False)]
    finally:
        query.stop()


def test_repo_table(spark):
    df = spark.createDataFrame(
        [("https://github.com/o/r",), ("github.com/o/r.git",), ("https://gitlab.com/g/s/p/",), ("/home/x/proj",), ("bad",)], "input string"
    )
    got = {(r.type, r.owner, r.repo, r.repo_id) for r in repo_dimension(df).collect()}
    assert {g[:3] for g in got} == {("github", "o", "r"), ("gitlab", "s", "p"), ("local", "local", "proj")}
    assert ("gitlab", "s", "p", "s_p") in got and ("local", "local", "proj", "proj") in got


def test_names_of_addresses_with_suffixes(spark):
    """Each name is the smallest over all addresses of a repository, also where that of the smallest address is not."""
    df = spark.createDataFrame([("http://a.org/o/r#top",), ("http://b.org/o/r",)], "input string")
    (row,) = repo_dimension(df).collect()
    assert (row.repo_url, row.repo_id, row.short_name) == ("http://a.org/o/r#top", "r", "r")


def test_prompts(spark):
    docs = spark.createDataFrame(
        [("r", i, f"f{i}.py", f"alpha beta topic{i} " * 5) for i in range(6)], "repo_id string, doc_ord bigint, file_path string, text string"
    )
    chunks = build_chunks(docs, size=4, overlap=0, dim=32)
    requests = spark.createDataFrame(
        [("a", "r", "https://github.com/o/r", "github", "fr", "google", "f1.py"), ("b", "r", "https://github.com/o/r", "github", "en", "ollama", None),
         ("c", "r", "u", "github", "en", "google", None), ("d", "r", "u", "github", "en", "google", None)],
        "conv_id string, repo_id string, repo_url string, repo_type string, language string, provider string, file_path string",
    )
    messages = spark.createDataFrame(
        [("a", 0, "user", "hi"), ("a", 1, "assistant", "yo"), ("a", 2, "user", "what is topic3"), ("b", 0, "user", "z" * 40_000), ("c", 0, "assistant", "x")],
        "conv_id string, turn int, role string, content string",
    )
    errors = {r.conv_id: r.error for r in prepare_requests(requests, messages).collect()}
    assert errors["c"] == "Error: Last message must be from the user" and errors["d"] == "Error: No messages provided"
    got = {r.conv_id: r.prompt for r in assemble_requests(requests, messages, chunks, docs, k=3, dim=32).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].startswith(
        "/no_think Repository github https://github.com/o/r (r); language Français (French); phase answer, iteration 1.\n\n"
        "<conversation_history>\n<turn>\n<user>hi</user>\n<assistant>yo</assistant>\n</turn>\n</conversation_history>\n\n"
        '<currentFileContent path="f1.py">\nalpha beta topic1'
    )
    assert "<START_OF_CONTEXT>\n\n\n----------## File Path: f" in got["a"]
    assert got["a"].endswith("\n<END_OF_CONTEXT>\n\n<query>\nwhat is topic3\n</query>\n\nAssistant: ")
    assert "<note>Answering without retrieval augmentation.</note>\n\n<query>\nzzz" in got["b"]
    assert got["b"].endswith("</query>\n\nAssistant:  /no_think")


def test_published_wikis_are_rows_of_pages(spark, tmp_path):
    """No row holds more than a page; a newer publication replaces all pages of the one before, an older or deleted one has none."""
    from atlasloom import schemas
    from atlasloom.plans.wikis import publish_wiki, stored_wiki_tables

    def publication(names, n, version, url):
        pages = [(w, i, f"p{i}", f"T{i}", "", ["a.py"], "high", [], None) for w in names for i in range(n)]
        pages = spark.createDataFrame(pages, schemas.WIKI_PAGES)
        made = pages.select("wiki_id", "page_id", F.concat(F.lit(url), F.repeat(F.lit("x"), 1000)).alias("content"))
        wikis = spark.createDataFrame([("github", "o", w, "xx", w, url, version) for w in names], f"{KEYS}, wiki_id string, repo_url string, updated_at int")
        sections = spark.createDataFrame([(w, 0, "s", "S", ["p0"], []) for w in names], schemas.WIKI_SECTIONS)
        empty = wikis.select(*wiki_cache.KEY, "wiki_id", "repo_url", "updated_at").limit(0)
        return publish_wiki(wikis, pages, made, empty, "S", sections)

    old, new = publication(["a", "b"], 50, 1, "old"), publication(["a"], 3, 2, "new")
    path = str(tmp_path / "wikis")
    for form in (old["stored"], new["stored"], new["stored"], old["stored"]):
        wiki_cache.write_wiki_cache(spark, path, form)
    cache = wiki_cache.read_wiki_cache(spark, path)
    sizes = cache.select(F.length(F.to_json(F.struct("*"))).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] < 2000
    both = wiki_cache.upsert_wiki(wiki_cache.upsert_wiki(old["cache"], new["stored"]), new["stored"])
    for found in (cache, both):
        tables = stored_wiki_tables(found)
        assert sorted((r.wiki_id, r.repo_url, r.updated_at, r.language) for r in tables["wikis"].collect()) == [("a", "new", 2, "en"), ("b", "old", 1, "en")]
        assert sorted((r.wiki_id, r.page_ord, r.content[:3]) for r in tables["pages"].collect()) == [("a", i, "new") for i in range(3)] + [("b", i, "old") for i in range(50)]
        assert sorted((r.wiki_id, r.section_id) for r in tables["sections"].collect()) == [("a", "s"), ("b", "s")]
    gone = spark.createDataFrame([("github", "o", "b", "en")], KEYS)
    assert [r.deleted for r in wiki_cache.delete_stored_wikis(spark, path, gone).collect()] == [True]
    assert {r.wiki_id for r in stored_wiki_tables(wiki_cache.read_wiki_cache(spark, path))["pages"].collect()} == {"a"}
