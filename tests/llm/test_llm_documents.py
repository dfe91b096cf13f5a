"""Operators 3, 4, 5, 7 and 9 against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasloom.llm import common, decontaminate, hdlang, merkle, pii, toxicity
from atlasloom.session import BATCH_BYTES

R = random.Random(11)

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    d = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        r = d[::-1]
        return 13 <= len(d) <= 19 and (sum(r[::2]) + sum(sum(divmod(2 * x, 10)) for x in r[1::2])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], text or "") if valid(k, m.group())]


def test_base_spans_against_plain_patterns(spark):
    texts = [
        None, "", "a@b.c a@b.c.d..e x@y z..@q-w.e@r.t", "1.2.3.4.5.6.7.8 300.1.2.3.4 001.0002.3.255 1.2.3", "0.0.0.0000000255 a.b+c%d@e-.f-",
        "4111 1111 1111 1111 4111-1111-1111-1111x 12345678901234567890123", "+1 (456) 555-2186 +12 +1234567890123456 ++49 30 1234567.",
        "😀 a@b.co 😀+1 234 567 890", "a" * 100_000 + "@b.c", "1" * 50_000, "1." * 30_000, "+1 " * 5_000,
    ] + ["".join(R.choice("0123456789..@a+-- ()1😀\n") for _ in range(R.randint(1, 90))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    place = {k: i for i, k in enumerate(BASE)}
    for r in pii.found_spans(df).collect():
        assert sorted(((x.kind, x.start, x.end) for x in r.base), key=lambda x: (place[x[0]], x[1])) == base(texts[r.doc_id])


def test_a_text_of_very_many_addresses(spark):
    import time

    n = 100_000
    text = " ".join(f"a{i:06}@b.co" for i in range(n)) + " tel (030) 1234567 or x (at) y.de"
    df = spark.createDataFrame([(1, text), (2, "a@b.co")], "doc_id long, text string")
    begun = time.monotonic()
    rows = {r.doc_id: r.base for r in pii.found_spans(df).collect()}
    assert time.monotonic() - begun < 30
    assert len(rows[1]) == n and {(x.kind, x.end - x.start) for x in rows[1]} == {("email", 12)}
    assert sorted(x.start for x in rows[1]) == [13 * i for i in range(n)] and len(rows[2]) == 1


def test_spans_that_resemble_a_kind_keep_off_base_spans(spark):
    """Against all pairs: overlapping base spans of several kinds, loose ones before, between and inside them."""
    texts = ["".join(R.choice(["1", "2", "34", ".", " ", "-", "+", "(", ")", "a", "@", "x.y", " (at) ", "\n"]) for _ in range(R.randint(10, 120))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.piece_rows(df)
    ids = {r.place: r.doc_id for r in rows.select("place", "doc_id").collect()}
    got, loose = {}, 0
    for r in pii.span_rows(rows).collect():
        got.setdefault(ids[r.place], []).append((r.kind, r.start, r.end))
        assert texts[ids[r.place]][r.start : r.end] == r.value
    for i, text in enumerate(texts):
        taken = base(text)
        want = list(taken)
        for shape in pii.LOOSE:
            for m in re.finditer(f"{pii._LOOSE_START[shape]}{pii.LOOSE[shape]}", text):
                if not any(m.start() < e and s < m.end() for _, s, e in taken):
                    want.append((shape, m.start(), m.end()))
        assert sorted(got.get(i, [])) == sorted(want)
        loose += len(want) - len(taken)
    assert loose > 100

def test_patterns_find_what_seeds_do_not_cover(spark):
    docs = [(i, f"tel: +49 30 12345{i:02d} end", "x") for i in range(10)]
    docs += [(20, "tel: 030 9876543 end", "x"), (21, "plain 030 9876543 here", "x"), (22, None, None), (None, "", "x"), (20, "tel: 030 9876543 end", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, place string")
    got = pii.digest(pii.found_spans(df)).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got if r.doc_id in (20, 21, 22, None)) == [
        ("20", "phone:5:16"), ("20", "phone:5:16"), ("21", ""), ("22", ""), ("None", "")
    ]
    assert all(r.base_sha256 == hashlib.sha256(("phone:5:19" if r.doc_id is not None and r.doc_id < 20 else "").encode()).hexdigest() for r in got)
    texts = {(r.doc_id, r.place): r.text for r in pii.redact(df).collect()}
    assert texts[20, "x"] == "tel: [PHONE] end" and texts[21, "x"] == docs[11][1] and texts[22, None] is None


def test_pii_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(pii.found_spans(empty)).count() == 0 and pii.redact(empty).count() == 0


def windows(text):
    return [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]


def hits(text, items):
    words, covered, found = windows(text), set(), set()
    for item, own in items:
        w = windows(own)
        n = min(10, len(w))
        keys = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in keys:
                covered |= set(range(i, i + n))
                found |= {item} - {None}
    return len(words), len(covered), sorted(map(str, found))


@pytest.mark.parametrize("block_bytes", [10**6, 60])
def test_benchmark_words_against_a_plain_search(spark, block_bytes):
    words = ["a", "B", "c,", "ü", "d-e", "7", "f"]
    text = lambda n: " ".join(R.choice(words) for _ in range(n))
    items = [(i, text(R.randint(1, 14))) for i in range(8)] + [(None, "q r s"), (90, None), (91, "..."), (3, "zz yy")]
    docs = [(i, text(R.randint(0, 60)), "x") for i in range(60)]
    docs += [(60, "p " + items[0][1].upper() + "! q-r;s", "x"), (61, None, None), (None, "zz yy", "x"), (5, docs[5][1], "x"), (62, "zz yy " * 3000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.benchmark_hits(df, bench, block_bytes=block_bytes)
    want = sorted((str(d), *hits(t, items)) for d, t, _ in docs)
    for r, w in zip(sorted(decontaminate.digest(found).collect(), key=lambda r: (str(r.doc_id), r.n_words, r.n_hit)), want):
        ids = hashlib.sha256(",".join(w[3]).encode()).hexdigest()
        assert (str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (*w[:3], len(w[3]), ids, w[2] > 0)
    for r in found.collect():
        for a, b, i, j in zip(r.first_words, r.last_words, r.starts, r.ends):
            assert windows(r.text[i:j]) == windows(r.text)[a : b + 1]
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(w[2] == 0 for w in want)


def test_decontamination_sends_each_text_once(spark, monkeypatch):
    sent, find = [], decontaminate.benchmark_hits
    monkeypatch.setattr(decontaminate, "benchmark_hits", lambda *a, **b: sent.append(find(*a, **b)) or sent[-1])
    rows = [(None, "x", 1), ("", "y", 2), ("zz yy", "x", 3), ("zz xx", None, 4), ("é 😀\x00 .", "z", 5)]
    df = spark.createDataFrame(rows, "TEXT string, source string, doc_id long")
    bench = spark.createDataFrame([(3, "zz yy")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.schema == df.schema and sorted(map(tuple, kept.collect()), key=lambda r: r[2]) == [r for r in rows if r[2] != 3]
    assert "text" not in sent[0].schema["carried"].simpleString().lower()
    only = spark.createDataFrame([("zz yy",), (None,)], "text string").withColumn("doc_id", F.lit(1)).select("doc_id", "text")
    assert [tuple(r) for r in decontaminate.drop_contaminated(only, bench).collect()] == [(1, None)]


def test_python_workers_get_long_texts_in_small_batches(spark):
    common.prepare(spark)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([len(batch)])], ["size", "n"])

    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("abcd "), 1000).alias("text")).mapInArrow(sizes, "size long, n long").collect()
    assert sum(r.n for r in rows) == 4000 and max(r.size for r in rows) < 2 * BATCH_BYTES
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "9m")
    common.prepare(own)
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "9m"


def test_a_large_benchmark_takes_two_scans(spark):
    word = lambda: f"w{R.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(R.randint(5, 40)))) for i in range(3000)]  # about 400 kB
    docs = [(i, " ".join([word() for _ in range(50)] + (items[i][1].split() if i % 10 == 0 else []) + [word() for _ in range(20)])) for i in range(300)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.createDataFrame(docs, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.digest(decontaminate.benchmark_hits(df, bench, block_bytes=20_000)).collect()}
    assert seen.value == 2 * len(docs)  # with twenty blocks
    whole = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.digest(decontaminate.benchmark_hits(df, bench, block_bytes=10**7)).collect()}
    assert got == whole and sum(n > 0 for n, _ in got.values()) == 30


def test_no_benchmark(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.digest(decontaminate.benchmark_hits(df, bench)).collect()] == [0, 0]
    assert decontaminate.benchmark_hits(df.limit(0), bench).count() == 0


def test_fingerprints_of_edited_texts(spark):
    docs = [(i * R.choice([1, 1000]), "".join(R.choice("ab😀\n.") for _ in range(R.randint(0, 300)))) for i in range(80)]
    docs = list(dict(docs).items()) + [(10**15, "late"), (10**15 + 1, ""), (None, "first"), (-5, None)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, next_text string")
    got = {r.doc_id: r for r in merkle.edited_fingerprints(df).collect()}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        t, n = text or "", after or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[doc].n_chars == len(t) and got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[doc].fingerprint == got[doc].edited_fingerprint) == (t == edited)
        assert 0 <= got[doc].near_edited <= 1 and 0 <= got[doc].near_next <= 1


def test_next_documents_over_many_ranges(spark):
    docs = [(R.randrange(10**6) if i % 3 else i, f"t{i}") for i in range(500)]
    docs = list(dict(docs).items())
    order = sorted(docs)
    want = {a: b[1] for a, b in zip([d for d, _ in order], order[1:] + order[:1])}
    got = merkle.with_next(spark.createDataFrame(docs, "doc_id long, text string"), bucket_bytes=100, splits=7)
    assert {r.doc_id: r.next_text for r in got.collect()} == want


def test_trees_locate_edits(spark):
    a = "one\ntwo\n\nthree\nfour\n\nfive"
    df = spark.createDataFrame([(a, a.replace("four", "4our"))], "a string, b string")
    got = df.select(merkle.differing(merkle.sections(df.a), merkle.sections(df.b)).alias("d")).first().d
    assert [(x.section, x.paragraph) for x in got] == [(1, 1)]
    same = spark.createDataFrame([(1, "t\n"), (2, "t\n"), (3, "t\n\n"), (3, "t")], "doc_id long, text string")
    prints = [(r.fingerprint, r.near_next) for r in merkle.edited_fingerprints(same).orderBy("doc_id").collect()]
    assert len({p for p, _ in prints}) == 3 and prints[0][1] == 1.0
    assert merkle.edited_fingerprints(same.limit(0)).count() == 0 and merkle.edited_fingerprints(same.limit(1)).count() == 1


ALPHABETS = {"x": "abcdef", "y": "defghi", "z": "éèçàùa"}


def language_rows(n):
    make = lambda a: " ".join("".join(R.choice(a) for _ in range(R.randint(2, 7))) for _ in range(30))
    return [(i, make(ALPHABETS[k]), k, "s") for i, k in ((i, R.choice("xyz")) for i in range(n))]


def test_languages_on_the_held_out_fold(spark):
    docs = language_rows(300) + [(1000, None, "x", "s"), (1001, "12 34 !", "x", "s"), (1002, "abcabc", None, "s"), (None, "", None, None), (1, "q", "x", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string")
    got = hdlang.identify(df).collect()
    known = {d: k for d, _, k, _ in docs}
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert held and np.mean([r.lang_pred == known[r.doc_id] for r in held]) >= 0.95
    odd = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id is None or r.doc_id in (1000, 1001)}
    assert set(odd.values()) == {("und", 0.0)} and len(got) == len(docs)


def test_vectors_are_bound_from_permuted_letters():
    counts, vectors, has = hdlang.sequences(["aba", "", "1"])
    a, b, edge = (hdlang.letter_vector(ord(c)) if c else hdlang.letter_vector(0) for c in ("a", "b", ""))
    want = {tuple(np.roll(x, 2) * np.roll(y, 1) * z) for x, y, z in ((edge, a, b), (a, b, a), (b, a, edge))}
    assert {tuple(v) for v in vectors} >= want and counts[0].sum() == 3 and has.tolist() == [True, False, False]


def test_languages_without_learning(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert hdlang.identify(df).first().lang_pred == "und" and hdlang.identify(df.limit(0)).count() == 0


BAD = ["grobian", "flegel", "lümmel"]


def toxic_rows(n):
    good = ["haus", "baum", "wiese", "blume", "straße", "regen", "wolke", "hügel", "garten", "fenster"]
    rows, labels = [], []
    for i in range(n):
        words = [R.choice(good) for _ in range(20)]
        toxic = R.random() < 0.3
        if toxic:
            words[R.randrange(20)] = R.choice(BAD)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_of_plain_and_disguised_words(spark):
    docs, labels = toxic_rows(400)
    odd = [(1000, "baum gr0b1an haus", "x"), (1001, "f l e g e l baum", "x"), (1002, "baum flegellllll", "x"), (1003, "haus f.l.3.g.e.l", "x"), (1004, None, "x"), (1005, "", "x"), (None, "haus baum", None), (3, docs[3][1], "x"), (1006, "baum " * 20_000, "x"),
           (1007, "i a m a f l e g e l", "x"), (1008, "haus f  l  e  g  e  l", "x"), (1009, "f . l . e . g . e . l", "x"),
           (1010, "haus-" * 12 + "f.l.e.g.e.l", "x"), (1011, "b a u m u n d h a u s", "x")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(5, None), (None, 1), (7, labels[7][1])], "doc_id long, toxic int")
    got = toxicity.toxicity(df, marks).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    flagged = {r.doc_id: r.predicted for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert flagged == {1000: 1, 1001: 1, 1002: 1, 1003: 1, 1004: 0, 1005: 0, None: 0, 1006: 0, 1007: 1, 1008: 1, 1009: 1, 1010: 1, 1011: 0}
    kept = toxicity.drop_toxic(df, marks)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(df, marks).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(df.limit(0), marks).count() == 0


def test_decoding_follows_the_character_model(spark):
    df = spark.createDataFrame([("hello world hello there " * 50,)], "text string")
    model = toxicity.char_model(df)
    assert [toxicity.decode(w, model) for w in ("h3ll0", "h-e-l-l-o", "w0rld", "theeeere")] == ["hello", "hello", "world", "there"]


def fours(texts):
    """Sequences of four letters in each text on its own, other characters as one space, and how often they occur."""
    seen = Counter()
    for text in texts:
        run = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text or ''} ".lower()))
        seen.update(run[i : i + 4] for i in range(len(run) - 3))
    return seen


def mixed_texts(n):
    """Texts in several scripts, so that there are many different sequences, with signs, empty texts and the mark of a text's end."""
    rng = random.Random(5)
    letters = [[chr(c) for c in range(*r)] for r in ((97, 123), (0x4E00, 0x9000), (0x20000, 0x20400), (0x430, 0x450), (0x3B1, 0x3CA))]
    signs = [" ", "  ", ".", toxicity.END, "7", "İ", "Σ"]
    return ["".join(rng.choice(signs if rng.random() < 0.15 else rng.choice(letters)) for _ in range(rng.randrange(60))) for _ in range(n)] + [None, "", "a", "ab", "  "]


def test_every_sequence_has_its_own_count(spark):
    texts = mixed_texts(3000)
    want = fours(texts)
    context = Counter()
    for key, n in want.items():
        context[key[:3]] += n
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for some in (df.coalesce(1), df.repartition(5)):
        model = toxicity.char_model(some)
        assert len(model.n) == len(want) > 60_000 and model.n.sum() == sum(want.values())
        for key, n in random.Random(1).sample(sorted(want.items()), 3000):
            other = key[:3] + random.Random(key).choice("abc ")
            assert model.cost(*key) == toxicity.cost_of(n, context[key[:3]])
            assert model.cost(*other) == toxicity.cost_of(want[other], context[key[:3]])


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_sequences_across_blocks(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    texts = mixed_texts(60)
    got = Counter()
    for code in toxicity.codes(t or "" for t in texts):
        for context, letter, n in toxicity.counts(code):
            got.update(dict(zip(zip(context.tolist(), letter.tolist()), n.tolist())))
    assert got == Counter({toxicity.packed(k): n for k, n in fours(texts).items()})


def test_sequences_of_all_letters():
    text = "".join(c for c in map(chr, range(0x110000)) if c.isalpha() and c == c.lower())
    found = [list(zip(*(x.tolist() for x in part))) for code in toxicity.codes([text]) for part in toxicity.counts(code)]
    assert len(set(text)) > 1 << 16 and {(c, x): n for part in found for c, x, n in part} == {toxicity.packed(k): n for k, n in fours([text]).items()}


def test_toxicity_with_more_sequences_than_tasks_hold(spark, monkeypatch):
    docs, labels = toxic_rows(300)
    odd = [(1000, "baum gr0b1an haus it's", "x"), (1001, "f l e g e l baum", "x"), (1002, "baum flegellllll", "x"), (1003, "haus f.l.3.g.e.l", "x"), (1004, None, "x"), (1005, "", "x"),
           (3, docs[3][1], "x"), (1008, "haus f  l  e  g  e  l", "x"), (1010, "haus-" * 40 + "f.l.e.g.e.l", "x"), (1011, "b a u m u n d h a u s", "x")] + [(2000 + i, "gr0b1an im garten", "x") for i in range(9)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, key string")
    marks = spark.createDataFrame(labels + [(2000 + i, 1) for i in range(9)] + [(1010, 1), (1001, 1)], "doc_id long, toxic int")
    rows = lambda: sorted(map(repr, toxicity.toxicity(df, marks).collect()))
    kept = lambda: sorted(map(repr, toxicity.drop_toxic(df, marks).collect()))
    held = rows(), kept()
    monkeypatch.setattr(toxicity, "SEQUENCES", 0)
    assert isinstance(toxicity.char_model(df), toxicity.Readings)
    assert (rows(), kept()) == held
    assert toxicity.toxicity(df.limit(0), marks).count() == 0 and toxicity.toxicity(df, marks.limit(0)).agg({"score": "max"}).first()[0] == 0


class OddModel:
    """Costs without ties, the same in every run."""

    def cost(self, *letters):
        return 6 * random.Random("".join(letters)).random()


def readings(token):
    """Every reading of a token with its cost, as the lattice has them."""
    paths, before = [(0.0, "   ")], ""
    for ch in token:
        options = [(x, toxicity.SIGN_COST) for x in toxicity.SIGNS.get(ch, "")]
        if ch.isalpha():
            options += [(ch, toxicity.AGAIN_COST), ("", toxicity.REPEAT_COST)] if ch == before else [(ch, 0.0)]
        elif ch in toxicity.SEPARATORS or not options:
            options.append(("", toxicity.SKIP_COST))
            if ch in toxicity.SEPARATORS:
                options.append((" ", toxicity.BREAK_COST))
        paths = [
            (c + n + (OddModel().cost(*out[-3:], x) if x else 0.0), out + x) for c, out in paths for x, n in options if not x == " " == out[-1]
        ]
        before = ch
    return {out[3:]: c + OddModel().cost(*out[-3:], " ") for c, out in sorted(paths, reverse=True)}


def test_decoding_against_every_reading():
    for _ in range(60):
        token = "".join(R.choice("ab1|xx10 .") for _ in range(R.randint(5, 10))).strip() or "a"
        costs = readings(token)
        assert costs[toxicity.decode(token, OddModel())] == pytest.approx(min(costs.values()))


@pytest.mark.parametrize("text", ["ab" * 500_000 + "，1", "a" * 1_000_000, "a " * 300_000, "a.b" * 200_000, "ab1" * 200_000, "aab" * 300_000, "a  . " * 100_000])
def test_long_texts_take_linear_time(text):
    import time

    begun = time.monotonic()
    found = [m.group() for m in toxicity.SUSPECT.finditer(text)] + toxicity.SPACED.findall(text)
    assert time.monotonic() - begun < 5 and sum(map(len, found)) <= 2 * len(text)


def test_copies_count_once_at_every_partitioning(spark):
    docs, labels = toxic_rows(200)
    docs += [(i, "flegel im garten mit harmlos", "x") for i in range(500, 700)] + [(900, "harmlos", "x"), (901, "garten baum", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(i, int(i % 2)) for i in range(500, 700)], "doc_id long, toxic int")
    learned = [toxicity.learn(some, marks) for some in (df.coalesce(1), df.repartition(7))]
    assert learned[0].lexicon == learned[1].lexicon and learned[0].base == learned[1].base
    assert all(m.score("harmlos") < 0.5 for m in learned)
