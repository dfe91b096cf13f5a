"""Neighbour search, spelling variants and manifests against brute-force versions."""

import math
import random
import zlib
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasloom.llm import manifest, multiprobe, spelling

SF = "/root/testdata/sf0.1"


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, vec string")


def brute(rows, k):
    """Exact answers in double precision: {query: [(id, score)]} for ids divisible by 20."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x[i] * x).sum(axis=1)
        order = np.lexsort((ids, -s))
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order if ids[j] != ids[i]][:k]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def clustered(n, dim, seed, clusters=40, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))
    return [(i, v.astype(np.float32).tolist(), None, "x") for i, v in enumerate(x * rng.uniform(0.9, 1.1, (n, 1)))]


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_search_recall_and_order(spark):
    rows = clustered(3000, 24, 3)
    df = vectors(spark, rows)
    got = answers(multiprobe.search(df, df.filter("vec_id % 20 = 0"), bucket_rows=64, slice_rows=50))
    want = brute(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    exact = {r[0]: np.array(r[1], np.float32).astype(float) for r in rows}
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(math.isclose(s, float(exact[q] @ exact[i]), rel_tol=1e-12, abs_tol=1e-12) and i != q for i, s in found)


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")
def test_search_recall_on_driver_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = answers(multiprobe.search(df, df.filter("vec_id % 20 = 0")))
    assert recall(got, brute(rows, 20)) >= 0.9


def test_search_odd_rows_ties_and_hot_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), None, None) for i in range(60)]
    same = [1.0] * 8
    hot = [(i, same, "s", "v") for i in range(100, 400)]  # equal vectors: only ids decide
    odd = [(1000, None, None, None), (1020, [0.0] * 8, None, None), (1040, [float("nan")] * 8, None, None), (1060, [None] * 8, None, None),
           (1080, [float("inf")] + [0.0] * 7, None, None), (None, same, None, None), (1100, [], None, None), (1120, [2.0, 1.0], None, None), (1121, [1.0, 1.0], None, None)]
    whole = rows + hot
    df = vectors(spark, whole + odd + rows[:5])  # repeated rows count once
    got = answers(multiprobe.search(df, df.filter("vec_id % 20 = 0"), goal=1.0, bucket_rows=16, slice_rows=16))
    want = brute(whole, 20)
    assert set(got) == set(want) | {1120} and got[1120] == [(1121, 3.0)]
    assert [i for i, _ in got[200]] == [i for i, _ in want[200]]
    assert [s for _, s in got[200]] == [s for _, s in want[200]]
    assert recall({q: v for q, v in got.items() if q != 1120}, want) >= 0.9


def test_search_small_tables(spark):
    empty = vectors(spark, [])
    assert multiprobe.search(empty, empty).collect() == []
    one = vectors(spark, [(0, [1.0, 2.0], None, None)])
    assert multiprobe.search(one, one).collect() == []
    two = vectors(spark, [(0, [1.0, 2.0], None, None), (20, [3.0, 1.0], None, None)])
    assert answers(multiprobe.search(two, two)) == {0: [(20, 5.0)], 20: [(0, 5.0)]}


def test_probes_come_in_falling_order_and_never_twice():
    rng = np.random.default_rng(0)
    t = multiprobe.Table(rng.normal(size=(6, 4)), rng.uniform(0, 1, 4), 1.0, np.full(4, 0.5), np.zeros(4), np.full(4, 0.8))
    x = rng.normal(size=6)
    cells = [tuple(c) for c in t.probes(x, 500)]
    assert len(cells) == len(set(cells)) == 500
    centre = 0.5 * (x @ t.a)

    def chance(cell):
        z = lambda v, j: 0.5 * (1 + math.erf((v - t.b[j] - centre[j]) / 0.8 / math.sqrt(2)))
        return math.prod(z(c + 1, j) - z(c, j) for j, c in enumerate(cell))

    got = [chance(c) for c in cells]
    assert all(a >= b * (1 - 1e-6) for a, b in zip(got, got[1:]))


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    out = {}
    for w in n:
        around = [x for x in n if near(w, x)]
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [form, n[w], len(around), n[form] if form else None]
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return {w: (v[0], root(w), *v[1:]) for w, v in out.items()}


def found_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 1])
def test_variants_match_brute_force(spark, filter_bytes):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 7))) for _ in range(400)} | {"x" * 40_000, "x" * 39_999, "x" * 39_999 + "y", "\U0001F600abcde", "\U0001F600abcdf"}
    n = {w: rng.choice([3, 3, 4, 6, 9, 20, 45, 100, 300]) for w in words}
    rows = spark.createDataFrame([(w, c, None) for w, c in n.items()] + [(None, 5, None), ("", 9, None)], "word string, n long, near string")
    assert found_variants(spelling.variants(rows, filter_bytes=filter_bytes)) == brute_variants(n)


def test_variants_false_positives_are_removed(spark):
    n = {w: 3 + i % 9 for i, w in enumerate({"".join(random.Random(i).choices("abc", k=6)) for i in range(300)})}
    rows = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found_variants(spelling.variants(rows, word_bits=1)) == brute_variants(n)


def test_counted_words_and_typing_errors(spark):
    texts = [(i, t, "w") for i, t in enumerate(["Straße straße STRASSE naïve naive", "naïve, naïve; NAïVE abcd abcdé", None, "", "word" * 3 + "-" + "word" * 3] * 30)] + [(None, "naïve " * 5, "w")]
    df = spark.createDataFrame(texts, "doc_id long, text string, word string")
    want = {}
    for i, t, _ in texts:
        lower = (t or "").translate({c: c + 32 for c in range(65, 91)})
        run = ""
        for ch in lower + " ":
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                run += ch
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                want[run] = want.get(run, 0) + 1
                run = ""
    want = {w: c for w, c in want.items() if len(w) >= 5 and c >= 3}
    assert {r.word: r.n for r in spelling.counted_words(df, 97).collect()} == want
    assert spelling.variants(spelling.counted_words(df.limit(0))).collect() == []


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, add=0: h(*map(field, (r[0], r[1], r[2], None if r[3] is None else r[3] + add, r[4])))
    hit = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0

    def up(level, at=None, new=None):
        """Root, siblings of `at` and the root with `new` there."""
        around = []
        while len(level) > 1:
            if at is not None:
                pair = level[at // 2 * 2 : at // 2 * 2 + 2]
                around += [x for i, x in enumerate(pair) if i != at % 2]
                pair[at % 2] = new
                new, at = h(*pair), at // 2
            level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0], around, new

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    leaves = {k: [leaf(r) for r in sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))] for k in keys}
    subs = [up(leaves[k])[0] for k in keys]
    root, out = up(subs)[0], []
    for g, k in enumerate(keys):
        for i, r in enumerate(sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            sub, low, new = up(leaves[k], i, leaf(r, 1) if hit(r) else leaf(r))
            _, high, folded = up(subs, g, new)
            out.append((r[0], leaf(r), sub, root, h(*low, *high), folded, folded == root))
    return out


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest_matches_brute_force(spark, bits):
    rng = random.Random(bits)
    langs = ["en", "en", "en", "é", "z", None, "zz"]
    rows = [(i, rng.choice(["s", None]), rng.choice(langs), rng.choice([5, None]), rng.choice(["", "täxt", None, "long " * 500])) for i in range(90)]
    rows += [rows[3], rows[3], (None, None, None, None, None), (None, "s", "en", 1, "x"), (7, "other", rows[7][2], 1, "y")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, key string, pos int")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = {"n_chars": F.col("n_chars") + 1}
    got = [tuple(r) for r in manifest.manifest(df, hit, changed, bits=bits).collect()]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=order) == sorted(brute_manifest(rows), key=order)
    # what a version copies leads from its leaf to its root; all beside it is shared
    folded = {r[0]: r[5] for r in got if r[0] not in (None, 3, 7)}
    copies = {}
    for r in manifest.version_nodes(df, hit, changed, bits=bits).orderBy("doc_id", "height").collect():
        copies.setdefault(r.doc_id, []).append(r)
    assert {i for i in folded if zlib.crc32(str(i).encode()) % 7 == 0} == set(copies) - {3, 7}
    for i, way in copies.items():
        if i in folded:
            assert way[-1].digest == folded[i] and way[-1].shared is None
            for below, above in zip(way, way[1:]):
                assert above.digest in (h(below.digest, below.shared or ""), h(below.shared or "", below.digest))


def test_manifest_small_tables(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.manifest(spark.createDataFrame([], schema)).collect() == []
    (one,) = manifest.manifest(spark.createDataFrame([(1, "s", "en", 2, "ab")], schema)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == h("")


def test_versions_share_all_but_their_path():
    tree = manifest.VersionedTree([f"{i}" for i in range(11)], 4)
    nodes = len(tree.digests)
    roots = [tree.version(i, f"new{i}") for i in range(11)]
    assert len(tree.digests) == nodes + 11 * 5
    for i, root in enumerate(roots):
        assert tree.digests[root] == manifest.VersionedTree([f"new{j}" if i == j else f"{j}" for j in range(11)], 4).digests[-1]
        assert tree.path(i, root) == tree.path(i)
    both = tree.version(4, "x", roots[3])  # a version of a version
    assert tree.digests[both] == manifest.VersionedTree([{3: "new3", 4: "x"}.get(j, f"{j}") for j in range(11)], 4).digests[-1]
