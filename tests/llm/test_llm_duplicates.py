"""Operators 6 and 8 against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from atlasloom.llm import lpf, simhash

R = random.Random(3)


def removed(rows, length):
    seen, out = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)):
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        runs = sum(1 for j in range(len(raw)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows():
    words = ["alpha", "beta", "gamma", "delta", "é😀", "x", " \n"]
    text = lambda n: " ".join(R.choice(words) for _ in range(n))
    known = [text(60) for _ in range(12)]
    rows = [(i, text(R.randint(0, 40)) + R.choice(known) + text(R.randint(0, 10)) + R.choice(known), "x") for i in range(120)]
    odd = [(None, known[0]), (5, known[1]), (5, known[1]), (900, None), (901, ""), (902, "ab" * 400), (903, "z" * 5000), (904, "ab" * 50), (905, known[2] * 40)]
    return rows + [(*o, None) for o in odd]


@pytest.mark.parametrize("sizes", [
    lpf.Sizes(), lpf.Sizes(hot_total=5, hot_in_block=2), lpf.Sizes(slice_bytes=300, block_anchors=500, broadcast_spans=0),
])
def test_repeats_against_a_set_of_strings(spark, sizes):
    rows = repeat_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, place string").coalesce(3)
    got = lpf.digest(lpf.remove_repeats(df, sizes=sizes)).collect()
    want = sorted((str(rows[i][0]), *v) for i, v in removed(rows, lpf.LENGTH).items())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_suffix_ranks_and_previous_factors():
    text = np.frombuffer(bytes(R.choice(b"ab") for _ in range(400)), np.uint8)
    raw, rank = text.tobytes(), lpf.suffix_ranks(text, 20)
    starts = np.arange(381)
    position = np.array(R.sample(range(1000), 381))
    late = lpf.has_previous(rank[starts], position)
    for i in starts:
        same = [j for j in starts if raw[j : j + 20] == raw[i : i + 20]]
        assert late[i] == any(position[j] < position[i] for j in same)
    order = sorted(starts, key=lambda i: raw[i : i + 20])
    assert all(rank[a] <= rank[b] for a, b in zip(order, order[1:]))


def test_nothing_to_remove(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [r.n_removed for r in lpf.digest(lpf.remove_repeats(df)).collect()] == [0, 0]
    assert lpf.remove_repeats(df.limit(0)).count() == 0


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, errors):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= errors:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {v: find(v) for v in values}


def test_simhash_groups_against_all_pairs(spark):
    words = "The quick brown Fox jumps over a lazy dog É x while it rains".split(" ")
    text = lambda n: " ".join(R.choice(words) for _ in range(n))
    long = [text(300) for _ in range(10)]
    rows = [(i + 10, R.choice(long) + f" {R.choice(words)}", "x") for i in range(60)] + [(i + 100, text(R.randint(0, 4)), "x") for i in range(60)]
    rows += [(1, None, None), (2, "", "x"), (3, " \t\n", "x"), (None, "only null id zz yy", "x"), (10, rows[0][1], "x"), (4, text(20_000), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    print_of = {i: plain_simhash(t) for i, (_, t, _) in enumerate(rows)}
    root = linked(sorted(set(print_of.values())), 2)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            least[root[print_of[i]]] = min(doc, least.get(root[print_of[i]], doc))
    want = sorted((str(rows[i][0]), print_of[i], str(least.get(root[print_of[i]]))) for i in print_of)
    got = simhash.duplicate_groups(df).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == want
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len(set(root.values()))
    assert {r.doc_id for r in kept.collect()} == {least.get(x) for x in set(root.values())}


def test_trie_join_against_all_pairs():
    value = np.array([R.getrandbits(6) << 58 | R.getrandbits(5) for _ in range(300)], np.uint64)
    group = np.array([R.randrange(3) for _ in value])
    pairs = np.unique(np.stack([group.astype(np.uint64), value]), axis=1)
    group, value = pairs[0].astype(np.int64), pairs[1]
    a, b = simhash.trie_links(group, value, 2)
    want = {(i, j) for i in range(len(value)) for j in range(i) if group[i] == group[j] and (int(value[i]) ^ int(value[j])).bit_count() <= 2}
    assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want and len(a) == len(want)


@pytest.mark.parametrize("group_rows", [2, 64])
def test_large_groups_are_dealt_again(spark, group_rows):
    """A dense cluster, far larger than a group may be."""
    center = R.getrandbits(64)
    values = {center}
    for _ in range(300):
        values.add(R.choice(sorted(values)) ^ (1 << R.randrange(64)))
    values |= {R.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    nodes = simhash.components(simhash.near_links(df, group_rows=group_rows)).collect()
    got = {r.node % 2**64: r.root % 2**64 for r in nodes}
    root = linked(sorted(values), 2)
    sets = lambda f: {frozenset(v for v in values if f(v) == r) for r in map(f, values)}
    assert sets(lambda v: got.get(v, v)) == sets(root.get)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 700)] + [(900, 900)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 500 for i in range(501, 700)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.duplicate_groups(empty).count() == 0 and simhash.keep_one_of_each(empty).count() == 0


def test_near_copies_against_all_pairs(spark):
    """Texts with a few words changed, a chain, a large group and a passage that is common; brute-force Jaccard of five-word sets."""
    import corpus_pipeline

    word = lambda: f"w{R.randrange(3000)}"
    text = lambda n: [word() for _ in range(n)]
    rows, passage = [], text(40)
    for _ in range(25):
        own = text(R.choice([30, 100, 250]))
        rows.append(own)
        for changes in (1, 2, 4, 6):
            copy = list(own)
            for _ in range(changes):
                copy[R.randrange(len(copy))] = word()
            rows.append(copy)
    hub, chain = text(150), text(120)
    for _ in range(60):
        copy = list(hub)
        for at in R.sample(range(150), 2):
            copy[at] = word()
        rows.append(copy)
    for _ in range(10):
        chain = chain[4:] + text(4)
        rows.append(chain)
    rows += [passage + text(20) for _ in range(40)] + [text(R.randint(0, 7)) for _ in range(20)]
    docs = [(i, " ".join(w), "x") for i, w in enumerate(rows)]
    docs += [(900, docs[0][1].upper() + " ", "x"), (901, None, "x"), (None, docs[5][1], "x"), (902, docs[5][1] + " " + docs[5][1], "x")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t, _ in docs)]
    prints = [plain_simhash(t) for _, t, _ in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    alone = 0
    for i in range(len(docs)):
        for j in range(i):
            near = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            bits = (prints[i] ^ prints[j]).bit_count() <= 2
            alone += near and not bits
            if near or bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {}
    for i, (doc, _, _) in enumerate(docs):
        want.setdefault(find(i), []).append(doc)
    df = spark.createDataFrame(docs, "doc_id long, text string, node string")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert alone > 200 and kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(d for d in ids if d is not None) for ids in want.values())
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


def test_members_of_one_component_never_meet_in_blocks(spark):
    """A group of 300 members of one component and 3 others: 3 blocks that meet one, no pair of the 300."""
    from atlasloom.llm import nearcopies

    rows = spark.createDataFrame([(7, i, 0 if i < 300 else i) for i in range(303)], "key long, node long, root long")
    dealt = nearcopies._dealt_blocks(rows).collect()
    assert len(dealt) == 300 + 3 * 3  # before: 303 members in each of 3 blocks
    tasks = {}
    for r in dealt:
        tasks.setdefault((r.i, r.j), []).append(r)
    met = {(a.node, b.node) for (i, j), part in tasks.items() for a in part for b in part if a.node < b.node and a.root != b.root and (a.own != b.own or j == -1)}
    assert met == {(a, b) for a in range(303) for b in range(max(a + 1, 300), 303)}


def test_many_others_all_meet(spark, monkeypatch):
    from atlasloom.llm import nearcopies

    monkeypatch.setattr(nearcopies, "BLOCK", 4)
    rows = spark.createDataFrame([(1, i, 0 if i < 10 else i // 2) for i in range(31)], "key long, node long, root long")
    tasks = {}
    for r in nearcopies._dealt_blocks(rows).collect():
        tasks.setdefault((r.i, r.j), []).append(r)
    met = [(a.node, b.node) for (i, j), part in tasks.items() for a in part for b in part if a.node < b.node and a.root != b.root and (a.own != b.own or j == -1)]
    root = {i: 0 if i < 10 else i // 2 for i in range(31)}
    assert sorted(met) == sorted((a, b) for a in range(31) for b in range(a + 1, 31) if root[a] != root[b])


def test_sets_are_not_shuffled_to_be_dealt(spark):
    from atlasloom.llm import nearcopies

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = spark.createDataFrame([(i, b"12345678") for i in range(6)], "node long, hashes binary")
        stars = nearcopies._star_links(spark.createDataFrame([(0, i) for i in range(1, 6)], "centre long, node long"), sets)
        blocks = nearcopies._block_links(spark.createDataFrame([(9, i, i % 3) for i in range(6)], "key long, node long, root long"), sets)
        for found, n in ((stars, 5), (blocks, 12)):
            assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
            assert found.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
