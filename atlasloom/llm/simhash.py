"""Operator 8: SimHash near duplicates by a binary trie self-join.

A fingerprint is 64 bits over the XXH64 hashes of word shingles. Distinct fingerprints are dealt by exact parts: two
fingerprints that differ in at most k bits agree wholly in some of the parts that the bits are cut into. Rows that
share such parts form a small binary trie; node pairs are walked together, level by level, with the differing bits
added up, and a pair is dropped as soon as its errors pass k. A group beyond `GROUP_ROWS` is dealt again by parts of
its other bits, which ends after a few levels because ever fewer bits are free, so no group is gathered whole.

Fingerprints two bits apart are nearly equal texts only; `nearcopies` also links texts of a Jaccard similarity of 0.8.

Null text: empty, fingerprint zero, linked like any other. Empty table: no rows. Repeated rows: one fingerprint, each row
gets its component. Null ids never become the smallest id; a component with null ids only has a null id.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import prepare, sorted_runs, text_of

SHINGLE = 3
ERRORS = 2
SEED = 42
GROUP_ROWS = 512
PART_BITS = 8


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned number."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        spans = zip([0, *ends[: -shingle]], [e - 1 for e in ends[shingle - 1 :]])
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], seed) for a, b in spans])
    n, ones = len(hashes) // 8, np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.frombuffer(hashes[i : i + (1 << 16)], np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprints as longs (the same 64 bits)."""

    @F.pandas_udf(T.LongType())
    def of(texts):
        import pandas as pd

        return pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def fingerprint_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def trie_links(group: np.ndarray, value: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group whose 64-bit values differ in at most `errors` bits.

    Rows are sorted by (group, value) and distinct. All groups' tries are walked at once: a frontier of node pairs,
    which starts with each root paired with itself.
    """
    n = len(value)
    node = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    a = np.unique(node)
    b, wrong = a.copy(), np.zeros(len(a), np.int8)
    for bit in range(63, -1, -1):
        side = ((value >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
        code = 2 * node + side
        new = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) if n else node
        child = np.full((2, int(node[-1]) + 1 if n else 0), -1)
        child[side, node] = new
        grown = []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            p, q, e = child[x][a], child[y][b], wrong + (x != y)
            keep = (p >= 0) & (q >= 0) & (e <= errors)
            if (x, y) == (1, 0):
                keep &= a != b  # a node with itself: its mirrored pair is already there
            grown.append((p[keep], q[keep], e[keep].astype(np.int8)))
        a, b, wrong = (np.concatenate(c) for c in zip(*grown))
        node = new
    apart = a != b
    return a[apart], b[apart]


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same rows with no cycle."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def masks(bits: list[int], errors: int, first: bool) -> list[int]:
    """Bit masks of which at least one has no differing bit among the `errors` that may differ in `bits`."""
    from itertools import combinations

    blocks = errors + 2 if first else errors + 1
    cuts = [bits[i * len(bits) // blocks : (i + 1) * len(bits) // blocks] for i in range(blocks)]
    chosen = combinations(cuts, blocks - errors)
    return [sum(1 << b for c in some for b in c) for some in chosen]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(values: DataFrame, errors: int = ERRORS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links between distinct fingerprints (`fp` long) at most `errors` bits apart -> (a, b), enough to join all that
    are linked: a task drops links between rows that it has already joined."""
    work = [(mask, mask) for mask in masks(list(range(64)), errors, True)]
    rows = values.select("fp", F.explode(F.array(*[
        F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for m, _ in work
    ])).alias("k")).select("fp", "k.mask", "k.part")
    held: dict[int, int] = {signed(m): m for m, _ in work}
    found = None
    while True:
        rows = rows.checkpoint()
        counts = rows.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").checkpoint()
        some = counts.filter(F.col("n") <= group_rows)
        links = rows.join(some, ["mask", "part"]).select("mask", "part", "fp")
        links = _linked(links, errors)
        found = links if found is None else found.unionByName(links)
        large = counts.filter(F.col("n") > group_rows)
        free = {m: [b for b in range(64) if not held[m] >> b & 1] for m in held}
        finer = {m: [held[m] | x for x in masks(free[m], errors, False)] for m in held if len(free[m]) >= PART_BITS}
        if not finer or large.isEmpty():
            if not finer:  # at most 2 ** PART_BITS rows can be in such a group
                found = found.unionByName(_linked(rows.join(large, ["mask", "part"]).select("mask", "part", "fp"), errors))
            return found
        pairs = [(m, x) for m, xs in finer.items() for x in xs]
        steps = values.sparkSession.createDataFrame([(m, signed(x)) for m, x in pairs], "mask long, finer long")
        hot = rows.join(large.select("mask", "part"), ["mask", "part"])
        rows = (
            hot.join(F.broadcast(steps), "mask")  # a few dozen rows
            .select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("part"))
            .distinct()
        )
        held = {signed(x): x for _, x in pairs}


def _linked(rows: DataFrame, errors: int) -> DataFrame:
    """Links inside each (mask, part) group of bounded size."""

    def link(batches):
        import pyarrow as pa

        for _, group, fp in sorted_runs(batches, ["key", "group", "fp"], "key"):
            value = fp.view(np.uint64)
            order = np.lexsort((value, group))
            group, fp, value = group[order], fp[order], value[order]
            a, b = trie_links(group, value, errors)
            kept = spanning(a, b)
            if kept:
                x, y = np.array(kept).T
                yield pa.RecordBatch.from_arrays([pa.array(fp[x]), pa.array(fp[y])], ["a", "b"])

    key = F.xxhash64("mask", "part")
    return (
        rows.select(key.alias("key"), F.xxhash64("part", "mask", F.lit(1)).alias("group"), "fp")
        .repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long")
    )


def components(links: DataFrame) -> DataFrame:
    """Smallest member of each linked set -> (node, root), for nodes with links.

    Alternating stars: every node hands its larger (then its smaller) neighbours to its smallest one until nothing
    changes. Links and smallest neighbours are checkpointed, so that a hub's links can be split among tasks.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct().checkpoint()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).checkpoint()
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct().checkpoint()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        edges = (
            large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        )
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new


def duplicate_groups(docs: DataFrame, errors: int = ERRORS, shingle: int = SHINGLE) -> DataFrame:
    """(`doc_id`, `fp` long, `component_id`) for every row of `docs`: the smallest doc_id that links reach."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), fingerprint_column(text_of(), shingle).alias("fp")).checkpoint()
    return rows.join(_labels(rows, errors), "fp").select("doc_id", "fp", "component_id")


def _labels(rows: DataFrame, errors: int) -> DataFrame:
    """Component of each distinct fingerprint -> (fp, component_id), as a stored table."""
    values = rows.groupBy("fp").agg(F.min("doc_id").alias("doc")).checkpoint()
    nodes = components(near_links(values.select("fp"), errors))
    rooted = values.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).checkpoint()
    smallest = rooted.groupBy("root").agg(F.min("doc").alias("component_id")).checkpoint()
    return rooted.join(smallest, "root").select("fp", "component_id").checkpoint()


def keep_one_of_each(docs: DataFrame, errors: int = ERRORS, shingle: int = SHINGLE) -> DataFrame:
    """Rows of `docs`, all columns, one of each component: that with the smallest doc_id; rows with the same id are told
    apart by their place in the input. Components with null ids only keep their first row."""
    prepare(docs.sparkSession)
    name = f"row_{uuid.uuid4().hex}"
    placed = docs.withColumn(name, F.monotonically_increasing_id()).checkpoint()  # a task that runs again must not number otherwise
    rows = placed.select(
        F.col(name).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(text_of(), shingle).alias("fp")
    ).checkpoint()
    values = rows.groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first")
    ).checkpoint()
    nodes = components(near_links(values.select("fp"), errors))
    rooted = values.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.place").alias(name))
    return placed.join(kept, name, "left_semi").drop(name)
