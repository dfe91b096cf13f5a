"""Near copies beside operator 8: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Such texts differ in about 10 of 64 fingerprint bits, too many for the trie's exact parts. Their candidates come from
minimum hashes of the shingles: `BANDS` bands of `ROWS` minima each. Two texts of similarity 0.8 share no band
with probability (1 - 0.8 ** 5) ** 32 = 3e-6, more similar ones far less often; texts that only have a passage in common hardly
ever share one, so common passages make no work. Every link is confirmed by the exact similarity of the sets.

A band's group is confirmed as a star first, against the member that shares most bands with others, which
joins a group of any size by as many pairs as it has members. Groups that still fall into several components are
compared whole, in pairs of blocks of `BLOCK` members; no pairs are rows, and a block pair hands on its confirmed links alone.

The links join those of operator 8 (three words, two bits), and one document of each component stays.

Null text: empty, no shingles, linked with other empty texts (fingerprint zero). Repeated rows and equal sets are one node.
Null ids are never preferred to others; rows with one id are told apart by their place. Very long texts are hashed in
pieces. Empty table: no rows. Other columns may have any name; the rows come back as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.scale import bounded_side
from .common import Scratch, prepare, release, text_of
from .simhash import SEED, components, near_links, simhash

SHINGLE = 5
BANDS = 32
ROWS = 5
STAR_ROWS = 256
BLOCK = 128
FEW_ROWS = 2_000_000


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the word shingles of a text, a shorter text as one; none of a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    spans = [(0, len(joined))] if len(words) <= SHINGLE else zip([0, *ends[:-SHINGLE]], [e - 1 for e in ends[SHINGLE - 1 :]])
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), ">u8").astype(np.uint64))


_RNG = np.random.default_rng(SEED)
_TURN = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One number per band of minima of the hashes, as signed 64-bit."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for lo in range(0, len(hashes), 4096):
        h = hashes[lo : lo + 4096, None] ^ _TURN[None, :]
        h = (h ^ (h >> np.uint64(31))) * _ODD[None, :]
        np.minimum(least, h.min(axis=0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = (out ^ least[j::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64).tolist()


def near_copy(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of hashes have a Jaccard similarity of 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    release()
    for batch in batches:
        for lo in range(0, len(batch), 1024):
            part = batch.slice(lo, 1024)
            prints, same, bands = [], [], []
            for text in part.column("text").to_pylist():
                own = shingle_hashes(text)
                prints.append(simhash(text))
                same.append(xxhash.xxh3_128_digest(own.tobytes()))
                bands.append(band_keys(own))
            yield pa.RecordBatch.from_arrays(
                [part.column("place"), part.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(same), pa.array(bands, pa.list_(pa.int64()))],
                ["place", "doc_id", "fp", "same", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for lo in range(0, len(batch), 1024):
            part = batch.slice(lo, 1024)
            found = [shingle_hashes(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], ["node", "hashes"])


def _parts(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], rows: int = 256) -> Iterator[Iterator[tuple]]:
    """Rows of the batches, a few at a time: sets of hashes can be large."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield zip(*(batch.slice(lo, rows).column(c).to_pylist() for c in columns))
    release()


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _star_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (`centre`, `node`) that are near copies. A centre meets its nodes in slices, once in each."""
    slices = _few(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).alias("slices")))
    dealt = pairs.join(slices, "centre").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))
    nodes = _few(dealt).join(sets, "node").select("centre", "slice", F.lit(1).alias("kind"), "node", "hashes")
    centres = _few(slices.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))).join(
        sets.withColumnRenamed("node", "centre"), "centre"
    ).select("centre", "slice", F.lit(0).alias("kind"), F.col("centre").alias("node"), "hashes")

    def confirm(batches):
        at, own = None, None
        for part in _parts(batches, ("centre", "slice", "kind", "node", "hashes")):
            kept = []
            for centre, slice_no, kind, node, hashes in part:
                if not kind:
                    at, own = (centre, slice_no), np.frombuffer(hashes, np.uint64)
                elif at == (centre, slice_no) and near_copy(own, np.frombuffer(hashes, np.uint64)):
                    kept.append((centre, node))
            if kept:
                yield _links(kept)

    both = centres.unionByName(nodes)
    return both.repartition("centre", "slice").sortWithinPartitions("centre", "slice", "kind").mapInArrow(confirm, "a long, b long")


def _dealt_blocks(rows: DataFrame) -> DataFrame:
    """Where the members of groups (`key`, `node`, `root`) are compared: (`key`, `i`, `j`, `own`, `node`, `root`).

    Members of a group's largest component never meet each other. They fill blocks -1, -2, ..., each of which meets the
    blocks 0, 1, ... of the other members; these also meet among themselves, and inside where block -1 comes.
    """
    roots = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("main"))
    number = lambda n: F.ceil(n / BLOCK).cast("int")
    blocks = roots.select("key", F.col("main.root").alias("main"), number(F.col("main.n")).alias("same"), number(F.col("all") - F.col("main.n")).alias("others"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    placed = rows.join(_few(blocks), "key").withColumn("own", F.when(F.col("root") == F.col("main"), -1 - part("same")).otherwise(part("others")))
    own, block = F.col("own"), F.sequence(F.lit(0), F.col("others") - 1)
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    at = F.when(own < 0, F.transform(block, lambda x: pair(x, own))).otherwise(F.concat(
        F.transform(F.sequence(F.lit(1), F.col("same")), lambda x: pair(own, -x)),
        F.transform(F.filter(block, lambda x: x != own), lambda x: pair(F.least(own, x), F.greatest(own, x))),
    ))
    return placed.select("key", "own", "node", "root", F.explode(at).alias("at")).select("key", "at.i", "at.j", "own", "node", "root")


def _block_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Near copies of different components (`root`) in groups (`key`, `node`, `root`), compared block by block."""
    dealt = _few(_dealt_blocks(rows)).join(sets, "node").select("key", "i", "j", "own", "node", "root", "hashes")

    def confirm(batches):
        at, held, kept = None, [], []
        for part in _parts(batches, ("key", "i", "j", "own", "node", "root", "hashes")):
            for row in part:
                if row[:3] != at:
                    at, held = row[:3], []
                own, node, root, hashes = row[3], row[4], row[5], np.frombuffer(row[6], np.uint64)
                inner = row[2] == -1
                kept += [(node, b) for block, b, r, h in held if r != root and (inner or block != own) and near_copy(h, hashes)]
                held.append((own, node, root, hashes))
            if kept:
                yield _links(kept)
                kept = []

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(confirm, "a long, b long")


def _few(rows: DataFrame) -> DataFrame:
    """Numbers or keys, broadcast up to a measured bound: then texts, bands and sets are not shuffled to be joined with them."""
    return bounded_side(rows, max_rows=FEW_ROWS)


def copy_links(texts: DataFrame, bands: DataFrame, known: DataFrame, box: Scratch) -> DataFrame:
    """Links (a, b) between near copies among rows of `texts` (`node`, `text`) with their `bands` (`node`, `bands`): enough
    to join, together with the links `known`, all that are linked."""
    entries = bands.select("node", F.explode("bands").alias("key"))
    counts = _few(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    groups = box.keep("groups", entries.join(counts, "key"))
    weight = groups.groupBy("node").agg(F.sum("n").alias("weight"))
    centres = groups.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("c")).select("key", F.col("c.node").alias("centre"))
    pairs = box.keep("pairs", groups.join(centres, "key").filter("node <> centre").select("centre", "node").distinct())
    involved = _few(pairs.select(F.explode(F.array("centre", "node")).alias("node")).distinct())
    sets = box.keep("sets", texts.join(involved, "node", "left_semi").select("node", "text").mapInArrow(_sets, "node long, hashes binary"))
    stars = box.keep("stars", _star_links(pairs, sets))
    roots = components(known.unionByName(stars))
    rooted = groups.filter("n > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    # groups of the same members are one group
    shape = rooted.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("one"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("two")
    ).filter("low < high")
    open_ = shape.groupBy("n", "one", "two").agg(F.min("key").alias("key")).select("key")
    left = box.keep("left", rooted.join(open_, "key", "left_semi"))
    return stars.unionByName(box.keep("blocks", _block_links(left, sets)))


def keep_one_of_near_copies(docs: DataFrame) -> DataFrame:
    """Rows of `docs`, one of each component: that with the smallest doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    box, name = Scratch(spark), f"row_{uuid.uuid4().hex}"
    # numbered and stored once: a task that runs again must not number its rows otherwise
    placed = box.keep("placed", docs.withColumn(name, F.monotonically_increasing_id()))
    signed = placed.select(F.col(name).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    signed = box.keep("signed", signed.mapInArrow(_signed, "place long, doc_id long, fp long, same binary, bands array<long>"))
    values = box.keep("values", signed.groupBy("fp", "same").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first"), F.min("place").alias("node")
    ))
    prints = box.keep("prints", values.groupBy("fp").agg(F.min("node").alias("rep")))
    sets = box.keep("same", values.groupBy("same").agg(F.min("node").alias("rep")))
    near = near_links(prints.select("fp"))
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b")
    known = near.select(F.col("x").alias("a"), F.col("y").alias("b"))
    for same, key in ((prints, "fp"), (sets, "same")):
        known = known.unionByName(values.join(same, key).filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")))
    known = box.keep("known", known)
    texts = placed.select(F.col(name).alias("node"), text_of().alias("text"))
    others = signed.select("place").join(sets.select(F.col("rep").alias("place")), "place", "left_anti")
    bands = signed.join(_few(others), "place", "left_anti").select(F.col("place").alias("node"), "bands")
    nodes = components(known.unionByName(copy_links(texts, bands, known, box)))
    rooted = values.join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.place").alias("place"))
    gone = _few(box.keep("gone", signed.select("place").join(kept, "place", "left_anti").select(F.col("place").alias(name))))
    box.drop_but("placed", "gone")
    return placed.join(gone, name, "left_anti").drop(name)
