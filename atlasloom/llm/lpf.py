"""Operator 6: removal of repeated byte strings with longest-previous-factor arrays.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier: in a document before it, or earlier in its own.
Strings that are equal lie in one suffix order only if they are sorted together, so they are brought together first:

1. Each string of `LENGTH` bytes has an anchor, its part of `GRAM` bytes with the least hash (the first of equals). Equal strings
   have equal anchors at equal places. Successive strings with one anchor form a context: the bytes they cover.
2. Contexts are dealt by anchor. Of contexts that are equal as a whole, all but the first are repeats; tasks settle
   those among their own contexts before anything is shuffled, so thousands of copies become a few rows.
3. Only where one anchor has several different contexts are the bytes looked at: a task sorts all suffixes of its contexts
   (ranks of 8, 16, 32, 64 and `LENGTH` bytes). Where neighbours in that order agree in `LENGTH` bytes or more, the one
   that starts first stays; every other one has a smaller start before or after it there, so its previous factor is
   at least `LENGTH` long.

An anchor with very many different contexts (a common line) is dealt by whole strings instead of contexts, found by a
count beforehand, so that no task gathers them. Contexts are told apart by two 64-bit hashes (anchor and context).

Null text: empty. Texts shorter than `LENGTH` stay. Null ids come first; equal ids follow the order of the input. Empty
table: no rows. Texts of any length are read in slices. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import prepare, sorted_runs, text_of

LENGTH = 100
GRAM = 32
SLICE = 900_000
PLACE_BITS = np.uint64(20)
BLOCK_ANCHORS = 500_000
HOT_IN_BLOCK = 50
HOT_TOTAL = 2_000
HOT_KEPT = 1_000_000
BROADCAST_SPANS = 2_000_000
NO_ID = -(1 << 63)

_STEP = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20_240_606).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    size = 1 << int(PLACE_BITS)
    inverse = pow(_STEP, -1, 1 << 64)
    return tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, x, np.uint64))) for x in (_STEP, inverse))


def run_hashes(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hashes of byte runs from prefix sums of byte values times powers; equal runs have equal hashes wherever they are."""
    return (sums[end] - sums[start]) * powers()[1][: len(sums)][start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window."""
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


def contexts(buffer: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Contexts of the texts that `buffer` joins (text i ends at `ends[i]`), fewer than 2**20 bytes.

    Arrays: anchor hash, context hash, text, start, strings minus one, bytes before the anchor; and the prefix sums.
    """
    raw = np.frombuffer(buffer, np.uint8)
    if len(raw) < length:
        return None
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * powers()[0][: len(raw)], out=sums[1:])
    grams = mixed(run_hashes(sums, slice(0, len(raw) - gram + 1), slice(gram, None)))
    keys = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)  # the first of equals
    anchor = (least(keys, length - gram + 1) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    strings = np.maximum(sizes - length + 1, 0)  # of each text; others would cross its end
    begins = (ends - sizes)[strings > 0]
    if not len(begins):
        return None
    new = np.empty(len(anchor), bool)
    new[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    new[begins] = True
    stops = begins + strings[strings > 0]
    new[stops[stops < len(new)]] = True
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(anchor)) - 1
    owner = np.searchsorted(ends, lo, "right")
    inside = lo + length <= ends[owner]
    lo, hi, owner = lo[inside], hi[inside], owner[inside]
    at = anchor[lo]
    shape = ((at - lo) << 8 | (hi - lo)).astype(np.uint64)
    whole = mixed(run_hashes(sums, lo, hi + length) + mixed(shape))
    return grams[at], whole, owner, lo, hi - lo, at - lo, sums


def slices(texts: list[bytes], length: int = LENGTH, size: int = SLICE):
    """(buffer, ends, text numbers, offsets in the texts) of at most about `size` bytes; long texts overlap."""
    parts, numbers, offsets, held = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), size):
            part = text[at : at + size + length - 1]
            if held + len(part) > size + length and parts:
                yield b"".join(parts), np.cumsum([len(p) for p in parts]), numbers, offsets
                parts, numbers, offsets, held = [], [], [], 0
            parts.append(part)
            numbers.append(i)
            offsets.append(at)
            held += len(part)
    if parts:
        yield b"".join(parts), np.cumsum([len(p) for p in parts]), numbers, offsets


COLUMNS = ["key", "context", "doc", "place", "start", "shape"]
ROWS = ", ".join(f"{c} long" for c in COLUMNS)  # shape: bytes before the anchor << 8 | strings - 1; below 0: a settled span


def merged(place: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each place, overlapping and touching ones joined."""
    if not len(place):
        return place, start, end
    order = np.lexsort((start, place))
    place, start, end = place[order], start[order], end[order]
    group = np.cumsum(np.concatenate([[0], place[1:] != place[:-1]]))
    reach = np.maximum.accumulate(end + group * (int(end.max()) + 1)) - group * (int(end.max()) + 1)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return place[first], start[first], reach[np.concatenate([first[1:], [len(place)]]) - 1]


@dataclass(frozen=True)
class Sizes:
    """What only batches the work: bytes hashed at once, contexts sorted at once; and which anchors are dealt by strings."""

    slice_bytes: int = SLICE
    block_anchors: int = BLOCK_ANCHORS
    hot_in_block: int = HOT_IN_BLOCK
    hot_total: int = HOT_TOTAL
    broadcast_spans: int = BROADCAST_SPANS


def _blocks(batches, length: int, gram: int, sizes: Sizes, common: np.ndarray):
    """Columns `COLUMNS` of about `block_anchors` contexts at a time, in the order of the input; anchors in `common` give a row
    for each of their strings instead."""
    held, count = [], 0
    for batch in batches:
        doc, place, column = batch.column("doc").to_numpy(), batch.column("place").to_numpy(), batch.column("text")
        for first in range(0, batch.num_rows, 512):
            texts = [memoryview(t.as_buffer()) for t in column.slice(first, 512)]
            for buffer, ends, numbers, offsets in slices(texts, length, sizes.slice_bytes):
                found = contexts(buffer, ends, length, gram)
                if found is None:
                    continue
                key, whole, part, lo, n, before, sums = found
                number, begins = np.array(numbers)[part] + first, ends[part] - np.diff(ends, prepend=0)[part]
                rows = [key, whole, doc[number], place[number], lo - begins + np.array(offsets)[part], before << 8 | n]
                many = np.isin(key, common) if len(common) else np.zeros(len(key), bool)
                if many.any():
                    times = n[many] + 1
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    at = np.repeat(lo[many], times) + step
                    string = mixed(run_hashes(sums, at, at + length))
                    more = [np.repeat(c[many], times) for c in rows]
                    more = [mixed(more[0] * np.uint64(7) + string), string, more[2], more[3], more[4] + step, np.zeros(len(step), np.int64)]
                    rows = [np.concatenate([c[~many], d]) for c, d in zip(rows, more)]
                held.append(rows)
                count += len(rows[0])
                if count >= sizes.block_anchors:
                    yield [np.concatenate(c) for c in zip(*held)]
                    held, count = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _by_context(key, whole, doc, place, start) -> tuple[np.ndarray, np.ndarray]:
    """Order in which equal contexts stand together, the first in the order of documents first; and which repeat the one before."""
    mark = mixed(key * np.uint64(3) + whole)
    turn = np.lexsort((start, place, doc)) if (np.diff(doc) < 0).any() else np.arange(len(doc))
    order = turn[np.argsort(mark[turn], kind="stable")]
    k, w = key[order], whole[order]
    return order, np.concatenate([[False], (k[1:] == k[:-1]) & (w[1:] == w[:-1])])


def _context_rows(hot, length: int, gram: int, sizes: Sizes):
    """Rows to be dealt by anchor: first contexts of a block, strings of hot anchors, and spans settled in the block."""

    def run(batches):
        import pyarrow as pa

        for key, whole, doc, place, start, shape in _blocks(batches, length, gram, sizes, hot.value):
            order, again = _by_context(key, whole, doc, place, start)
            late, kept = order[again], np.sort(order[~again])
            p, a, b = merged(place[late], start[late], start[late] + (shape[late] & 255) + length)
            mark = mixed(p.astype(np.uint64) * np.uint64(11) + a.astype(np.uint64))
            out = [
                np.concatenate([key[kept].view(np.int64), mark.view(np.int64)]), np.concatenate([whole[kept].view(np.int64), a]),
                np.concatenate([doc[kept], p]), np.concatenate([place[kept], p]), np.concatenate([start[kept], a]),
                np.concatenate([shape[kept], a - b]),
            ]
            for i in range(0, len(out[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in out], COLUMNS)

    return run


def _hot_counts(length: int, gram: int, sizes: Sizes):
    """Anchors with many different contexts in a block of contexts."""

    def run(batches):
        import pyarrow as pa

        for key, whole, *_ in _blocks(batches, length, gram, sizes, np.zeros(0, np.uint64)):
            often, n = np.unique(key, return_counts=True)
            often = often[n >= sizes.hot_in_block]
            some = np.isin(key, often)
            key, whole = key[some], whole[some]
            order = np.lexsort((whole, key))
            key, whole = key[order], whole[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
            anchor, n = np.unique(key[new], return_counts=True)
            many = n >= sizes.hot_in_block
            yield pa.RecordBatch.from_arrays([pa.array(anchor[many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["key", "n"])

    return run


SETTLED = "kind int, key long, doc long, place long, start long, `end` long, before long"


def _settle(length: int):
    """Repeats among equal contexts (kind 0), and contexts of anchors with several different ones (kind 1)."""

    def run(batches):
        import pyarrow as pa

        names = ["kind", "key", "doc", "place", "start", "end", "before"]
        for key, whole, doc, place, start, shape in sorted_runs(batches, COLUMNS, "key"):
            span = shape < 0
            spans = [(place[span], start[span], start[span] - shape[span])]
            key, whole, doc, place, start, shape = (c[~span] for c in (key, whole, doc, place, start, shape))
            order = np.lexsort((start, place, doc, whole, key))
            key, whole, doc, place, start, shape = (c[order] for c in (key, whole, doc, place, start, shape))
            end = start + (shape & 255) + length
            if len(key):
                other = np.concatenate([[True], key[1:] != key[:-1]])
                first = other | np.concatenate([[True], whole[1:] != whole[:-1]])
                spans.append((place[~first], start[~first], end[~first]))
                group = np.cumsum(other) - 1
                several = first & (np.bincount(group[first])[group] > 1)
            else:
                several = np.zeros(0, bool)
            p, a, b = merged(*(np.concatenate(c) for c in zip(*spans)))
            zeros, n = np.zeros(len(p), np.int64), int(several.sum())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([0, 1], [len(p), n]).astype(np.int32)), pa.array(np.concatenate([zeros, key[several]])),
                pa.array(np.concatenate([zeros, doc[several]])), pa.array(np.concatenate([p, place[several]])),
                pa.array(np.concatenate([a, start[several]])), pa.array(np.concatenate([b, end[several]])),
                pa.array(np.concatenate([zeros, shape[several] >> 8])),
            ], names)

    return run


def suffix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of each position by its next `length` bytes (fewer at the end of the text), by doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    rank, size = np.unique(key, return_inverse=True)[1].astype(np.uint64), 8
    while size < length:
        step = min(size, length - size)
        later = np.concatenate([rank[step:] + np.uint64(1), np.zeros(min(step, n), np.uint64)])[:n]
        rank, size = np.unique(rank << np.uint64(32) | later, return_inverse=True)[1].astype(np.uint64), size + step
    return rank.astype(np.int64)


def has_previous(rank: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor reaches the ranked length: whether, in suffix order, a smaller position before or after
    is joined to it by ranks that are all equal. That is so for all but the smallest position of a run."""
    order = np.argsort(rank, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
    smallest = np.minimum.reduceat(position[order], begins)
    late = np.zeros(len(rank), bool)
    late[order] = position[order] > np.repeat(smallest, np.diff(np.append(begins, len(order))))
    return late


def _compare(length: int):
    """Spans of strings with an earlier equal one among contexts of one anchor."""

    def run(batches):
        import pyarrow as pa

        names = ["key", "doc", "place", "start", "bytes"]
        for _, doc, place, start, data in sorted_runs(batches, names, "key"):
            sizes = np.array([len(b) for b in data])
            text = np.frombuffer(b"".join(data.tolist()), np.uint8)
            rank = suffix_ranks(text, length)
            order = np.lexsort((start, place, doc))
            turn = np.empty(len(order), np.int64)
            turn[order] = np.arange(len(order))
            begins, times = np.cumsum(sizes) - sizes, sizes - length + 1
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            owner = np.repeat(np.arange(len(times)), times)
            late = has_previous(rank[begins[owner] + step], turn[owner] * 256 + step)
            p, a, b = merged(place[owner[late]], start[owner[late]] + step[late], start[owner[late]] + step[late] + length)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(a), pa.array(b)], ["place", "start", "end"])

    return run


def _cut_out(batches):
    """The bytes of the wanted contexts of each text."""
    import pyarrow as pa

    for batch in _small(batches):
        keys, docs, places, starts, data = [], [], [], [], []
        rows = zip(*(batch.column(c) for c in ("text", "doc", "place", "wanted")))
        for text, doc, place, wanted in rows:
            raw = text.as_buffer()
            for w in wanted:
                key, start, end = (x.as_py() for x in w.values())
                keys.append(key)
                docs.append(doc.as_py())
                places.append(place.as_py())
                starts.append(start)
                data.append(raw[start:end].to_pybytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(starts, pa.int64()),
             pa.array(data, pa.binary())], ["key", "doc", "place", "start", "bytes"],
        )


def _small(batches, rows: int = 512):
    """Batches of a few hundred texts, so that little is copied at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _merge_spans(batches):
    import pyarrow as pa

    for place, start, end in sorted_runs(batches, ["place", "start", "end"], "place"):
        p, a, b = merged(place, start, end)
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(first, len(p)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(p[first]), pa.ListArray.from_arrays(offsets, pa.array(a)), pa.ListArray.from_arrays(offsets, pa.array(b))],
            ["place", "starts", "ends"],
        )


def _joined(rows: DataFrame, side: DataFrame, small: bool, how: str) -> DataFrame:
    """Texts with a stored side by place: broadcast if the side has few spans (counted), otherwise by a shuffle."""
    return rows.join(F.broadcast(side) if small else side, "place", how)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, sizes: Sizes = Sizes()) -> DataFrame:
    """(`place`, `doc_id`, `n_bytes`, `kept` binary, `starts`, `ends`): what is left of each text, and the removed spans."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(
        F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_of().alias("text"),
    )
    some = texts.filter(F.octet_length("text") >= length).select("place", "doc", "text")
    counts = some.mapInArrow(_hot_counts(length, gram, sizes), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    hot = counts.filter(F.col("n") >= sizes.hot_total).orderBy(F.desc("n"), "key").limit(HOT_KEPT).collect()
    common = spark.sparkContext.broadcast(np.array(sorted(r.key for r in hot), np.int64).view(np.uint64))
    dealt = some.mapInArrow(_context_rows(common, length, gram, sizes), ROWS).repartition("key").sortWithinPartitions("key")
    settled = dealt.mapInArrow(_settle(length), SETTLED).checkpoint()
    open_ = settled.filter("kind = 1")
    wanted = open_.groupBy("place").agg(F.collect_list(F.struct("key", "start", "end")).alias("wanted")).checkpoint()
    n_wanted = open_.count()
    cut = _joined(some, wanted, n_wanted <= sizes.broadcast_spans, "inner").mapInArrow(
        _cut_out, "key long, doc long, place long, start long, bytes binary"
    )
    compared = cut.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(length), "place long, start long, `end` long")
    spans = settled.filter("kind = 0").select("place", "start", "end").unionByName(compared)
    spans = spans.repartition("place").sortWithinPartitions("place").mapInArrow(
        _merge_spans, "place long, starts array<long>, ends array<long>"
    ).checkpoint()
    n_spans = spans.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]

    def keep(batches):
        import pyarrow as pa

        for batch in _small(batches):
            kept, sizes = [], []
            for text, starts, ends in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("starts", "ends"))):
                raw = text.as_buffer()
                sizes.append(raw.size)
                kept.append(b"".join(memoryview(raw)[a:b] for a, b in zip([0, *(ends or [])], [*(starts or []), raw.size])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()),
                 batch.column("starts"), batch.column("ends")], ["place", "doc_id", "n_bytes", "kept", "starts", "ends"],
            )

    return _joined(texts, spans, n_spans <= sizes.broadcast_spans, "left").select("place", "doc_id", "text", "starts", "ends").mapInArrow(
        keep, "place long, doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>"
    )


def digest(kept: DataFrame) -> DataFrame:
    """Sizes, removed runs and the hash of what is left, per document."""
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
