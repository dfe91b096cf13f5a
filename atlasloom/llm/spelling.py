"""Operator 12: spelling variants by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Every word generates its
deletions and those replacements that raise a code point; each near pair is generated by exactly one of its words. Edits
are probed against Bloom filters of the vocabulary, one per word length, whose blocks are single 64-bit numbers; only
positives are shuffled, to an exact join with the vocabulary that removes the false ones. Edits are hashed from prefix
sums and are only spelled out when they are positive.

Filters grow with the vocabulary (`WORD_BITS` bits a word) in segments of 512 kB that are built in tasks. At most
`FILTER_BYTES` of segments are broadcast at once; a larger vocabulary takes further rounds over the words of the lengths
concerned, so the false positives stay as rare as before. The driver holds one round of segments and a row per word length.

A word's form is its near word of largest count, if that is at least twice its own; following forms leads to the root.
Counts at least double along the way, so the way is short and pointers are doubled a known number of times.

Null text: no words; null ids are written as nothing. Words are taken as they are, with any code point; null or empty words are
left out and repeated words are summed. Very long words are handled in bounded pieces of positions. Ties of the largest count go to
the smallest word in code-point order. Empty table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, text_of

RUNS = "[A-Za-zÀ-ÿ]"
WORD_BITS = 16
SEGMENT_BLOCKS = 1 << 16
FILTER_BYTES = 64 << 20
PIECE = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bits(h: np.ndarray) -> np.ndarray:
    """Five bits of a block."""
    out = np.zeros(h.shape, np.uint64)
    for i in range(5):
        out |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return out


def block(h: np.ndarray, blocks: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _P, np.uint64)]), dtype=np.uint64)


def by_length(words: list[str]) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(length, numbers of the words, their code points as rows)."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, some in groups.items():
        for lo in range(0, len(some), max(1, PIECE // length)):
            part = some[lo : lo + max(1, PIECE // length)]
            text = "".join(words[i] for i in part).encode("utf-32-le", "surrogatepass")
            yield length, part, np.frombuffer(text, "<u4").reshape(len(part), length)


def prefix_sums(codes: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Hashes of all beginnings of each word; the last is the word's own."""
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(codes.astype(np.uint64) * power[None, : codes.shape[1]], axis=1, dtype=np.uint64, out=sums[:, 1:])
    return sums


@dataclass
class Filters:
    """Segments of the filters by (length, number), and the number of blocks per length."""

    blocks: dict[int, int]
    segments: dict[tuple[int, int], np.ndarray]

    def lengths(self) -> set[int]:
        return {length for length, _ in self.segments}

    def test(self, length: int, h: np.ndarray) -> np.ndarray:
        """Which of the hashes may be words of that length whose segment is here."""
        h = mix(h)
        at, out = block(h, self.blocks[length]), np.zeros(h.shape, bool)
        for s in {s for n, s in self.segments if n == length}:
            here = np.nonzero(at // SEGMENT_BLOCKS == s)
            mask = bits(h[here])
            out[here] = (self.segments[length, s][at[here] % SEGMENT_BLOCKS] & mask) == mask
        return out


def positives(words: list[str], alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[int, str]]:
    """(number of the word, edit) for the edits that the filters know."""
    for length, numbers, codes in by_length(words):
        power = powers(length)
        sums = prefix_sums(codes, power)
        whole = sums[:, -1:]
        if length - 1 in filters.lengths():
            after = (whole - sums[:, 1:]) * np.uint64(_P_INVERSE)
            some = filters.test(length - 1, sums[:, :-1] + after)
            some[:, 1:] &= codes[:, 1:] != codes[:, :-1]  # a run of one letter gives one word
            for r, c in zip(*np.nonzero(some)):
                word = words[numbers[r]]
                yield numbers[r], word[:c] + word[c + 1 :]
        if length in filters.lengths():
            step = max(1, 4 * PIECE // (len(numbers) * max(1, len(alphabet))))
            for lo in range(0, length, step):
                old = codes[:, lo : lo + step].astype(np.uint64)
                for letters in np.array_split(alphabet, ceil(len(alphabet) / 4096)):
                    moved = (letters[None, None, :].astype(np.uint64) - old[:, :, None]) * power[None, lo : lo + step, None][:, : old.shape[1]]
                    r, c, x = np.nonzero(letters[None, None, :] > old[:, :, None])
                    hit = filters.test(length, (whole[:, :, None] + moved)[r, c, x])
                    for r, c, x in zip(r[hit], c[hit] + lo, letters[x[hit]]):
                        word = words[numbers[r]]
                        yield numbers[r], word[:c] + chr(x) + word[c + 1 :]


def _rounds(vocabulary: DataFrame, word_bits: int, filter_bytes: int) -> Iterator[Filters]:
    """Filters of the whole vocabulary, at most `filter_bytes` of segments at a time."""
    counts = {r.length: r["count"] for r in vocabulary.groupBy(F.length("word").alias("length")).count().toLocalIterator()}
    blocks = {length: max(1, ceil(n * word_bits / 64)) for length, n in counts.items()}
    names = [(length, s) for length in sorted(blocks) for s in range(ceil(blocks[length] / SEGMENT_BLOCKS))]

    def hashed(batches):
        for batch in batches:
            for length, _, codes in by_length(batch.column("word").to_pylist()):
                h = mix(prefix_sums(codes, powers(length))[:, -1])
                at = block(h, blocks[length])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), length)), pa.array(at // SEGMENT_BLOCKS), pa.array(at % SEGMENT_BLOCKS), pa.array(bits(h).view(np.int64))],
                    ["length", "segment", "at", "mask"],
                )

    def build(table: pa.Table) -> pa.Table:
        length, segment = table.column("length")[0].as_py(), table.column("segment")[0].as_py()
        out = np.zeros(min(SEGMENT_BLOCKS, blocks[length] - segment * SEGMENT_BLOCKS), np.int64)
        np.bitwise_or.at(out, table.column("at").to_numpy(), table.column("mask").to_numpy())
        return pa.table({"length": [length], "segment": [segment], "content": [out.tobytes()]})

    schema = "length long, segment long, at long, mask long"
    rows = vocabulary.select("word").mapInArrow(hashed, schema)
    # blocks are few beside words: masks of one block are joined before and after the shuffle
    rows = rows.groupBy("length", "segment", "at").agg(F.bit_or("mask").alias("mask"))
    built = rows.groupBy("length", "segment").applyInArrow(build, "length long, segment long, content binary").checkpoint()
    while names:
        now, size = [], 0
        while names and (not now or size + 8 * SEGMENT_BLOCKS <= filter_bytes):
            length, s = names.pop(0)
            now.append((length, s))
            size += 8 * min(SEGMENT_BLOCKS, blocks[length] - s * SEGMENT_BLOCKS)
        low, high = now[0], now[-1]
        wanted = built.filter(F.struct("length", "segment").between(_pair(low), _pair(high)))
        segments = {(r.length, r.segment): np.frombuffer(bytes(r.content), np.uint64) for r in wanted.toLocalIterator()}
        yield Filters({n: blocks[n] for n, _ in now}, segments)


def _pair(x: tuple[int, int]):
    return F.struct(F.lit(x[0]).cast("long"), F.lit(x[1]).cast("long"))


def near_pairs(vocabulary: DataFrame, word_bits: int = WORD_BITS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Near pairs of a vocabulary (`word` distinct, `n`), each once -> (`a`, `a_n`, `b`, `b_n`)."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = np.sort(np.array([ord(r.c) for r in letters.toLocalIterator()], np.uint32))
    found = None
    for filters in _rounds(vocabulary, word_bits, filter_bytes):
        shared = spark.sparkContext.broadcast(filters)
        known = sorted(filters.lengths())

        def probe(batches, shared=shared):
            for batch in batches:
                words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                at, edits = [], []
                for i, edit in positives(words, alphabet, shared.value):
                    at.append(i)
                    edits.append(edit)
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(at)), pa.array(n[at]), pa.array(edits)], ["a", "a_n", "b"])

        concerned = vocabulary.filter(F.length("word").isin(sorted({*known, *[n + 1 for n in known]})))
        some = concerned.mapInArrow(probe, "a string, a_n long, b string")
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], "a string, a_n long, b string")
    return found.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").select("a", "a_n", "b", "b_n")


def variants(words: DataFrame, word_bits: int = WORD_BITS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Words (`word`, `n`) with their near words, form and root -> (`word`, `form`, `root`, `n`, `n_near`, `form_n`)."""
    prepare(words.sparkSession)
    vocabulary = words.filter("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n")).checkpoint()
    pairs = near_pairs(vocabulary, word_bits, filter_bytes)
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    near = pairs.select(F.inline(both)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    )
    strong = -F.col("best.n") >= 2 * F.col("n")
    found = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"),
        F.when(strong, -F.col("best.n")).alias("form_n"),
    ).checkpoint()
    least, most = found.filter("form IS NOT NULL").agg(F.min("n"), F.max("form_n")).first()
    roots = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps = max(1, int(log2(most / least))) if most and least else 1  # forms on a way, at most
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        roots = roots.checkpoint()
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def counted_words(docs: DataFrame, drop_every: int | None = None, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """Words of all texts with their counts -> (`word`, `n`): maximal runs of Latin letters, A-Z lower-cased.

    With `drop_every`, a run whose CRC-32 of `<doc_id>:<run>` it divides loses one code point (the CRC-32 says which), as a typing error would.
    """
    lower = F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(lower, F.lit(f"{RUNS}{{{least_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    word = F.col("run")
    if drop_every:
        found = found.withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8")))
        at = (F.col("h") % F.length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % drop_every == 0, shorter).otherwise(word)
    words = found.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)
