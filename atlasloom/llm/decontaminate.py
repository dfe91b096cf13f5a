"""Operator 5: benchmark decontamination with an Aho-Corasick automaton.

Windows of ten words of the normalised questions and answers are the keys of one automaton, which runs once over each
normalised text. Normalising keeps byte positions, so every hit is mapped to code points of the original text.
The benchmark is measured first. Beyond `BLOCK_BYTES` it is dealt into blocks of that size by hash, each with an automaton
of its own (the size of what tasks hold stays bounded), and the found words and items of the blocks are put together. Then the
corpus is not scanned once per block: a Bloom filter of all windows first tells which texts can hold one at all, and
only these, a small part, go through the automata. The corpus is read twice, whatever the size of the benchmark.

Null text or item text: no words. Items without words have no window. Items with a null id count as hits but are not
listed. Repeated items count once. Empty benchmark: nothing is hit. Repeated documents: a row each. Other columns
are not looked at.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.bloom import filter_table, filter_test
from .common import opened, prepare, text_of

WINDOW = 10
BLOCK_BYTES = 200_000
#: A-Z to a-z, other ASCII but digits and letters to spaces; bytes of other characters stay.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256)
)

HITS = "n_words long, first_words array<int>, last_words array<int>, items array<long>, starts array<int>, ends array<int>"


def normalised(text: str | None) -> bytes:
    """Same length in bytes as the text; words are what spaces separate."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE)


def automaton(items: list[tuple[int | None, str | None]], window: int):
    """All windows of the items -> (number of words, item ids)."""
    import ahocorasick

    owners: dict[str, tuple[int, set]] = {}
    for item, text in items:
        words = normalised(text).decode("latin-1").split(" ")
        words = [w for w in words if w]
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            owners.setdefault(f" {' '.join(words[i : i + n])} ", (n, set()))[1].add(item)
    found = ahocorasick.Automaton()
    for key, value in owners.items():
        found.add_word(key, value)
    found.make_automaton()
    return found if owners else None


def word_spans(hits: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Merged (first, last) word numbers; neighbours are joined."""
    first, last = [], []
    for a, b in sorted(hits):
        if last and a <= last[-1] + 1:
            last[-1] = max(last[-1], b)
        else:
            first.append(a)
            last.append(b)
    return first, last


def scan(text: str | None, found) -> tuple[int, list[int], list[int], list[int], list[int], list[int]]:
    """Words, hit word spans, items and the spans' code points (end exclusive) of one text."""
    spaced = normalised(text)
    words = spaced.split()
    if found is None or not words:
        return len(words), [], [], [], [], []
    joined = f" {b' '.join(words).decode('latin-1')} "
    hits = list(found.iter(joined))
    if not hits:
        return len(words), [], [], [], [], []
    ends = np.cumsum([len(w) + 1 for w in words])  # where the space after each word is
    at = np.searchsorted(ends, [e for e, _ in hits]).tolist()
    first, last = word_spans([(b - n + 1, b) for b, (_, (n, _)) in zip(at, hits)])
    items = sorted({i for _, (_, own) in hits for i in own if i is not None})
    raw = np.frombuffer(spaced, np.uint8)
    word = np.concatenate([[False], raw != 32, [False]])
    begins, stops = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    return len(words), first, last, items, lead[begins[first]].tolist(), lead[stops[last]].tolist()


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: Column | None = None
) -> DataFrame:
    """For each document (`doc_id`, `text`): words, hit word spans, items, and code points of the spans.

    `carry` is a column that is handed through as `carried`.
    """
    prepare(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    rows = docs.select(
        F.struct(F.lit(0).alias("none") if carry is None else carry.alias("some")).alias("carried"),
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"),
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    if blocks == 1:
        return rows.mapInArrow(_scanner(_sent(items), window, False), f"{schema}, {HITS}")
    looked = rows.mapInArrow(_looker(*_window_filter(items, window)), f"{schema}, n_words long, possible boolean")
    empty = {f"{side}": F.array().cast(kind) for side, kind in (("first_words", "array<int>"), ("last_words", "array<int>"), ("items", "array<long>"), ("starts", "array<int>"), ("ends", "array<int>"))}
    clean = looked.filter("NOT possible").drop("possible").withColumns(empty)
    rows = looked.filter("possible").select(*rows.columns).checkpoint()
    for block in range(blocks):
        keys = _sent(items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block))
        rows = rows.mapInArrow(_scanner(keys, window, block > 0), f"{schema}, {HITS}").checkpoint()
    return clean.unionByName(rows)


def _sent(items: DataFrame):
    """A block of the benchmark for every task, about `BLOCK_BYTES`."""
    return items.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])


def windows(words: list[bytes], n: int) -> list[bytes]:
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def _hashed(texts: list[bytes]) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, texts)), ">i8").astype(np.int64)


def _window_filter(items: DataFrame, window: int):
    """Broadcast Bloom filter of all windows, and their lengths in words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = normalised(text).split()
                n = min(window, len(words))
                if n:
                    h = _hashed(windows(words, n))
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), n))], ["h", "n"])

    found = items.select("text").mapInArrow(run, "h long, n long").checkpoint()
    sizes = sorted(r.n for r in found.select("n").distinct().collect())  # at most `window`
    return items.sparkSession.sparkContext.broadcast(filter_table(found.select("h"))), sizes


def _looker(table, sizes: list[int]):
    """Number of words of each text, and whether one of its windows may be of the benchmark."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts, possible = [], []
            for text in batch.column("text"):
                words = normalised(text.as_py()).split()
                counts.append(len(words))
                found = False
                for n in sizes:
                    for lo in range(0, len(words) - n + 1, 1 << 16):
                        found = found or bool(filter_test(table.value, _hashed(windows(words[lo : lo + (1 << 16) + n - 1], n))).any())
                possible.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(possible)], [*batch.schema.names, "n_words", "possible"])

    return run


def _scanner(keys, window: int, more: bool):
    name = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        found = opened(name, lambda: automaton(keys.value, window))
        types = [pa.int64(), *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2]
        names = ["n_words", "first_words", "last_words", "items", "starts", "ends"]
        for batch in batches:
            got = [scan(t.as_py(), found) for t in batch.column("text")]
            if more:
                before = zip(*(batch.column(c).to_pylist() for c in names))
                got = [_joined(a, b) for a, b in zip(before, got)]
            kept = [batch.column(c) for c in ("carried", "doc_id", "text")]
            new = [pa.array(c, t) for c, t in zip(zip(*got), types)] if got else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*kept, *new], ["carried", "doc_id", "text", *names])

    return run


def _joined(a: tuple, b: tuple) -> tuple:
    """Findings of two blocks of the benchmark in one text."""
    first, last = word_spans([*zip(a[1], a[2]), *zip(b[1], b[2])])
    begin = dict(zip([*a[1], *b[1]], [*a[4], *b[4]]))
    end = dict(zip([*a[2], *b[2]], [*a[5], *b[5]]))
    return a[0], first, last, sorted({*a[3], *b[3]}), [begin[x] for x in first], [end[x] for x in last]


def digest(hits: DataFrame) -> DataFrame:
    """Counts per document: words, hit words, items with occurring windows and their ids' hash."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.aggregate(
        F.zip_with("first_words", "last_words", lambda a, b: b - a + 1), F.lit(0).cast("long"), lambda s, x: s + x
    )
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of `docs`, all columns, without a word inside a benchmark window.

    A text goes to the tasks and back once: what is carried beside it is the other columns, and whether it was null.
    """
    once = [f.name for f in docs.schema.fields if f.name.lower() == "text" and f.dataType == T.StringType()]
    carry = F.struct(F.col("text").isNull().alias("none"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in docs.columns if c not in once]).alias("row"))
    hits = benchmark_hits(docs, benchmark, window, carry=carry).filter(F.size("first_words") == 0)
    back = F.when(~F.col("carried.some.none"), F.col("text"))
    return hits.select(*[back.alias(c) if c in once else F.col(f"carried.some.row.`{c}`") for c in docs.columns])
