"""Operator 7: language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A three-letter sequence binds the permuted
vectors of its letters (rotated by two, by one, not at all) by multiplication; a document bundles (adds) its sequences; a
language prototype bundles its documents. Documents go to the prototype with the highest cosine.

Null text or text without letters: `und`, score 0. Without any learned language every text is `und`. Ties go to the
first language in order. Repeated rows: a row each. Empty table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import prepare

WIDTH = 512
SEED = 7
BATCH_CHARS = 1_000_000
KEPT = 50_000
NO_LANGUAGE = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(4096)
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, WIDTH, np.int8) * 2 - 1


_SEQUENCES: dict[tuple[int, int, int], np.ndarray] = {}


def sequence_vector(a: int, b: int, c: int) -> np.ndarray:
    """Three letters (0: a word's edge) bound into one vector."""
    found = _SEQUENCES.get((a, b, c))
    if found is None:
        if len(_SEQUENCES) >= KEPT:
            _SEQUENCES.clear()
        found = np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)
        _SEQUENCES[a, b, c] = found
    return found


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of letter sequences: (texts, sequences) matrix, the sequences' vectors, and whether a text has letters."""
    codes, owner = [], []
    for t in texts:
        codes.append(np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32))
        owner.append(len(codes[-1]))
    code, owner = np.concatenate(codes), np.repeat(np.arange(len(texts)), owner)
    code = np.where(letters()[code], code, 0)
    keep = (code != 0) | np.concatenate([[True], code[:-1] != 0])
    keep |= np.concatenate([[True], owner[1:] != owner[:-1]])
    code, owner = code[keep], owner[keep]
    has = np.bincount(owner[code != 0], minlength=len(texts)) > 0
    known, dense = _dense(code)
    n = len(known)
    key = (dense[:-2].astype(np.int64) * n + dense[1:-1]) * n + dense[2:]
    key, owner = key[owner[2:] == owner[:-2]], owner[2:][owner[2:] == owner[:-2]]
    if n**3 <= 1 << 24:
        distinct = np.flatnonzero(np.bincount(key, minlength=1))
        place = np.zeros(n**3, np.int64)
        place[distinct] = np.arange(len(distinct))
        column = place[key]
    else:
        distinct, column = np.unique(key, return_inverse=True)
    width = len(distinct)
    counts = np.bincount(owner * width + column, minlength=len(texts) * width).reshape(len(texts), width)
    parts = zip(known[distinct // (n * n)].tolist(), known[distinct // n % n].tolist(), known[distinct % n].tolist())
    vectors = np.array([sequence_vector(*p) for p in parts], np.int8).reshape(width, WIDTH)
    return counts, vectors, has


def _dense(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the place of each code among them, without sorting."""
    seen = np.zeros(int(code.max()) + 1, np.int64)
    seen[code] = 1
    known = np.flatnonzero(seen)
    seen[known] = np.arange(len(known))
    return known, seen[code]


def slices(texts: list[str]):
    """Ranges of rows of about `BATCH_CHARS` characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BATCH_CHARS or i - start >= 255:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototype of each language of `docs` (`text`, `lang`); rows without either are left out."""
    prepare(docs.sparkSession)

    def bundle(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in slices(texts):
                counts, vectors, _ = sequences(texts[a:b])
                names = sorted(set(langs[a:b]))
                own = np.array([[x == y for y in langs[a:b]] for x in names], np.float32)
                for name, total in zip(names, (own @ counts.astype(np.float32)) @ vectors.astype(np.float32)):
                    sums[name] = sums.get(name, 0) + total.astype(np.float64)
        names = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))], ["lang", "v"]
        )

    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string"))
    parts = known.mapInArrow(bundle, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()  # a row per language
    return {r.lang: np.array([p.x for p in r.v]) for r in sorted(rows, key=lambda r: r.lang)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """(`doc_id`, `lang_pred`, `score`): nearest prototype and its cosine."""
    prepare(docs.sparkSession)
    names = list(prototypes)
    if names:
        matrix = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names], np.float32).T
    else:
        matrix = np.zeros((WIDTH, 0), np.float32)

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found, scores = [], []
            for a, b in slices(texts):
                if not names:
                    found += [NO_LANGUAGE] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                counts, vectors, has = sequences(texts[a:b])
                bundled = counts.astype(np.float32) @ vectors.astype(np.float32)
                cosine = (bundled @ matrix) / np.maximum(np.linalg.norm(bundled, axis=1), 1e-12)[:, None]
                best = cosine.argmax(axis=1)
                found += [names[i] if h else NO_LANGUAGE for i, h in zip(best, has)]
                scores += [min(1.0, max(0.0, float(c[i]))) if h else 0.0 for c, i, h in zip(cosine, best, has)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        compare, "doc_id long, lang_pred string, score double"
    )


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows that are not learned from; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict for all."""
    prototypes = learn(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, prototypes).withColumn("held_out", held_out(F.col("doc_id")))
