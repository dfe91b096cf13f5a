"""Batch embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..constants import EMBED_BATCH_SIZES, NO_VALID_TEXT_ERROR
from ..session import ensure_checkpoint_dir
from .scale import bounded_side

#: Characters whose words are held as objects at a time.
EMBED_CHARS = 1 << 20
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
_REGISTRY: dict[str, Callable[..., Embedder]] = {}


def register_embedder(name: str, factory: Callable[..., Embedder]) -> None:
    """Make an embedder available by name; the factory runs inside each task."""
    _REGISTRY[name] = factory


def hashing_embedder(dim: int = 256) -> Embedder:
    """Signed feature hashing of the words of a text, L2-normalised; needs no model and no network.

    The words of a batch are factorised, so each distinct word of it is hashed once; a batch of more than `EMBED_CHARS`
    characters is taken in parts, so that the words held at a time do not grow with the texts.
    """
    import pandas as pd

    def embed(texts: list[str]) -> np.ndarray:
        ends = np.cumsum([len(t) for t in texts])
        cuts = np.flatnonzero(np.diff(ends // EMBED_CHARS)) + 1 if len(texts) else []
        bounds = [0, *map(int, cuts), len(texts)]
        return np.concatenate([part(texts[a:b]) for a, b in zip(bounds, bounds[1:])])

    def part(texts: list[str]) -> np.ndarray:
        words = [t.split() for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        codes, distinct = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
        hashes = np.array(
            [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in distinct], dtype=np.int64
        )
        vectors = np.zeros((len(texts), dim))
        if len(rows):
            h = hashes[codes]
            sign = np.where((h // dim) % 2 == 0, 1.0, -1.0)
            flat = np.bincount(rows * dim + h % dim, weights=sign, minlength=len(texts) * dim)
            vectors = flat.reshape(len(texts), dim)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return vectors / np.where(norms == 0, 1.0, norms)

    return embed


register_embedder("hashing", hashing_embedder)


def _embed_batch(embedder: Embedder, texts: list[str | None], retries: int) -> tuple[list[list[float]], str | None]:
    """Vectors of one batch: blank texts give zero vectors, a failing batch gives empty ones."""
    valid = [i for i, t in enumerate(texts) if t and t.strip()]
    if not valid:
        return [[] for _ in texts], NO_VALID_TEXT_ERROR
    error = None
    for _ in range(retries + 1):
        try:
            found = embedder([texts[i] for i in valid])
            if len(found) != len(valid):
                raise ValueError(f"{len(found)} vectors for {len(valid)} texts")
            width = len(found[0])
            vectors: list = [[0.0] * width for _ in texts]
            for i, v in zip(valid, found):
                vectors[i] = v
            return vectors, None
        except Exception as e:  # the job goes on; the batch is reported
            error = f"{type(e).__name__}: {e}".removesuffix(": ")
    return [[] for _ in texts], error


def embed_chunks(
    chunks: DataFrame,
    embedder: str | Callable[..., Embedder] = "hashing",
    batch: int = EMBED_BATCH_SIZES["default"],
    text: str = "text",
    retries: int = 0,
    batch_column: str | None = None,
    **options,
) -> DataFrame:
    """Add `vector` and `embed_error` to every row, `batch` texts per call, without a shuffle.

    `batch_column` adds the number of the call that a row was part of. Vectors stay with the row they were computed for, so a short answer can never shift them.
    """
    factory = _REGISTRY[embedder] if isinstance(embedder, str) else embedder
    schema = T.StructType(
        [f for f in chunks.schema.fields if f.name not in ("vector", "embed_error")]
        + [
            T.StructField("vector", T.ArrayType(T.FloatType())),
            T.StructField("embed_error", T.StringType()),
        ]
    )
    kept = [f.name for f in schema.fields[:-2]]
    if batch_column:
        schema = schema.add(batch_column, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory(**options)
        calls = TaskContext.get().partitionId() << 40
        for record in batches:
            for start in range(0, record.num_rows, batch):
                part = record.slice(start, batch)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                vectors, error = _embed_batch(model, texts, retries)
                flat = np.concatenate([np.asarray(v, dtype=np.float32) for v in vectors]) if vectors else []
                offsets = np.cumsum([0] + [len(v) for v in vectors], dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.float32()))
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                errors = pa.array([error] * part.num_rows, type=pa.string())
                columns, names = [*columns, column, errors], [*kept, "vector", "embed_error"]
                if batch_column:
                    columns.append(pa.array([calls] * part.num_rows, type=pa.int64()))
                    names.append(batch_column)
                calls += 1
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return chunks.select(*kept).mapInArrow(run, schema)


def embed_with_cache(
    chunks: DataFrame, cache: DataFrame, model: str = "hashing", text: str = "text", **options
) -> tuple[DataFrame, DataFrame]:
    """Embed only texts that are not cached -> (chunks with vectors, cache with new rows).

    The key is the model and the content hash. Equal texts are embedded once, however many copies
    there are; rows that failed are not cached. The copies are joined back on the content hash,
    where AQE splits a hash that holds a large share of the chunks.
    """
    keyed = chunks.withColumn("text_hash", F.sha2(F.col(text), 256)).withColumn("model", F.lit(model))
    key = ["model", "text_hash"]
    ensure_checkpoint_dir(chunks.sparkSession)
    # Keys alone find what is missing; only texts of missing keys are shuffled, and embedded once for both results.
    missing = bounded_side(keyed.select(*key).distinct().join(cache.select(*key), key, "left_anti"))
    texts = keyed.join(missing, key, "left_semi").groupBy(*key).agg(F.min(text).alias(text))
    fresh = embed_chunks(texts, model, text=text, **options).checkpoint()
    known = cache.select(*key, "vector", F.lit(None).cast("string").alias("embed_error")).unionByName(
        fresh.select(*key, "vector", "embed_error")
    )
    embedded = (
        keyed.drop("vector", "embed_error").join(known, key, "left").drop(*key)
    )
    updated = cache.select(*key, "vector").unionByName(
        fresh.filter("embed_error IS NULL").select(*key, "vector")
    )
    return embedded, updated


def _length(vector: str) -> Column:
    return F.coalesce(F.greatest(F.size(vector), F.lit(0)), F.lit(0))


def embedding_stats(chunks: DataFrame, keys: Sequence[str] = ("repo_id",), vector: str = "vector") -> DataFrame:
    """Total, non-empty and empty vectors and the three smallest distinct lengths.

    Counts are first reduced to one row per (key, length).
    """
    per_length = (
        chunks.select(*keys, _length(vector).alias("dim"))
        .groupBy(*keys, "dim")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    smallest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("dim") == 0, "dim"))
    return (
        per_length.withColumn("rn", smallest)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("total"),
            F.sum(F.when(F.col("dim") > 0, F.col("n")).otherwise(0)).alias("non_empty"),
            F.sum(F.when(F.col("dim") == 0, F.col("n")).otherwise(0)).alias("empty"),
            F.array_sort(
                F.collect_list(F.when((F.col("dim") > 0) & (F.col("rn") <= 3), F.col("dim")))
            ).alias("sample_dims"),
        )
    )


def batch_stats(embedded: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Valid and empty vectors, failed batches and rows in them, total."""
    failed = F.col("embed_error").isNotNull()
    aggregates = [
        F.count_if(F.size("vector") > 0).alias("valid"),
        F.count_if(~F.coalesce(F.size("vector") > 0, F.lit(False))).alias("empty"),
        F.count_if(failed).alias("failed_rows"),
        F.count(F.lit(1)).alias("total"),
    ]
    if "batch_no" in embedded.columns:
        per_batch = embedded.groupBy(*keys, "batch_no").agg(*aggregates)
        return per_batch.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in ("valid", "empty", "failed_rows", "total")],
            F.count_if(F.col("failed_rows") > 0).alias("error_batches"),
        )
    return embedded.groupBy(*keys).agg(*aggregates)


def filter_first_dim(
    chunks: DataFrame, keys: Sequence[str] = ("repo_id",), order: str = "doc_ord", vector: str = "vector"
) -> DataFrame:
    """The first non-empty vector of each key fixes the length; others are dropped."""
    first = (
        chunks.filter(F.size(vector) > 0)
        .groupBy(*keys)
        .agg(F.min_by(F.size(vector), order).alias("__dim"))
    )
    return (
        chunks.join(bounded_side(first), list(keys)).filter(F.size(vector) == F.col("__dim")).drop("__dim")
    )


def normalise_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The vectors in an embedding response, one row each with its `index`.

    Accepted: a flat vector or a list of vectors under `embedding` / `embeddings`, a list of
    objects that hold one, and vectors under `embeddings.float`. Empty vectors are dropped.
    """
    def as_json(path: str):
        return F.get_json_object(F.col(payload), path)

    value = F.coalesce(as_json("$.embedding"), as_json("$.embeddings.float"), as_json("$.embeddings"))
    flat, nested = r"\A\s*\[\s*-?\d", r"\A\s*\[\s*\["
    vectors = (
        F.when(value.rlike(flat), F.array(F.from_json(value, "array<double>")))
        .when(value.rlike(nested), F.from_json(value, "array<array<double>>"))
        .otherwise(
            F.transform(
                F.from_json(value, "array<struct<embedding: array<double>, embeddings: array<double>>>"),
                lambda x: F.coalesce(x["embedding"], x["embeddings"]),
            )
        )
    )
    kept = F.filter(vectors, lambda v: F.size(v) > 0)
    others = [c for c in df.columns if c != payload]
    return df.select(*others, F.posexplode(kept).alias("index", "vector"))
