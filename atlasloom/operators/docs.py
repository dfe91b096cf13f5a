"""Documents and chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    CHUNK_OVERLAP, CHUNK_WORDS, CODE_SUFFIXES, CODE_TOKEN_LIMIT, DOC_SUFFIXES, DOC_TOKEN_LIMIT,
)
from ..functions.text import chunk_texts, count_tokens
from .scale import sorted_index


def _suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)\z", 1)


def all_documents(
    files: DataFrame,
    code_ext: Sequence[str] = CODE_SUFFIXES,
    doc_ext: Sequence[str] = DOC_SUFFIXES,
) -> DataFrame:
    """G1: code files and document files in one pass, told apart by `is_code`."""
    code, docs = [e[1:] for e in code_ext], [e[1:] for e in doc_ext]
    return (
        files.withColumn("type", _suffix(F.col("file_path")))
        .filter(F.col("type").isin(*code, *docs))
        .withColumn("is_code", F.col("type").isin(*code))
    )


def derive_doc_columns(files: DataFrame, counter: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """Type, title, code and implementation flags, token count."""
    path = F.col("file_path")
    return all_documents(files).withColumns(
        {
            "is_implementation": F.col("is_code")
            & ~F.startswith(path, F.lit("test_"))
            & ~F.startswith(path, F.lit("app_"))
            & ~F.lower(path).contains("test"),
            "title": path,
            "token_count": counter(F.col("text")),
        }
    )


def drop_oversized(docs: DataFrame) -> DataFrame:
    """Over-long files are left out of the index."""
    limit = F.when(F.col("is_code"), F.lit(CODE_TOKEN_LIMIT)).otherwise(F.lit(DOC_TOKEN_LIMIT))
    return docs.filter(F.col("token_count") <= limit)


def chunk_words(docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """H3: overlapping word windows of every document; a narrow generator, no shuffle."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select(
        *others, F.posexplode(chunk_texts(F.col("text"), size, overlap)).alias("chunk_no", "text")
    ).withColumn("chunk_id", F.concat_ws("#", "repo_id", "file_path", "chunk_no"))


def count_by_repo(docs: DataFrame) -> DataFrame:
    """Rows per repository."""
    return docs.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_docs"))


def assign_batches(
    chunks: DataFrame, n: int, keys: Sequence[str] = (), order: Sequence[str] = ("doc_ord", "chunk_no")
) -> DataFrame:
    """Consecutive batches of `n` rows in order. Positions come from even slices, whatever the keys and order values hold."""
    return (
        sorted_index(chunks, keys, order, "__pos")
        .withColumn("batch_no", F.floor(F.col("__pos") / n).cast("bigint"))
        .drop("__pos")
    )
