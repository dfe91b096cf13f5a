"""Corpus pipeline: documents through five stages, each of which calls one operator of `atlasloom.llm`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's documents. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import os
import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from atlasloom.llm import decontaminate, nearcopies, pii, queries, toxicity  # noqa: E402
from atlasloom.llm.common import delete_folder, prepare, table  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that are predicted toxic go. It learns from `labels`, outside the held-out fold."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of linked fingerprints or near copies stays, that with the smallest doc_id."""
    return nearcopies.keep_one_of_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents with a word inside a `benchmark` window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every document stays; personal data in its text becomes a tag, and `n_chars` is counted anew."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: every document left is packed; one row per piece, as `op10_sum_of_squares` returns it."""
    return queries.packed_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", without_personal_data),
    ("packing", pack),
]

#: Learned scores, hash bit votes and packing are not expressible in SQL; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    prepare(spark)
    folder = os.path.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
