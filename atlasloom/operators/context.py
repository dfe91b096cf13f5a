"""Retrieved context as text (D3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..constants import CONTEXT_RULE, UNKNOWN_FILE


def group_context(hits: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """D3: one context text per query, chunks grouped by file.

    Files come in the order of their best hit and chunks in hit order. A query has at most top-k
    hits, so both groups are small by construction.
    """
    per_file = (
        hits.withColumn("file_path", F.coalesce("file_path", F.lit(UNKNOWN_FILE)))
        .groupBy(*keys, "file_path")
        .agg(
            F.min("rank").alias("best"),
            F.expr("listagg(text, '\\n\\n') WITHIN GROUP (ORDER BY rank)").alias("body"),
        )
        .withColumn("part", F.concat(F.lit("## File Path: "), "file_path", F.lit("\n\n"), "body"))
    )
    return per_file.groupBy(*keys).agg(
        F.concat(
            F.lit(CONTEXT_RULE), F.expr("listagg(part, '\\n\\n') WITHIN GROUP (ORDER BY best)")
        ).alias("context")
    )
