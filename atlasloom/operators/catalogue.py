"""Project catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.urls import CACHE_PREFIX, parse_cache_key


def projects_from_files(files: DataFrame, prefix: str = CACHE_PREFIX, *more: str) -> DataFrame:
    """Catalogue rows from stored names and times (`file_name, modified`); the columns `more` are kept."""
    parsed = parse_cache_key(F.col("file_name"), prefix)
    return (
        files.withColumn("k", parsed)
        .filter("k IS NOT NULL")
        .select(
            F.col("file_name").alias("id"), "k.owner", "k.repo",
            F.concat_ws("/", "k.owner", "k.repo").alias("name"), "k.repo_type",
            F.unix_millis("modified").alias("submittedAt"), "k.language", *more,
        )
    )


def newest_first(projects: DataFrame) -> DataFrame:
    """a distributed sort by time."""
    return projects.orderBy(F.desc("submittedAt"), "id")


def cap(df: DataFrame, n: int | None) -> DataFrame:
    """the first `n` rows; no cap where `n` is empty or zero."""
    return df.limit(n) if n else df


def search_projects(projects: DataFrame, query: str, max_items: int | None = None) -> DataFrame:
    """Case-insensitive search in four fields, newest first, capped after filtering."""
    if query.strip():
        needle = query.lower()
        hit = F.lit(False)
        for field in ("name", "owner", "repo", "repo_type"):
            hit = hit | F.lower(field).contains(needle)
        projects = projects.filter(hit)
    return cap(newest_first(projects), max_items)


def remove_projects(projects: DataFrame, keys: DataFrame) -> DataFrame:
    """The list without deleted projects (`id`)."""
    return projects.join(keys.select("id").distinct(), "id", "left_anti")
