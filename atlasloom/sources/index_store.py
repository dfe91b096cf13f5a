"""The stored chunk index (A7, A8): builds are appended, the newest build of a repository counts."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.scale import bounded_side
from ..session import ensure_checkpoint_dir

FEW_FILES = 10_000
FILES = "file string, repo_id string, n_chunks long, dim int, build_id string"
BUILDS = "repo_id string, config_hash string, build_id string, n_chunks long, dim int"


def config_hash(config: dict) -> str:
    """Identity of the settings an index was built with."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def new_build() -> str:
    """An id that sorts by time."""
    return f"b{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"


def _folder(build: str) -> str:
    return f"chunks/build_id={build}"


def _register(spark: SparkSession, path: str, build: str) -> DataFrame:
    """Append to the manifest which files of a build hold chunks of which repository, and how many; the rows are returned."""
    target = f"{path}/files/build_id={build}"
    rows = spark.read.parquet(f"{path}/{_folder(build)}").groupBy(F.col("_metadata.file_name").alias("file"), "repo_id")
    rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.max("dim").alias("dim")).write.parquet(target)
    return spark.read.schema(FILES.removesuffix(", build_id string")).parquet(target)


def write_index(chunks: DataFrame, path: str, config: dict | None = None, repos: DataFrame | None = None) -> None:
    """Append a build of the repositories in `chunks`; nothing that is stored is read or rewritten.

    A build is one folder of chunk rows, sorted by repository inside a file, and one row per repository in `builds`,
    written last: what has no row there is not seen. `repos` names repositories that were built but may have no
    chunk, so that they are not built again each time. `dim` lets vector checks run without reading vectors.
    """
    spark, build, settings = chunks.sparkSession, new_build(), config_hash(config or {})
    folder = f"{path}/{_folder(build)}"
    dim = F.coalesce(F.greatest(F.size("vector"), F.lit(0)), F.lit(0))
    rows = chunks.withColumns({"dim": dim, "config_hash": F.lit(settings)})
    rows.hint("rebalance", "repo_id").sortWithinPartitions("repo_id", "doc_ord", "chunk_no").write.parquet(folder)
    counts = _register(spark, path, build).groupBy("repo_id").agg(F.sum("n_chunks").alias("n_chunks"), F.max("dim").alias("dim"))
    if repos is not None:
        counts = repos.select("repo_id").distinct().join(counts, "repo_id", "left")
    counts.select(
        "repo_id", F.lit(settings).alias("config_hash"), F.lit(build).alias("build_id"),
        F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), F.coalesce("dim", F.lit(0)).cast("int").alias("dim"),
    ).write.mode("append").parquet(f"{path}/builds")


def newest_builds(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored repository: its newest build."""
    builds = spark.read.schema(BUILDS).parquet(f"{path}/builds")
    newest = F.max(F.struct("build_id", "config_hash", "n_chunks", "dim")).alias("b")
    return builds.groupBy("repo_id").agg(newest).select("repo_id", "b.*")


def files_of(spark: SparkSession, path: str, repos: DataFrame, newest: DataFrame) -> list[str] | None:
    """Files with chunks of the repositories asked for; None if they are many or the index has no manifest."""
    try:
        manifest = spark.read.schema(FILES).parquet(f"{path}/files")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    wanted = newest.join(bounded_side(repos.select("repo_id").distinct()), "repo_id", "left_semi")
    files = manifest.join(bounded_side(wanted), ["repo_id", "build_id"], "left_semi").select("build_id", "file").distinct()
    names = [f"{path}/{_folder(r.build_id)}/{r.file}" for r in files.limit(FEW_FILES + 1).collect()]
    return names if len(names) <= FEW_FILES else None


def read_index(spark: SparkSession, path: str, repos: DataFrame | None = None) -> DataFrame:
    """Chunks of the newest build of each repository, or of those in `repos`, for which only their files are opened."""
    ensure_checkpoint_dir(spark)
    newest = bounded_side(newest_builds(spark, path).select("repo_id", "build_id"))
    names = None if repos is None else files_of(spark, path, repos, newest)
    if names is not None:
        chunks = spark.read.option("basePath", f"{path}/chunks").parquet(*names or [f"{path}/chunks"])
        chunks = chunks if names else chunks.limit(0)
    else:
        chunks = spark.read.parquet(f"{path}/chunks")
    if repos is not None:
        newest = bounded_side(newest.join(repos.select("repo_id").distinct(), "repo_id", "left_semi"))
    return chunks.join(newest, ["repo_id", "build_id"], "left_semi").drop("build_id")


def compact_index(spark: SparkSession, path: str, target: str) -> None:
    """The newest builds as a single build in a new place; settings stay those of each repository."""
    for row in newest_builds(spark, path).select("config_hash").distinct().collect():  # a row per kind of settings
        same = newest_builds(spark, path).filter(F.col("config_hash") == row.config_hash)
        build = new_build()
        rows = spark.read.parquet(f"{path}/chunks").join(bounded_side(same.select("repo_id", "build_id")), ["repo_id", "build_id"], "left_semi")
        rows.drop("build_id").hint("rebalance", "repo_id").sortWithinPartitions("repo_id", "doc_ord", "chunk_no").write.parquet(
            f"{target}/{_folder(build)}"
        )
        _register(spark, target, build)
        same.withColumn("build_id", F.lit(build)).select("repo_id", "config_hash", "build_id", "n_chunks", "dim").write.mode(
            "append"
        ).parquet(f"{target}/builds")


def reusable_repos(builds: DataFrame, config: dict | None = None) -> DataFrame:
    """Repositories whose newest build has the same settings and a usable vector, or no chunk at all."""
    same = F.col("config_hash") == config_hash(config or {})
    return builds.filter(same & ((F.col("dim") > 0) | (F.col("n_chunks") == 0))).select("repo_id")


def load_or_build_index(
    spark: SparkSession,
    path: str,
    docs: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    config: dict | None = None,
    repos: DataFrame | None = None,
) -> DataFrame:
    """Read-through. Repositories of `docs` without a usable stored index are built and appended.

    `repos` names the repositories where they are known, so that `docs` is only read for what has to be built.

    Each repository keeps the settings it was built with, so changed settings lead to a rebuild of what is asked
    for and of nothing else. A missing index is built; one that cannot be read is an error.
    """
    ensure_checkpoint_dir(spark)
    asked = (docs if repos is None else repos).select("repo_id").distinct().checkpoint()
    try:
        missing = asked.join(reusable_repos(newest_builds(spark, path), config), "repo_id", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        missing = asked
    missing = bounded_side(missing)
    if not missing.isEmpty():
        write_index(build(docs.join(missing, "repo_id", "left_semi")), path, config, missing)
    return read_index(spark, path, asked)
