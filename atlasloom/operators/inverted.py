"""Approximate retrieval with proven recall: an inverted file over coarse centroids.

Vectors of a repository are assigned to the nearest of about half the square root of their number of centroids, which are
learned on a bounded sample. A list knows its radius, the widest angle between its centroid and a member. By the
triangle inequality on the sphere no member of a list is nearer to a query than the angle to the centroid less the
radius, so a list can be left out for certain once enough better chunks are known.

A query first scores the lists whose centroids are nearest, until they hold `k` chunks or more. The score of its k-th best
is its threshold: of the other lists it visits those that could still reach it. With `slack = 0` the result is that of
`retrieve`; with a positive slack (radians) lists that reach the threshold only by that much are left out as well. Vectors
without structure leave nothing out, and then `retrieve` is the cheaper way to the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import TOP_K
from ..session import ensure_checkpoint_dir
from .retrieval import QUERIES_PER_TASK, _groups, _matrix, _scored, _unit, lookup_hits, modal_dims, top_k
from .scale import bounded_side

SAMPLE_ROWS = 65_536
SAMPLE_PER_LIST = 32
MOST_LISTS = 8_192
ROUNDS = 6
NEAREST = 2
PORTION_BYTES = 16 << 20
_SAFE = 2e-6

MEMBERS = "repo_id string, id string, vector array<float>, code bigint, angle double"
DIRECTORY = "repo_id string, dim int, lists int, centroids binary"


@dataclass
class InvertedFile:
    """`members`: every vector with the number of its list (`code`); `directory`: per repository its centroids
    (`lists` x `dim` floats), and for each list its number of vectors and its radius."""

    members: DataFrame
    directory: DataFrame

    def save(self, folder: str) -> None:
        """Members are sorted by list, so that a reader of few lists skips most of the files."""
        self.members.repartitionByRange("repo_id", "code").sortWithinPartitions("repo_id", "code").write.parquet(f"{folder}/members")
        self.directory.write.parquet(f"{folder}/directory")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> InvertedFile:
        return InvertedFile(spark.read.parquet(f"{folder}/members"), spark.read.parquet(f"{folder}/directory"))


def learn(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; a centroid without members moves to the worst placed vector."""
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.zeros((0, x.shape[1]))
    centroids = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        best, near = np.zeros(len(x), int), np.zeros(len(x))
        for lo in range(0, len(x), 4096):
            s = x[lo : lo + 4096] @ centroids.T
            best[lo : lo + 4096] = s.argmax(axis=1)
            near[lo : lo + 4096] = s.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, best, x)
        empty = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-12)
        sums[empty] = x[np.argsort(near, kind="stable")[: len(empty)]]
        centroids = _unit(sums)
    return centroids


def _centroids(vectors: DataFrame, counts: DataFrame) -> DataFrame:
    """Learned centroids of every repository, from a sample chosen by a hash of the id."""
    lists = F.least(F.lit(MOST_LISTS), F.ceil(F.sqrt("n") / 2)).cast("int")
    wanted = F.least(F.lit(SAMPLE_ROWS), SAMPLE_PER_LIST * F.col("lists"))
    plans = counts.withColumn("lists", lists).withColumn("every", F.greatest(F.lit(1), F.floor(F.col("n") / wanted)))
    sample = vectors.join(plans.drop("n"), ["repo_id", "dim"]).filter(F.pmod(F.xxhash64("id"), "every") == 0)

    def train(table: pa.Table) -> pa.Table:
        repo, dim, n = (table.column(c)[0].as_py() for c in ("repo_id", "dim", "lists"))
        table = table.sort_by("id").combine_chunks()
        x = _matrix(table.column("vector").chunk(0), np.arange(len(table)), dim).astype(np.float64)
        found = learn(_unit(x), n).astype(np.float32)
        return pa.table({"repo_id": [repo], "dim": pa.array([dim], pa.int32()), "lists": pa.array([len(found)], pa.int32()), "centroids": [found.tobytes()]})

    return sample.select("repo_id", "dim", "lists", "id", "vector").groupBy("repo_id", "dim").applyInArrow(train, DIRECTORY)


def _portions(directory: DataFrame, portion_bytes: int) -> Iterator[tuple[DataFrame, list]]:
    """The repositories in portions whose directories can be held by every task: (rows of the portion, collected)."""
    total = directory.agg(F.coalesce(F.sum(F.octet_length("centroids")), F.lit(0))).first()[0]
    parts = max(1, -(-total // portion_bytes))
    for i in range(parts):
        own = directory.filter(F.pmod(F.xxhash64("repo_id"), F.lit(parts)) == i) if parts > 1 else directory
        rows = list(own.toLocalIterator())
        if rows:
            yield own, rows


def build_lists(chunks: DataFrame, vector: str = "vector", order: str = "doc_ord", portion_bytes: int = PORTION_BYTES) -> InvertedFile:
    """Index the vectors of the modal length of each repository (D1). All vectors are assigned, the sample only sets centroids."""
    spark = chunks.sparkSession
    ensure_checkpoint_dir(spark)
    dims = bounded_side(modal_dims(chunks, vector, order))
    vectors = chunks.select(
        F.col("repo_id").cast("string").alias("repo_id"), F.col("chunk_id").cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"),
        F.size(vector).alias("dim"),
    ).join(dims, ["repo_id", "dim"], "left_semi")
    counts = bounded_side(vectors.groupBy("repo_id", "dim").agg(F.count(F.lit(1)).alias("n")))
    centroids = _centroids(vectors, counts).checkpoint()
    members = None
    for _, rows in _portions(centroids, portion_bytes):
        known = {(r.repo_id, r.dim): np.frombuffer(bytes(r.centroids), np.float32).reshape(-1, r.dim) for r in rows}
        shared = spark.sparkContext.broadcast(known)

        def assign(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for record in batches:
                if not record.num_rows:
                    continue
                repo_codes = record.column(0).dictionary_encode()
                repos, vectors = repo_codes.dictionary.to_pylist(), record.column(2)
                code, angle, kept = np.zeros(record.num_rows, np.int64), np.zeros(record.num_rows), np.zeros(record.num_rows, bool)
                for group, part in _groups(repo_codes.indices.to_numpy().astype(np.int64) * (1 << 32) + np.diff(vectors.offsets.to_numpy())):
                    repo, dim = repos[group >> 32], int(group & 0xFFFFFFFF)
                    if (repo, dim) not in shared.value:
                        continue
                    centres = shared.value[repo, dim].astype(np.float64)
                    x = _unit(_matrix(vectors, part, dim).astype(np.float64))
                    kept[part] = True
                    zero = ~x.any(axis=1)
                    if len(centres):
                        s = x @ _unit(centres).T
                        code[part], angle[part] = s.argmax(axis=1), np.arccos(np.clip(s.max(axis=1), -1, 1))
                    code[part[zero]], angle[part[zero]] = len(centres), np.pi  # no direction: a list of their own that is always visited
                keep = pa.array(kept)
                yield pa.RecordBatch.from_arrays([record.column(0), record.column(1), vectors, pa.array(code), pa.array(angle)], names=["repo_id", "id", "vector", "code", "angle"]).filter(keep)

        some = vectors.select("repo_id", "id", "vector").mapInArrow(assign, MEMBERS)
        members = some if members is None else members.unionByName(some)
    if members is None:
        members = spark.createDataFrame([], MEMBERS)
    members = members.checkpoint()
    lists = members.groupBy("repo_id", "code").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    lists = lists.groupBy("repo_id").agg(F.collect_list(F.struct("code", "n", "radius")).alias("sizes"))  # at most MOST_LISTS + 1
    return InvertedFile(members.drop("angle"), centroids.join(lists, "repo_id").checkpoint())


def _visits(queries: DataFrame, rows: list, k: int, nearest: int, slack: float) -> DataFrame:
    """Every list that a query could visit: with the best score possible there, and whether it is among the first."""
    known = {}
    for r in rows:
        n, radius = np.zeros(r.lists + 1, np.int64), np.zeros(r.lists + 1)
        for size in r.sizes:
            n[size.code], radius[size.code] = size.n, size.radius
        centres = _unit(np.frombuffer(bytes(r.centroids), np.float32).reshape(-1, r.dim).astype(np.float64))
        known[r.repo_id, r.dim] = np.concatenate([centres, np.zeros((1, r.dim))]), n, radius
    shared = queries.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for i, (repo, vector) in enumerate(zip(record.column(0).to_pylist(), record.column(2).to_pylist())):
                if (repo, len(vector)) not in shared.value:
                    continue
                centres, n, radius = shared.value[repo, len(vector)]
                q = np.asarray(vector, np.float64)
                size = np.linalg.norm(q)
                away = np.arccos(np.clip(centres @ (q / size), -1, 1)) if size else np.zeros(len(n))
                order = np.argsort(away, kind="stable")
                order = order[n[order] > 0]
                before = np.cumsum(n[order]) - n[order]
                first = (before < k) | (np.arange(len(order)) < nearest)
                bound = np.cos(np.clip(away[order] - radius[order] + slack, 0, np.pi)) + _SAFE
                take = pa.array(np.full(len(order), i))
                yield pa.RecordBatch.from_arrays(
                    [record.column(0).take(take), record.column(1).take(take), record.column(2).take(take), pa.array(order), pa.array(bound), pa.array(first)],
                    names=["repo_id", "id", "vector", "code", "bound", "first"],
                )

    return queries.select("repo_id", "id", "vector").mapInArrow(run, "repo_id string, id string, vector array<float>, code bigint, bound double, first boolean")


def retrieve_lists(
    queries: DataFrame, index: InvertedFile, k: int = TOP_K, query_vector: str = "vector", nearest: int = NEAREST, slack: float = 0.0,
    per_task: int = QUERIES_PER_TASK, portion_bytes: int = PORTION_BYTES,
) -> DataFrame:
    """The best `k` chunks of each query through the lists that it has to visit -> (`repo_id, query_id, chunk_id, score, rank`)."""
    asked = queries.filter(F.size(query_vector) > 0).select(
        F.col("repo_id").cast("string").alias("repo_id"), F.col("query_id").cast("string").alias("id"), F.col(query_vector).cast("array<float>").alias("vector")
    )
    found = None
    for _, rows in _portions(index.directory, portion_bytes):
        visits = _visits(asked, rows, k, nearest, slack).checkpoint()
        first = top_k(_scored(visits.filter("first").drop("bound", "first"), index.members, k, per_task), k).checkpoint()
        enough = first.filter(F.col("rank") == k).select("repo_id", F.col("query_id").alias("id"), F.col("score").alias("least"))
        more = visits.filter("NOT first").join(enough, ["repo_id", "id"], "left").filter("least IS NULL OR bound >= least")
        rest = _scored(more.select("repo_id", "id", "vector", "code"), index.members, k, per_task)
        both = first.drop("rank").unionByName(rest)
        found = both if found is None else found.unionByName(both)
    if found is None:
        found = queries.sparkSession.createDataFrame([], "repo_id string, query_id string, chunk_id string, score double")
    return top_k(found, k)


def retrieve_ann(
    queries: DataFrame, chunks: DataFrame, k: int = TOP_K, columns: Sequence[str] = (), query_vector: str = "vector",
    vector: str = "vector", order: str = "doc_ord", **options,
) -> DataFrame:
    """As `retrieve`, through an inverted file that is built for the call. A stored index (`build_lists`, `save`) serves many calls."""
    hits = retrieve_lists(queries, build_lists(chunks, vector, order), k, query_vector, **options)
    return lookup_hits(hits, chunks, columns) if columns else hits
