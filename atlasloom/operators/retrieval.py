"""Vector checks and top-k retrieval."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..constants import TOP_K
from ..session import ensure_checkpoint_dir
from .bloom import key_filter
from .scale import BROADCAST_BYTES, bounded_side, stored_side

BLOCK_ROWS = 1024
QUERIES_PER_TASK = 2_000
HELD_ROWS = 500_000
BLOCK_CELLS = 2_000_000
REPOSITORIES = 500
_BLOCK = "repo_id string, dim int, code bigint, ids array<string>, matrix binary"


def _dim(chunks: DataFrame, vector: str):
    """Vector length; a stored index has it as a column, so no vector is read for it."""
    return F.col("dim") if "dim" in chunks.columns else F.size(vector)


def modal_dims(chunks: DataFrame, vector: str = "vector", order: str = "doc_ord") -> DataFrame:
    """Most frequent vector length per repository; on a tie the length seen first.

    Only one row per (repository, length) leaves each task.
    """
    per_dim = (
        chunks.select("repo_id", order, _dim(chunks, vector).alias("dim"))
        .filter("dim > 0")
        .groupBy("repo_id", "dim")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_ord"))
    )
    best = F.struct("n", (-F.col("first_ord")).alias("earlier"))
    return per_dim.groupBy("repo_id").agg(F.max_by("dim", best).alias("dim"))


def filter_modal_dim(chunks: DataFrame, vector: str = "vector", order: str = "doc_ord") -> DataFrame:
    """Keep vectors of the repository's modal length."""
    dims = bounded_side(modal_dims(chunks, vector, order))
    return chunks.join(dims, "repo_id").filter(F.size(vector) == F.col("dim")).drop("dim")


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _groups(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Row positions of each distinct code."""
    order = np.argsort(codes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        yield int(codes[part[0]]), part


def _matrix(vectors: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    starts = vectors.offsets.to_numpy()[:-1][rows]
    return vectors.values.to_numpy(zero_copy_only=False)[starts[:, None] + np.arange(dim)[None, :]]


def _pack(df: DataFrame) -> DataFrame:
    """Vectors of a task (`repo_id, id, vector, code`) as matrix rows of at most `BLOCK_ROWS` vectors.

    A block holds vectors of one repository, length and code. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            if not record.num_rows:
                continue
            repo_codes = record.column(0).dictionary_encode()
            repos = repo_codes.dictionary.to_pylist()
            ids, vectors = record.column(1).to_numpy(zero_copy_only=False), record.column(2)
            lengths, codes = np.diff(vectors.offsets.to_numpy()), record.column(3).to_numpy()
            key = repo_codes.indices.to_numpy().astype(np.int64) * (1 << 32) + lengths
            rows: list[tuple] = []
            for group, members in _groups(key):
                repo, dim = repos[group >> 32], group & 0xFFFFFFFF
                for code, part in _groups(codes[members]):
                    for start in range(0, len(part), BLOCK_ROWS):
                        take = members[part[start : start + BLOCK_ROWS]]
                        matrix = _matrix(vectors, take, dim).astype(np.float32)
                        rows.append((repo, int(dim), code, list(ids[take]), matrix.tobytes()))
                        if len(rows) >= 256:
                            yield _block_batch(rows)
                            rows = []
            if rows:
                yield _block_batch(rows)

    return df.select("repo_id", "id", "vector", "code").mapInArrow(run, _BLOCK)


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.binary()]
    names = ["repo_id", "dim", "code", "ids", "matrix"]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(col), type=t) for col, t in zip(zip(*rows), types)], names=names
    )


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.filter(F.size(vector) > 0).select(
        F.col("repo_id").cast("string").alias("repo_id"), F.col(key).cast("string").alias("id"),
        F.col(vector).cast("array<float>").alias("vector"), F.lit(0).cast("bigint").alias("code"),
    )


class _Best:
    """Best `k` hits per query seen so far in one task, ordered by (-score, chunk)."""

    def __init__(self, k: int):
        self.k, self.size = k, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, repo: str, queries: np.ndarray, chunks: np.ndarray, scores: np.ndarray) -> None:
        """Scores of queries (rows) against chunks (columns); what cannot be among the best is left out at once."""
        if scores.shape[1] > self.k:
            floor = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            row, col = np.nonzero(scores >= floor[:, None])
        else:
            row, col = np.indices(scores.shape).reshape(2, -1)
        self.parts.append((np.full(len(row), repo, object), queries[row], chunks[col], scores[row, col]))
        self.size += len(row)
        if self.size > HELD_ROWS:
            self.reduce()

    def reduce(self) -> None:
        if not self.parts:
            return
        repo, query, chunk, score = map(np.concatenate, zip(*self.parts))
        key = np.zeros(len(repo), np.int64)
        for names in (repo, query):
            codes = np.unique(names, return_inverse=True)[1]
            key = key * (int(codes.max()) + 1) + codes
        name = np.unique(chunk, return_inverse=True)[1]
        order = np.lexsort((name, -score, key))
        key, name = key[order], name[order]
        again = np.zeros(len(order), bool)
        again[1:] = (key[1:] == key[:-1]) & (name[1:] == name[:-1])
        order, key = order[~again], key[~again]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        place = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        order = order[place < self.k]
        self.parts, self.size = [(repo[order], query[order], chunk[order], score[order])], len(order)

    def drain(self) -> Iterator[pa.RecordBatch]:
        self.reduce()
        for repo, query, chunk, score in self.parts:
            for lo in range(0, len(repo), 50_000):
                hi = lo + 50_000
                yield pa.RecordBatch.from_arrays(
                    [pa.array(repo[lo:hi], pa.string()), pa.array(query[lo:hi], pa.string()), pa.array(chunk[lo:hi], pa.string()), pa.array(score[lo:hi])],
                    names=["repo_id", "query_id", "chunk_id", "score"],
                )
        self.parts, self.size = [], 0

    def spill(self) -> Iterator[pa.RecordBatch]:
        """Hand on what is held once even the best rows are many."""
        if self.size > HELD_ROWS // 2:
            self.reduce()
            if self.size > HELD_ROWS // 2:
                yield from self.drain()


_HITS = "repo_id string, query_id string, chunk_id string, score double"


def _cosines(query_unit: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return np.round(query_unit @ _unit(matrix.astype(np.float64)).T, 6) + 0.0


def _known_queries(queries: DataFrame, max_bytes: int) -> dict | None:
    """Stored query vectors by (repository, length, code), if all of them are small enough for every task to hold."""
    size = queries.agg(F.coalesce(F.sum(4 * F.size("vector") + F.octet_length("id") + 64), F.lit(0))).first()[0]
    if size > max_bytes:
        return None
    found: dict = {}
    rows = queries.select("repo_id", "code", F.size("vector").alias("dim"), "id", "vector").toArrow()
    for repo, code, dim, name, vector in zip(*(rows.column(c).to_pylist() for c in rows.column_names)):
        names, vectors = found.setdefault((repo, dim, code), ([], []))
        names.append(name)
        vectors.append(vector)
    return {k: (np.array(names, object), _unit(np.array(v, np.float32).astype(np.float64))) for k, (names, v) in found.items()}


def _score_rows(known: dict, vectors: DataFrame, k: int) -> DataFrame:
    """Cosine of chunks (`repo_id, id, vector, code`) with the queries of their key, which every task holds once."""
    shared = vectors.sparkSession.sparkContext.broadcast(known)
    repos = sorted({repo for repo, _, _ in known})
    if len(repos) <= REPOSITORIES:  # chunks of repositories that nobody asks are not even read
        vectors = vectors.filter(F.col("repo_id").isin(repos))
    codes = sorted({(repo, code) for repo, _, code in known})
    if len(codes) > len(repos):  # as many rows as the queries that were measured, at most
        asked = vectors.sparkSession.createDataFrame(codes, "repo_id string, code bigint")
        vectors = vectors.join(F.broadcast(asked), ["repo_id", "code"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, queries = _Best(k), shared.value
        for record in batches:
            if not record.num_rows:
                continue
            repo_codes = record.column(0).dictionary_encode()
            repos = repo_codes.dictionary.to_pylist()
            ids, vectors, codes = record.column(1).to_numpy(zero_copy_only=False), record.column(2), record.column(3).to_numpy()
            for group, members in _groups(repo_codes.indices.to_numpy().astype(np.int64) * (1 << 32) + np.diff(vectors.offsets.to_numpy())):
                repo, dim = repos[group >> 32], group & 0xFFFFFFFF
                for code, part in _groups(codes[members]):
                    if (repo, dim, code) in queries:
                        names, unit = queries[repo, dim, code]
                        take = members[part]
                        x = _matrix(vectors, take, dim)
                        step = max(1, BLOCK_CELLS // len(names))
                        for lo in range(0, len(take), step):
                            best.add(repo, names, ids[take[lo : lo + step]], _cosines(unit, x[lo : lo + step]))
            yield from best.spill()
        yield from best.drain()

    return vectors.select("repo_id", "id", "vector", "code").mapInArrow(run, _HITS)


def _score_blocks(query_blocks: DataFrame, chunk_blocks: DataFrame, k: int) -> DataFrame:
    """Cosine of every query block with every chunk block of its key, reduced to `k` per query and task."""
    on = ["repo_id", "dim", "code"]
    q = query_blocks.select(*on, F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    c = chunk_blocks.select(*on, F.col("ids").alias("c_ids"), F.col("matrix").alias("c_matrix"))
    pairs = c.join(q, on).select("repo_id", "dim", "q_ids", "q_matrix", "c_ids", "c_matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, last, query_unit = _Best(k), None, None
        for record in batches:
            repos, dims, q_ids, q_matrices, c_ids, c_matrices = record.columns
            for i in range(record.num_rows):
                dim, buffer = dims[i].as_py(), q_matrices[i].as_buffer()
                if last is None or not buffer.equals(last):
                    last = buffer
                    query_unit = _unit(np.frombuffer(buffer, np.float32).reshape(-1, dim).astype(np.float64))
                chunk_matrix = np.frombuffer(c_matrices[i].as_buffer(), np.float32).reshape(-1, dim)
                names = [ids[i].values.to_numpy(zero_copy_only=False) for ids in (q_ids, c_ids)]
                best.add(repos[i].as_py(), *names, _cosines(query_unit, chunk_matrix))
            yield from best.spill()
        yield from best.drain()

    return pairs.mapInArrow(run, _HITS)


def _scored(queries: DataFrame, vectors: DataFrame, k: int, per_task: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Queries that fit are sent to every task once; beyond that blocks of both sides are joined."""
    ensure_checkpoint_dir(queries.sparkSession)
    queries = queries.checkpoint()
    known = _known_queries(queries, max_bytes)
    return _score_blocks(_query_blocks(queries, per_task), _pack(vectors), k) if known is None else _score_rows(known, vectors, k)


def _fitting(queries: DataFrame, chunks: DataFrame, query_vector: str, vector: str, order: str) -> DataFrame:
    """Query vectors of the modal length of their repository.

    The length is matched on the small side, so the chunk side needs no join for it.
    """
    dims = modal_dims(chunks, vector, order)
    return _vectors(
        queries.join(dims, "repo_id").filter(F.size(query_vector) == F.col("dim")), "query_id", query_vector
    )


def _query_blocks(vectors: DataFrame, per_task: int) -> DataFrame:
    """Dense, measured blocks: a repository's queries are spread over as many tasks as its count asks for."""
    counts = bounded_side(vectors.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / per_task).alias("shares")))
    dealt = vectors.join(counts, "repo_id").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")))
    return bounded_side(_pack(dealt.repartition("repo_id", "share").drop("shares", "share")))


def score_pairs(
    queries: DataFrame, chunks: DataFrame, k: int = TOP_K, query_vector: str = "vector",
    vector: str = "vector", order: str = "doc_ord", per_task: int = QUERIES_PER_TASK,
) -> DataFrame:
    """Scored candidates of each query within its repository, `k` per query and task.

    Queries and chunks meet on the repository as matrix blocks, so a repository with a large share
    of the chunks is many independent rows, and no (query, chunk) pair is ever a row unless it is
    among the task's best. Queries that are measured small are sent to each task once; beyond that
    matrix blocks of both sides are shuffled and AQE splits the skewed ones.
    """
    fitting = _fitting(queries, chunks, query_vector, vector, order)
    return _scored(fitting, _vectors(chunks, "chunk_id", vector), k, per_task)


def top_k(scored: DataFrame, k: int = TOP_K, keys: Sequence[str] = ("repo_id", "query_id")) -> DataFrame:
    """Best `k` rows per key with their rank; each task sends at most `k` rows per key."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lookup_hits(hits: DataFrame, chunks: DataFrame, columns: Sequence[str] = ("file_path", "text"), max_rows: int | None = None) -> DataFrame:
    """Chunk columns of every hit, rank kept.

    Hits are broadcast only when measured small. Beyond that the chunk scan is cut down by a Bloom filter of the hits, so that
    only the texts of hits (and of about one other chunk in a thousand) are shuffled to the exact join.
    """
    wanted, on = chunks.select("repo_id", "chunk_id", *columns), ["repo_id", "chunk_id"]
    side, small = stored_side(hits, max_rows)
    if small:
        return wanted.join(F.broadcast(side), on)
    known = key_filter(side.select(*on), on)
    return wanted.filter(known(*on)).join(side, on)


def retrieve(
    queries: DataFrame, chunks: DataFrame, k: int = TOP_K, columns: Sequence[str] = ("file_path", "text"),
    query_vector: str = "vector", vector: str = "vector", order: str = "doc_ord",
) -> DataFrame:
    """Modal-length check, scoring, ranking and lookup for a whole table of queries (U3: `vector`)."""
    hits = top_k(score_pairs(queries, chunks, k, query_vector, vector, order), k)
    return lookup_hits(hits, chunks, columns) if columns else hits
