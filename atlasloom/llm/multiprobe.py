"""Operator 11: approximate nearest neighbours by multiprobe p-stable hashing.

The largest inner product becomes the smallest Euclidean distance: a vector gets one more place that brings all of them to
the norm of the longest, a query is scaled to that norm. A table cuts `k` Gaussian (2-stable) projections into cells of one
width; the cells of a vector are its bucket. A query visits perturbed buckets in the order of their estimated success: how a
neighbour's projection lies around the query's is fitted on a sample, so each cell has a probability and a bucket
the product. A best-first walk lists buckets in falling order without building them all.

Buckets meet their visitors in slices of bounded size: rows and visitors are shuffled by slice, scored there in
blocks in double precision on the original vectors. A first look at each query's two likeliest buckets finds `k` candidates; what is worse
than these, or not among the best `k` of a task, never leaves a task. Candidates of all tables are merged per query.
Queries that find fewer than `k` candidates are scored against all rows through one bucket, so no list is short.

Fitted on bounded samples: at most about `SAMPLE_QUERIES` queries, answered exactly in one pass over all rows, set cell width,
order and number of probes so that `GOAL` of their neighbours are met; about `SAMPLE_ROWS` rows set the number of
projections. All rows are indexed, all buckets kept whole. Vectors without structure leave little to skip: there
the recall asked for costs most of the rows.

Vectors that are null, empty, zero or hold null or non-finite places take no part, nor do rows without id. Lengths are
indexed apart (a job each): a query meets vectors of its own length. Rows with the same id and vector count once; if an id
has several vectors, the best score of each pair of ids counts. Equal vectors: the `k` + 1 smallest ids are indexed, more
can never be among the first `k`. Ties go to the smaller id. Empty table: no rows. One row: no candidates, no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, erf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.scale import bounded_side
from .common import prepare

TABLES = 2
GOAL = 0.95
SAMPLE_QUERIES = 64
SAMPLE_ROWS = 2048
BUCKET_ROWS = 1024
SLICE_ROWS = 4096
MOST_PROJECTIONS = 32
MOST_PROBES = 4096
LOOK_PROBES = 2
BLOCK = 4_000_000
HELD = 1_000_000

_erf = np.vectorize(erf, otypes=[float])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(rows: DataFrame, vector_id: str, vector: str) -> DataFrame:
    """(`id`, `vec`, `dim`, `norm2`) of the rows that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm2 = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select(F.col(vector_id).cast("long").alias("id"), v.alias("vec"), F.size(v).alias("dim"), F.when(~bad, norm2).alias("norm2")).filter(
        "id IS NOT NULL AND vec IS NOT NULL AND norm2 > 0"
    )


def select_best(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best `k` different ids per query, best first."""
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    pair = np.lexsort((np.arange(len(query)), found, query))  # each pair's best score first
    first = np.ones(len(query), bool)
    first[1:] = (query[pair][1:] != query[pair][:-1]) | (found[pair][1:] != found[pair][:-1])
    keep = np.zeros(len(query), bool)
    keep[pair[first]] = True
    query, found, score = query[keep], found[keep], score[keep]
    start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    return query[place < k], found[place < k], score[place < k]


class Best:
    """Candidates of a task, reduced to the best `k` per query whenever many are held."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, least: np.ndarray | None = None) -> None:
        """Score all queries against all rows; ties within rounding stay, scores are summed place by place in one order.
        Of a query, scores below `least` are left out."""
        step = max(1, BLOCK // max(1, len(ids)))
        for a in range(0, len(qid), step):
            s = q[a : a + step] @ x.T
            s[qid[a : a + step, None] == ids[None, :]] = -np.inf
            floor = np.full(len(s), -np.inf) if least is None else least[a : a + step]
            if s.shape[1] > self.k:
                floor = np.maximum(floor, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
            wide = 1e-12 * np.linalg.norm(q[a : a + step], axis=1) * np.linalg.norm(x, axis=1).max()
            row, col = np.nonzero((s >= (floor - wide)[:, None]) & (s > -np.inf))
            for b in range(0, len(row), 1 << 16):
                r, c = row[b : b + (1 << 16)], col[b : b + (1 << 16)]
                self.parts.append((qid[a + r], ids[c], (q[a + r] * x[c]).sum(axis=1)))
                self.size += len(r)
            if self.size > HELD:
                self.reduce()

    def reduce(self) -> None:
        if self.parts:
            best = select_best(*map(np.concatenate, zip(*self.parts)), self.k)
            self.parts, self.size = [best], len(best[0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.reduce()
        for q, i, s in self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])
        self.parts, self.size = [], 0


@dataclass
class Table:
    """One hash table: projections, offsets, cell width and how neighbours lie around a query on each projection."""

    a: np.ndarray
    b: np.ndarray
    width: float
    slope: np.ndarray
    middle: np.ndarray
    spread: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.floor((x @ self.a + self.b) / self.width).astype(np.int64)

    def probes(self, x: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Buckets of one query (a row) in falling order of the estimated chance that a neighbour is there."""
        k = self.a.shape[1]
        centre = self.middle + self.slope * (x @ self.a - self.middle)
        options, costs = [], []
        for j in range(k):
            lo, hi = ((centre[j] + s * 6 * self.spread[j] + self.b[j]) / self.width for s in (-1, 1))
            c = np.arange(int(np.floor(lo)), int(np.floor(hi)) + 1)
            edge = (np.append(c, c[-1] + 1) * self.width - self.b[j] - centre[j]) / self.spread[j]
            chance = np.maximum(np.diff(0.5 * (1 + _erf(edge / sqrt(2)))), 1e-300)
            order = np.argsort(-chance, kind="stable")
            options.append(c[order].tolist())
            costs.append((-np.log(chance[order])).tolist())
        heap = [(sum(c[0] for c in costs), (0,) * k, 0)]
        for _ in range(most):
            if not heap:
                return
            cost, at, last = heapq.heappop(heap)
            yield np.array([options[j][i] for j, i in enumerate(at)], np.int64)
            for j in range(last, k):  # each bucket is reached in one way only: by raising places from left to right
                if at[j] + 1 < len(options[j]):
                    more = at[:j] + (at[j] + 1,) + at[j + 1 :]
                    heapq.heappush(heap, (cost + costs[j][at[j] + 1] - costs[j][at[j]], more, j))


def bucket_number(cells: np.ndarray) -> np.ndarray:
    """One number for the cells of a bucket; two buckets with one number are visited together, which loses nothing."""
    out = np.full(len(cells), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(cells.shape[1]):
        out = (out ^ cells[:, j].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


@dataclass
class Index:
    """Hash tables over vectors brought to one norm, and the number of buckets that a query visits in each."""

    norm: float
    tables: list[Table]
    probes: int

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm**2 - (x * x).sum(axis=1), 0.0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def scaled(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q * (self.norm / np.linalg.norm(q, axis=1))[:, None], np.zeros((len(q), 1))], axis=1)


def _sampled(df: DataFrame, n: int, wanted: int, seed: int) -> DataFrame:
    """About `wanted` of `n` rows, chosen by a hash of the id."""
    return df.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n // wanted))) == 0)


def _numpy(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.select("id", "vec").toArrow().combine_chunks()
    ids = got.column("id").to_numpy()
    return ids, matrix(got.column("vec").chunk(0)) if len(ids) else np.zeros((0, 0))


def exact_answers(rows: DataFrame, qid: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The best `k` rows for each of a bounded number of queries -> (`query_id`, `vec_id`, `score`), one pass."""

    def scan(batches):
        best = Best(k)
        for batch in batches:
            if len(batch):
                best.add(qid, q, batch.column("id").to_numpy(), matrix(batch.column("vec")))
        yield from best.rows()

    return _merged(rows.select("id", "vec").mapInArrow(scan, "query_id long, vec_id long, score double"), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Each pair once, ranked per query: one shuffle by query."""
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def fit(rows: DataFrame, queries: DataFrame, n: int, n_queries: int, norm: float, k: int, tables: int, goal: float, bucket_rows: int, seed: int) -> Index:
    """Set width, projections, order and number of probes on the samples."""
    qid, q = _numpy(_sampled(queries, n_queries, SAMPLE_QUERIES, seed))
    if not len(qid):
        qid, q = _numpy(queries.limit(1))
    answers = exact_answers(rows, qid, q, k).select("query_id", "vec_id", "rank")
    found = answers.join(rows.select(F.col("id").alias("vec_id"), "vec"), "vec_id").toArrow().combine_chunks()
    if not len(found):
        return Index(norm, [], 1)
    near = matrix(found.column("vec").chunk(0))
    index = Index(norm, [], 1)
    lifted, scaled = index.lifted(near), index.scaled(q)
    place = {int(i): j for j, i in enumerate(qid)}
    of = np.array([place[int(i)] for i in found.column("query_id").to_numpy()])
    apart = float(sqrt(((lifted - scaled[of]) ** 2).sum(axis=1).mean()))
    some = index.lifted(_numpy(_sampled(rows, n, SAMPLE_ROWS, seed + 1).limit(4 * SAMPLE_ROWS))[1]) if n else lifted
    if len(some) < 2 or apart == 0:
        some = np.concatenate([lifted, scaled])
    width = 2 * max(apart, 1e-6 * norm)
    rng = np.random.default_rng(seed)
    trial = np.floor((some @ rng.normal(size=(some.shape[1], 64)) + rng.uniform(0, width, 64)) / width)
    met = []
    for j in range(trial.shape[1]):  # chance that two rows share a cell
        count = np.unique(trial[:, j], return_counts=True)[1]
        met.append((count * (count - 1)).sum() / (len(some) * (len(some) - 1)))
    alike = min(max(float(np.mean(met)), 1e-9), 1 - 1e-9)
    wanted = max(16, min(bucket_rows, 4 * sqrt(n)))
    most = min(MOST_PROJECTIONS, ceil(log(max(n / wanted, 1.0)) / -log(alike)))
    for k_now in range(most, 0, -1):
        index.tables = []
        for _ in range(tables):
            a, b = rng.normal(size=(near.shape[1] + 1, k_now)), rng.uniform(0, width, k_now)
            at, other = scaled[of] @ a, lifted @ a
            middle = other.mean(axis=0)
            away = at - middle
            slope = (away * (other - middle)).sum(axis=0) / np.maximum((away * away).sum(axis=0), 1e-300)
            spread = np.sqrt(((other - middle - slope * away) ** 2).mean(axis=0))
            index.tables.append(Table(a, b, width, slope, middle, np.maximum(spread, 1e-9 * norm)))
        if probes := _probes_for(index, scaled, lifted, of, goal):
            index.probes = probes
            return index
    index.tables = []
    return index


def _probes_for(index: Index, scaled: np.ndarray, lifted: np.ndarray, of: np.ndarray, goal: float) -> int | None:
    """Buckets per table after which `goal` of the sample's neighbours are met; None if that takes too many."""
    first = np.full(len(of), MOST_PROBES)
    for t in index.tables:
        own = t.cells(lifted)
        for i in range(len(scaled)):
            mine = np.flatnonzero(of == i)
            wanted = {tuple(own[j]): [] for j in mine}
            for j in mine:
                wanted[tuple(own[j])].append(j)
            for step, cell in enumerate(t.probes(scaled[i], MOST_PROBES)):
                for j in wanted.pop(tuple(cell), ()):
                    first[j] = min(first[j], step)
                if not wanted:
                    break
    need = int(np.sort(first)[ceil(goal * len(first)) - 1]) + 1
    return need if need <= MOST_PROBES else None


def _entries(index: Index, visit: bool):
    """Buckets of rows, or the buckets that queries visit, with all columns of the batch."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("vec"))
            for t, table in enumerate(index.tables or [None]):
                if table is None:
                    at, bucket = np.arange(len(x)), np.zeros(len(x), np.int64)
                elif visit:
                    listed = [np.array(list(table.probes(row, index.probes))) for row in index.scaled(x)]
                    at = np.repeat(np.arange(len(x)), [len(p) for p in listed])
                    bucket = bucket_number(np.concatenate(listed))
                else:
                    at, bucket = np.arange(len(x)), bucket_number(table.cells(index.lifted(x)))
                for lo in range(0, len(at), 4096):
                    part = batch.take(pa.array(at[lo : lo + 4096]))
                    columns = [pa.array(np.full(len(part), t, np.int32)), pa.array(bucket[lo : lo + 4096]), *part.columns]
                    yield pa.RecordBatch.from_arrays(columns, ["tab", "bucket", *part.schema.names])

    return run


def _through(index: Index, rows: DataFrame, queries: DataFrame, k: int, slice_rows: int) -> DataFrame:
    """Answers of all queries through the buckets that they visit. An index without tables is one bucket of all rows.

    Queries may have a `least` score that is known to be reached by `k` candidates.
    """
    kind = rows.schema["vec"].dataType.simpleString()
    schema = f"tab int, bucket long, id long, vec {kind}, least double"
    least = F.col("least") if "least" in queries.columns else F.lit(None)
    homes = rows.select("id", "vec", F.lit(None).cast("double").alias("least")).mapInArrow(_entries(index, False), schema)
    visits = queries.select("id", "vec", least.cast("double").alias("least")).mapInArrow(_entries(index, True), schema)
    slices = F.ceil(F.col("n") / slice_rows).cast("int")
    counts = homes.groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias("n")).select("tab", "bucket", slices.alias("slices"))
    counts = bounded_side(counts)
    large = bounded_side(counts.filter("slices > 1"))
    dealt = F.when(F.col("slices") > 1, F.pmod(F.xxhash64("id"), F.col("slices"))).otherwise(0)
    cell = F.xxhash64("tab", "bucket", "slice").alias("cell")
    homes = homes.join(large, ["tab", "bucket"], "left").withColumn("slice", F.coalesce(dealt, F.lit(0)).cast("int"))
    visits = visits.join(counts, ["tab", "bucket"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    both = homes.select(cell, F.lit(0).alias("visitor"), "id", "vec", "least").unionByName(visits.select(cell, F.lit(1).alias("visitor"), "id", "vec", "least"))

    def scan(batches):
        best, now, held, ready = Best(k), None, [], None
        for batch in batches:
            if not len(batch):
                continue
            cells, visitor, ids = (batch.column(c).to_numpy() for c in ("cell", "visitor", "id"))
            x, least = matrix(batch.column("vec")), batch.column("least").to_numpy(zero_copy_only=False)
            least = np.where(np.isnan(least), -np.inf, least)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (visitor[1:] != visitor[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if cells[lo] != now:
                    now, held, ready = cells[lo], [], None
                if not visitor[lo]:
                    held.append((ids[lo:hi], x[lo:hi]))
                    ready = None
                elif held:
                    ready = ready or tuple(map(np.concatenate, zip(*held)))
                    best.add(ids[lo:hi], x[lo:hi], *ready, least[lo:hi])
            if best.size > HELD // 2:
                best.reduce()
                if best.size > HELD // 2:
                    yield from best.rows()
        yield from best.rows()

    met = both.repartition("cell").sortWithinPartitions("cell", "visitor").mapInArrow(scan, "query_id long, vec_id long, score double")
    return _merged(met, k)


def search(
    rows: DataFrame, queries: DataFrame, k: int = 20, vector_id: str = "vec_id", vector: str = "embedding", tables: int = TABLES,
    goal: float = GOAL, bucket_rows: int = BUCKET_ROWS, slice_rows: int = SLICE_ROWS, seed: int = 11,
) -> DataFrame:
    """The `k` largest inner products found for each query among rows of another id -> (`query_id`, `rank`, `vec_id`, `score`)."""
    prepare(rows.sparkSession)
    copies = Window.partitionBy("vec").orderBy("id")
    kept = usable(rows, vector_id, vector).withColumn("copy", F.dense_rank().over(copies)).filter(F.col("copy") <= k + 1)
    kept = kept.dropDuplicates(["vec", "id"]).checkpoint()  # partitioned by vector already
    asked = usable(queries, vector_id, vector).checkpoint()
    sizes = {r.dim: r for r in kept.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("norm2")).collect()}
    out = None
    for dim, n_queries in asked.groupBy("dim").count().collect():
        if dim not in sizes:
            continue
        own, mine = kept.filter(F.col("dim") == dim), asked.filter(F.col("dim") == dim)
        n, norm = sizes[dim].n, sqrt(max(sizes[dim].norm2, mine.agg(F.max("norm2")).first()[0]))
        index = fit(own, mine, n, n_queries, norm, k, tables, goal, bucket_rows, seed)
        if index.tables:
            # a first look: the likeliest buckets of one table; their k-th best bounds what other buckets hand on
            look = _through(Index(norm, index.tables[:1], min(LOOK_PROBES, index.probes)), own, mine, k, slice_rows).filter(F.col("rank") == k)
            mine = mine.join(look.select(F.col("query_id").alias("id"), F.col("score").alias("least")), "id", "left").checkpoint()
        found = _through(index, own, mine, k, slice_rows).checkpoint()
        if index.tables:
            full = found.filter(F.col("rank") == F.least(F.lit(k), F.lit(n - 1))).select(F.col("query_id").alias("id"))
            short = mine.join(full, "id", "left_anti").checkpoint()
            if not short.isEmpty():
                rest = _through(Index(norm, [], 1), own, short, k, slice_rows)
                found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return out.select("query_id", "rank", "vec_id", "score")
