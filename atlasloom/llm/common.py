"""Helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import bound_batches, ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL where SQL can express it."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def prepare(spark: SparkSession) -> None:
    """Make the package importable in the tasks, know the shared checkpoint folder, and keep batches of long texts small."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    bound_batches(spark)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_MODELS: dict[str, object] = {}


def opened(name: str, build: Callable):
    """What a worker process keeps for one job: built once, and given up when another job's is asked for."""
    if name not in _MODELS:
        release()
        _MODELS[name] = build()
    return _MODELS[name]


def release() -> None:
    """Give up what earlier jobs have left in this worker process, and hand its free memory back to the machine."""
    import ctypes
    import gc

    import pyarrow as pa

    _MODELS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


class Scratch:
    """Tables between the steps of an operator, in the shared folder; those no longer needed can be deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/steps-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table and read it again. A type that Parquet lacks is checkpointed instead."""
        if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields) or len({c.lower() for c in df.columns}) < len(df.columns):
            return df.checkpoint()
        df.write.parquet(f"{self.folder}/{name}")
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop_but(self, *wanted: str) -> None:
        for name in [n for n in self.names if n not in wanted]:
            delete_folder(self.spark, f"{self.folder}/{name}")
            self.names.remove(name)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_of(name: str = "text") -> Column:
    """The text, a null one taken as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def sorted_runs(batches: Iterator, columns: list[str], key: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of numpy columns from batches sorted by `key`; a block never ends inside a run of one key."""
    held: list[list[np.ndarray]] = [[] for _ in columns]
    at = columns.index(key)
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(cols[0]):
            continue
        last = cols[at][-1]
        cut = int(np.searchsorted(cols[at], last))
        if cut:
            yield tuple(np.concatenate([*h, c[:cut]]) for h, c in zip(held, cols))
            held = [[c[cut:]] for c in cols]
        elif held[at] and held[at][-1][-1] != last:
            yield tuple(np.concatenate(h) for h in held)
            held = [[c] for c in cols]
        else:
            for h, c in zip(held, cols):
                h.append(c)
    if held[0]:
        yield tuple(np.concatenate(h) for h in held)
