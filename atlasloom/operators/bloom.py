"""A Bloom filter of keys for scans: rows that cannot match never reach a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

KEY_BITS = 16
MAX_BYTES = 64 * 1024 * 1024
PROBES = 5


def _bit(hashed: str, i: int) -> str:
    return f"shiftleft(1L, CAST(shiftright({hashed}, {6 * i}) & 63 AS INT))"


def filter_table(hashed: DataFrame, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The filter of a column `h` of 64-bit hashes: `PROBES` bits of one 64-bit block for each.

    Blocks are joined in Spark by `bit_or`, with partial aggregation. They take `KEY_BITS` bits a key and never more than `max_bytes`,
    beyond which more rows pass that do not match.
    """
    n = hashed.count()
    blocks = max(1, min(max_bytes // 8, -(-n * KEY_BITS // 64)))
    masks = hashed.selectExpr(f"pmod(shiftright(h, 30), {blocks}L) AS at", f"{' | '.join(_bit('h', i) for i in range(PROBES))} AS mask")
    found = masks.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(blocks, np.int64)
    table[found.column("at").to_numpy()] = found.column("mask").to_numpy()
    return table


def filter_test(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter: all that are, and few others."""
    mask = np.zeros(len(h), np.int64)
    for i in range(PROBES):
        mask |= np.left_shift(np.int64(1), (h >> (6 * i)) & 63)
    return (table[(h >> 30) % len(table)] & mask) == mask


def key_filter(keys: DataFrame, columns: list[str], max_bytes: int = MAX_BYTES) -> Callable[..., Column]:
    """A predicate over columns of another table that is true for every key in `keys` and for few others.

    The filter is sent to every task once. Whoever uses it joins exactly afterwards. Null keys match nothing.
    """
    shared = keys.sparkSession.sparkContext.broadcast(filter_table(keys.select(F.xxhash64(*columns).alias("h")), max_bytes))

    @F.pandas_udf("boolean")
    def known(h):
        import pandas as pd

        return pd.Series(filter_test(shared.value, h.to_numpy()))

    return lambda *own: known(F.xxhash64(*own))
