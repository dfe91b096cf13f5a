"""Operator 1: shards by a two-pass external shuffle.

Pass one scatters rows by seeded hashes: the key decides the shard (the shard with the highest hash of key and shard
number wins, so that one more shard only takes rows), and a second hash the bucket in it. Buckets are as many as make about
`BUCKET_BYTES` each. Pass two reads one bucket at a time, puts it in a fixed order and Fisher-Yates shuffles it with a
generator seeded by shard and bucket. Slots count through a shard's buckets.

Null key: one shard, the same each time; its rows are spread over buckets by their texts. Null text: empty, size 1. Repeated
rows: each gets a slot of its own. Empty table: no rows. All columns travel inside one struct, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import prepare, text_of

SHARDS = 8
SEED = 20_240_601
BUCKET_BYTES = 8_000_000
MOST_PARTS = 50_000


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash of (key, shard)."""
    ranks = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("rank"), F.lit(s).alias("shard")) for s in range(shards)]
    return F.array_max(F.array(*ranks))["shard"]


def shuffle_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(`row` struct of all columns, `shard`, `bucket`, `slot`, `grown_shard`)."""
    spark = docs.sparkSession
    prepare(spark)
    size = docs.agg(F.sum(F.octet_length(text_of(text)) + 16)).first()[0] or 0
    buckets = max(1, -(-size // (shards * bucket_bytes)))
    mix = F.crc32(text_of(text).cast("binary"))
    placed = docs.select(
        F.struct("*").alias("row"), F.col(key).alias("key"), mix.alias("mix"),
        shard_of(F.col(key), shards, seed).alias("shard"), shard_of(F.col(key), shards + 1, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(~seed), F.col(key), mix), F.lit(buckets)).cast("int").alias("bucket"),
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )

    def shuffle(_, rows, first):
        import numpy as np
        import pyarrow as pa

        if not len(rows):
            return rows.select(["row", "shard", "bucket", "grown_shard"]).append_column("slot", pa.array([], pa.int64()))
        import pyarrow.compute as pc

        shard, bucket = rows["shard"][0].as_py(), rows["bucket"][0].as_py()
        order = pc.sort_indices(rows.select(["key", "mix"]), [("key", "ascending"), ("mix", "ascending")]).to_numpy().copy()
        np.random.default_rng([seed, shard, bucket]).shuffle(order)  # Fisher-Yates
        slots = np.arange(len(order), dtype=np.int64) + first["first"][0].as_py()
        out = rows.select(["row", "shard", "bucket", "grown_shard"]).take(pa.array(order))
        return out.append_column("slot", pa.array(slots))

    kind = placed.schema["row"].dataType.simpleString()
    parts = min(shards * buckets, MOST_PARTS)  # tasks grow with the buckets, so that each reads a few of them at any size
    dealt, firsts = (df.repartition(parts, "shard", "bucket") for df in (placed, offsets))
    return (
        dealt.groupBy("shard", "bucket").cogroup(firsts.groupBy("shard", "bucket"))
        .applyInArrow(shuffle, f"row {kind}, shard int, bucket int, grown_shard int, slot long")
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard; the files of a shard hold whole buckets in slot order."""
    shuffled.write.mode("overwrite").partitionBy("shard").parquet(path)
