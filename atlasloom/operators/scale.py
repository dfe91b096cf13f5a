"""Helpers that keep grouped, ordered work bounded when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import bound_batches, ensure_checkpoint_dir

RANGE = 10_000
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 200_000


def ordered_text(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    text: str,
    out: str,
    sep: str = "",
    span: int = RANGE,
) -> DataFrame:
    """Join the texts of each key in order -> one row `(*keys, out)` per key, at every size.

    `order` is an integer position. The texts of each (key, range of `span` positions) are joined first, on their
    own, so the rows of a hot key are spread over the cluster; then the few range texts of a key are joined.
    Rows of a range are hashed by key and range, so a single value is all that one task must hold.
    """
    ranges = df.groupBy(*keys, F.floor(F.col(order) / span).cast("bigint").alias("__range")).agg(
        joined(text, order, sep).alias(out)
    )
    return ranges.groupBy(*keys).agg(joined(out, "__range", sep).alias(out))


def joined(text: str, order: str, sep: str = "") -> Column:
    """Aggregate: texts in order, joined."""
    literal = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return F.expr(f"listagg(`{text}`, '{literal}') WITHIN GROUP (ORDER BY `{order}`)")


def ordered_md5(df: DataFrame, keys: Sequence[str], order: str, text: str, out: str, sep: str = "") -> DataFrame:
    """MD5 of the joined texts of each key in order -> one row `(*keys, n, out)` per key, `n` its number of texts.

    A key is hashed text by text as its sorted rows pass by, so however long the joined text would be, it is never made: a
    task holds a batch. Null texts are left out; rows of one position are in the order of their texts.
    """
    bound_batches(df.sparkSession)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField(out, T.StringType())])

    def digest(batches):
        import hashlib

        import pyarrow as pa

        def row(key, n, md5):
            return pa.RecordBatch.from_pylist([dict(zip((*keys, "n", out), (*key, n, md5.hexdigest())))], schema=arrow)

        arrow, open_key, n, md5 = None, None, 0, None
        for batch in batches:
            arrow = arrow or pa.schema([*[batch.schema.field(k) for k in keys], pa.field("n", pa.int64()), pa.field(out, pa.string())])
            for *key, piece in zip(*[batch.column(c).to_pylist() for c in (*keys, text)]):
                if key != open_key:
                    if open_key is not None:
                        yield row(open_key, n, md5)
                    open_key, n, md5 = key, 0, hashlib.md5()
                md5.update((sep + piece if n else piece).encode())
                n += 1
        if open_key is not None:
            yield row(open_key, n, md5)

    rows = df.select(*keys, order, text).filter(F.col(text).isNotNull())
    return rows.repartition(*keys).sortWithinPartitions(*keys, order, text).mapInArrow(digest, schema)


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, span: int = 65_536
) -> DataFrame:
    """Zero-based position of each row inside its key, without one task per key.

    Rows are cut into ranges of `span` values of the first order column; a row's position is the
    number of rows in earlier ranges plus its rank in its own range. Only the range counts are
    summed per key, and the join and the ranking share one shuffle on (key, range).
    """
    bucket = "__range"
    rows = df.withColumn(bucket, F.floor(F.col(order[0]) / span).cast("bigint"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, bucket)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, bucket, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    )
    rank = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return (
        rows.join(offsets, [*keys, bucket])
        .withColumn(out, (F.col("__offset") + rank - 1).cast("bigint"))
        .drop(bucket, "__offset")
    )


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, span: int = RANGE) -> DataFrame:
    """Sum of `value` over the rows of the same key that come before, without one task per key.

    `order` is an integer position. Sums of ranges of `span` positions are added up per key; the rest is a window inside a range.
    """
    rows = df.withColumn("__range", F.floor(F.col(order) / span).cast("bigint"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum")).select(
        *keys, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset")
    )
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("__offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return rows.join(offsets, [*keys, "__range"]).withColumn(out, total).drop("__range", "__offset")


def sorted_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Zero-based position inside each key for orderings that are not integers (file paths).

    A range partitioning on (keys, order) splits a hot key into even slices by sampled bounds; rows that are equal in all of
    these are split by a hash of the whole row, so one order value may hold any share of the rows. Slice counts are what is
    summed per key. The slices are checkpointed because the bounds must be the same for the counts and the rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    slices = (
        df.repartitionByRange(*keys, *order, F.xxhash64(*hashable))
        .sortWithinPartitions(*keys, *order)
        .withColumn("__slice", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id())
        .checkpoint()
    )
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slices.groupBy(*keys, "__slice")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
        .select(
            *keys, "__slice", "__first",
            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"),
        )
    )
    return (
        slices.join(offsets, [*keys, "__slice"])
        .withColumn(out, (F.col("__offset") + F.col("__row") - F.col("__first")).cast("bigint"))
        .drop("__slice", "__row", "__first", "__offset")
    )


def _row_bytes(df: DataFrame) -> Column:
    """Approximate size of a row: text and binary as they are, nested values as JSON."""
    total = F.lit(16)
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + 8
    return total


def stored_side(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """A checkpointed join side and whether it is small enough to be broadcast.

    The side is checkpointed first, so measuring it does not compute it twice.
    """
    ensure_checkpoint_dir(df.sparkSession)
    side = df.checkpoint()
    rows, size = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(side)), F.lit(0))).first()
    return side, rows <= (BROADCAST_ROWS if max_rows is None else max_rows) and size <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def bounded_side(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Mark a join side for broadcast only after measuring it; otherwise leave it to AQE."""
    side, small = stored_side(df, max_rows, max_bytes)
    return F.broadcast(side) if small else side


def latest_wins(df: DataFrame, keys: Sequence[str], *version: str) -> DataFrame:
    """The newest row per key. Spark keeps one row per key per task before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(v) for v in version])
    return df.withColumn("__rn", F.row_number().over(newest)).filter("__rn = 1").drop("__rn")
