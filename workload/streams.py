"""Token streams and the running catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasloom.operators.scale import dense_index, ordered_text
from atlasloom.streaming import chunks, sse

from . import query
from .corpus import remove_files, scratch, write_texts
from .inputs import load, table, with_inputs

EVENTS = """events_in AS (
  SELECT *, trim(line) LIKE 'data: {"id%' AS full_event, trim(line) LIKE 'data: {"choices%' AS text_event, trim(line) = 'data: [DONE]' AS done FROM sse_lines),
parsed AS (SELECT req_id, seq, done, CASE WHEN full_event THEN regexp_extract(line, '"content":"([^"]*)"', 1)
    WHEN text_event THEN regexp_extract(line, '"text":"([^"]*)"', 1) END AS content,
    nullif(regexp_extract(line, '"id":"([^"]*)"', 1), '') AS id, nullif(regexp_extract(line, '"model":"([^"]*)"', 1), '') AS model,
    TRY_CAST(nullif(regexp_extract(line, '"created":([0-9]+)', 1), '0') AS BIGINT) AS created
  FROM events_in WHERE full_event OR text_event OR done),
live AS (SELECT p.* FROM parsed p LEFT JOIN (SELECT req_id, min(seq) AS e FROM parsed WHERE done GROUP BY req_id) d USING (req_id)
  WHERE e IS NULL OR seq < e)"""
RESPONSES = """SELECT req_id, coalesce(string_agg(content, '' ORDER BY seq), '') AS response,
      coalesce(arg_max(id, seq) FILTER (WHERE id IS NOT NULL), '') AS id, coalesce(arg_max(model, seq) FILTER (WHERE model IS NOT NULL), '') AS model,
      coalesce(arg_max(created, seq) FILTER (WHERE created IS NOT NULL), 0) AS created"""


def request_lines(spark, sf):
    """The lines with their position in their request."""
    numbered = dense_index(load(spark, sf, "sse_lines", heavy=True), ["req_id"], ["seq"], "pos")
    return numbered.select("req_id", F.col("pos").alias("seq"), "line")


@query(with_inputs("sse_lines", also=EVENTS) + "SELECT * FROM parsed")
def sse_parse(spark, sf):
    """I1"""
    return sse.parse_sse(load(spark, sf, "sse_lines", heavy=True))


@query(with_inputs("sse_lines", also=EVENTS) + RESPONSES + " FROM live GROUP BY req_id")
def sse_accumulate(spark, sf):
    """I2"""
    return sse.accumulate(sse.parse_sse(request_lines(spark, sf)))


@query(
    with_inputs("sse_lines", also=EVENTS) + RESPONSES
    + ", TRUE AS complete FROM live WHERE req_id IN (SELECT req_id FROM parsed WHERE done) GROUP BY req_id"
)
def sse_stream(spark, sf):
    """I2 as a stream: the finished requests, from files in two micro-batches and emitted in small parts"""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    folder, target, state = (scratch(spark, name) for name in ("lines", "responses", "state"))
    request_lines(spark, sf).repartition(2).write.parquet(folder)
    lines = spark.readStream.schema("req_id string, seq bigint, line string").option("maxFilesPerTrigger", 1).parquet(folder)
    sse.accumulate_stream(lines, idle_ms=None, flush_chars=1_000).writeStream.format("parquet").option("path", target).option(
        "checkpointLocation", state
    ).trigger(availableNow=True).start().awaitTermination()
    return sse.whole_responses(spark.read.schema(sse.RESPONSE).parquet(target)).filter("complete")


WIDE = "replace(line, '; ', ' é€😀; ')"


def request_bytes(spark, sf):
    """Responses as bytes, with the size of their chunks: request numbers choose 1 to 31 bytes a chunk and the line end.

    Each response is dealt to a fixed number of tasks: chunks are many times as large as what they are cut from, so the small
    partitions before must not be put together.
    """
    user = F.substring("req_id", 2, 20).cast("bigint")
    lines = request_lines(spark, sf).withColumn("line", F.concat(F.expr(WIDE), F.when(user % 2 == 0, "\r\n").otherwise("\n")))
    size = (1 + user % 31).cast("int")
    whole = ordered_text(lines, ["req_id"], "seq", "line", "text").select("req_id", size.alias("size"), F.encode("text", "UTF-8").alias("data"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return whole.repartition(tasks, "req_id")


def cut_chunks(whole, half=None):
    """The chunks of each response, or those of its first (0) or second (1) half."""
    last = F.floor((F.octet_length("data") - 1) / F.col("size"))
    middle = F.floor(last / 2)
    first, last = (middle + 1 if half == 1 else F.lit(0)), (middle if half == 0 else last)
    seqs = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint")))
    return whole.select("req_id", "size", "data", F.explode(seqs).alias("seq")).select(
        "req_id", "seq", F.substring("data", (F.col("seq") * F.col("size") + 1).cast("int"), F.col("size")).alias("chunk")
    )


CUT = EVENTS.replace("FROM sse_lines)", f"FROM (SELECT * REPLACE ({WIDE} AS line) FROM sse_lines))", 1)


@query(with_inputs("sse_lines", also=CUT) + RESPONSES + " FROM live GROUP BY req_id")
def sse_from_chunks(spark, sf):
    """I1, I2 on a table of raw chunks"""
    return sse.accumulate(sse.parse_sse(chunks.lines_from_chunks(cut_chunks(request_bytes(spark, sf)))))


@query(with_inputs("sse_lines", also=CUT) + RESPONSES + " FROM live GROUP BY req_id")
def sse_chunk_stream(spark, sf):
    """I1 as a stream: bytes are carried from one micro-batch to the next"""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    stored, folder, target, state = (scratch(spark, name) for name in ("requests", "chunks", "lines", "state"))
    request_bytes(spark, sf).write.parquet(stored)
    whole = spark.read.schema("req_id string, size int, data binary").parquet(stored)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for half in (0, 1):
        cut_chunks(whole.repartition(tasks, "req_id"), half).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("req_id string, seq bigint, chunk binary").parquet(folder)
        chunks.assemble_lines(stream, idle_ms=None).writeStream.format("parquet").option("path", target).option(
            "checkpointLocation", state
        ).trigger(availableNow=True).start().awaitTermination()
    return sse.accumulate(sse.parse_sse(spark.read.schema(chunks.LINE).parquet(target)))


@query(
    """SELECT 'own' || (doc_id % 9) || '/' || source || '_' || doc_id AS name, 'github' AS repo_type, lang AS language FROM documents WHERE doc_id % 7 <> 3"""
)
def catalogue_stream(spark, sf):
    """The catalogue follows a folder of stored wikis; of the first files every seventh is removed while others are added"""
    folder = scratch(spark, "stored").removeprefix("file:")
    target, state = scratch(spark, "catalogue"), scratch(spark, "state")
    names = table(spark, sf, "documents").select(
        F.concat(
            F.lit("wiki_cache_github_own"), F.col("doc_id") % 9, F.lit("_"), "source", F.lit("_"), "doc_id", F.lit("_"), "lang", F.lit(".json")
        ).alias("path"),
        F.lit("{}").alias("text"), "doc_id",
    )
    later = F.col("doc_id") % 7 == 5
    write_texts(names.filter(~later).drop("doc_id"), folder)
    sse.stream_catalogue(spark, folder, target, state).awaitTermination()
    remove_files(names.filter("doc_id % 7 = 3"), folder)
    write_texts(names.filter(later).drop("doc_id"), folder)
    sse.stream_catalogue(spark, folder, target, state).awaitTermination()
    return sse.read_catalogue(spark, target).select("name", "repo_type", "language")
