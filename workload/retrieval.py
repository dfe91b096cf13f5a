"""Vectors, embedding and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from atlasloom.operators import context, embed, inverted, retrieval as r
from atlasloom.plans.corpus import build_chunks, index_corpus
from atlasloom.sources import index_store

from . import query
from .corpus import CHUNKS, DIRS, FILE_NAME, NAMES, scratch, write_texts
from .inputs import load, with_inputs

MODAL = """dims AS (
  SELECT repo_id, arg_max(dim, n * 10000000000 - first_ord) AS dim FROM (
    SELECT repo_id, len(vector) AS dim, count(*) AS n, min(doc_ord) AS first_ord FROM vectors WHERE len(vector) > 0 GROUP BY ALL)
  GROUP BY repo_id),
valid AS (SELECT v.* FROM vectors v JOIN dims d ON v.repo_id = d.repo_id AND len(v.vector) = d.dim)"""

# the mean vector of every label asks the repository that holds it
CENTROIDS = """means AS (
  SELECT repo_id, CAST(label AS STRING) AS query_id, i, avg(CAST(vector[i] AS DOUBLE))::FLOAT AS x
  FROM valid, LATERAL (SELECT unnest(generate_series(1, len(vector))) AS i) GROUP BY ALL),
centroids AS (SELECT repo_id, query_id, list(CAST(x AS DOUBLE) ORDER BY i) AS q FROM means GROUP BY ALL),
scored AS (
  SELECT c.repo_id, c.query_id, v.chunk_id, v.doc_ord,
    round(list_dot_product(c.q, v.vector::DOUBLE[]) / sqrt(list_dot_product(c.q, c.q))
      / sqrt(list_dot_product(v.vector::DOUBLE[], v.vector::DOUBLE[])), 6) AS score
  FROM centroids c JOIN valid v ON c.repo_id = v.repo_id),
hits AS (SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo_id, query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored)
  WHERE rank <= 20)"""


def centroids(vectors: DataFrame) -> DataFrame:
    valid = r.filter_modal_dim(vectors)
    means = (
        valid.select("repo_id", "label", F.posexplode("vector").alias("i", "x"))
        .groupBy("repo_id", "label", "i").agg(F.avg(F.col("x").cast("double")).cast("float").alias("x"))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    return means.groupBy("repo_id", F.col("label").cast("string").alias("query_id")).agg(ordered.alias("vector"))


@query(with_inputs("vectors", also=MODAL) + "SELECT repo_id, doc_ord, chunk_id FROM valid")
def modal_dimension_filter(spark, sf):
    """D1"""
    return r.filter_modal_dim(load(spark, sf, "vectors")).select("repo_id", "doc_ord", "chunk_id")


@query(
    with_inputs("vectors")
    + """SELECT v.repo_id, v.doc_ord FROM vectors v JOIN (
      SELECT repo_id, arg_min(len(vector), doc_ord) AS dim FROM vectors WHERE len(vector) > 0 GROUP BY repo_id) f
      ON v.repo_id = f.repo_id AND len(v.vector) = f.dim"""
)
def first_dimension_filter(spark, sf):
    """E11"""
    return embed.filter_first_dim(load(spark, sf, "vectors")).select("repo_id", "doc_ord")


@query(
    with_inputs("vectors")
    + """SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE len(vector) > 0) AS non_empty,
      count(*) FILTER (WHERE len(vector) = 0) AS empty,
      array_to_string(list_sort(list_distinct(list(len(vector)) FILTER (WHERE len(vector) > 0)))[1:3], ',') AS sample_dims
    FROM vectors GROUP BY repo_id"""
)
def embedding_stats(spark, sf):
    """D2, F4"""
    stats = embed.embedding_stats(load(spark, sf, "vectors"))
    return stats.withColumn("sample_dims", F.array_join(F.col("sample_dims").cast("array<string>"), ","))


@query(with_inputs("vectors", also=MODAL + ",\n" + CENTROIDS) + "SELECT repo_id, query_id, chunk_id, doc_ord, score, rank FROM hits")
def topk_chunks(spark, sf):
    """D1, C6, E1, C1"""
    vectors = load(spark, sf, "vectors")
    return r.retrieve(centroids(vectors), vectors, columns=["doc_ord"])


@query(with_inputs("vectors", also=MODAL + ",\n" + CENTROIDS) + "SELECT repo_id, query_id, chunk_id, score, rank FROM hits")
def topk_chunks_ann(spark, sf):
    """Through an inverted file whose left-out lists are proven to hold nothing better"""
    vectors = load(spark, sf, "vectors")
    return inverted.retrieve_ann(centroids(vectors), vectors)


@query(
    with_inputs("vectors", also=MODAL + ",\n" + CENTROIDS)
    + "SELECT repo_id, query_id, count(*) AS n, TRUE AS recalled FROM hits GROUP BY ALL"
)
def ann_recall(spark, sf):
    """Recall of the stored inverted file against the exact job, per query; 0.9 and more is recalled"""
    vectors, folder = load(spark, sf, "vectors"), scratch(spark, "lists")
    asked = centroids(vectors).checkpoint()
    inverted.build_lists(vectors).save(folder)
    found = inverted.retrieve_lists(asked, inverted.InvertedFile.load(spark, folder), slack=0.01)
    both = r.retrieve(asked, vectors, columns=()).select("repo_id", "query_id", "chunk_id").join(
        found.select("repo_id", "query_id", "chunk_id", F.lit(1).alias("hit")), ["repo_id", "query_id", "chunk_id"], "left"
    )
    share = F.sum("hit") / F.count(F.lit(1))
    return both.groupBy("repo_id", "query_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(share >= 0.9, F.lit(False)).alias("recalled"))


@query(with_inputs("vectors", also=MODAL + ",\n" + CENTROIDS) + "SELECT repo_id, query_id, chunk_id, score, rank FROM hits")
def topk_other_column(spark, sf):
    """Retrieval on a vector column of another name"""
    vectors = load(spark, sf, "vectors")
    return r.retrieve(centroids(vectors).withColumnRenamed("vector", "asked"), vectors.withColumnRenamed("vector", "embedded"), columns=(), query_vector="asked", vector="embedded")


@query(
    with_inputs("vectors")
    + """, x AS (SELECT doc_ord, vector, doc_ord % 4 AS shape FROM vectors),
    found AS (
      SELECT doc_ord, 0 AS index, vector AS v FROM x WHERE len(vector) > 0
      UNION ALL SELECT doc_ord, 1, vector FROM x WHERE shape IN (1, 2) AND len(vector) > 0)
    SELECT doc_ord, CAST(index AS INTEGER) AS index, CAST(len(v) AS INTEGER) AS n, CAST(list_sum([CAST(round(round(e::DOUBLE, 4) * 10000) AS BIGINT) for e in v]) AS BIGINT) AS total FROM found"""
)
def payload_vectors(spark, sf):
    """Flat, nested, object and keyed shapes of an embedding response"""
    v = F.transform("vector", lambda e: F.round(e.cast("double"), 4))
    empty = F.array().cast("array<double>")
    shape = F.col("doc_ord") % 4
    payload = (
        F.when(shape == 0, F.to_json(F.struct(v.alias("embedding"))))
        .when(shape == 1, F.to_json(F.struct(F.array(v, empty, v).alias("embeddings"))))
        .when(shape == 2, F.to_json(F.struct(F.array(F.struct(v.alias("embedding")), F.struct(v.alias("embedding"))).alias("embeddings"))))
        .otherwise(F.to_json(F.struct(F.struct(F.array(v).alias("float")).alias("embeddings"))))
    )
    rows = load(spark, sf, "vectors").select("doc_ord", payload.alias("payload"))
    total = F.aggregate("vector", F.lit(0).cast("bigint"), lambda a, e: a + F.round(e * 10000).cast("bigint"))
    return embed.normalise_payload(rows).select("doc_ord", "index", F.size("vector").alias("n"), total.alias("total"))


# --- text retrieval on hashed vectors --------------------------------------------------------
def hashed(name: str, source: str, key: str) -> str:
    """DuckDB form of the default embedder: signed word hashing into 256 places, unit length."""
    return f"""{name}_words AS (
  SELECT repo_id, {key} AS id, w, count(*) AS c FROM (SELECT repo_id, {key}, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM {source})
  WHERE w <> '' GROUP BY ALL),
{name}_hash AS (SELECT w, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT w FROM {name}_words)),
{name}_sums AS (
  SELECT repo_id, id, h % 256 AS i, sum(CASE WHEN (h // 256) % 2 = 0 THEN c ELSE -c END)::DOUBLE AS x
  FROM {name}_words JOIN {name}_hash USING (w) GROUP BY ALL),
{name}_vec AS (
  SELECT repo_id, id, i, (x / n)::FLOAT::DOUBLE AS x FROM {name}_sums
  JOIN (SELECT repo_id AS r, id AS d, sqrt(sum(x * x)) AS n FROM {name}_sums GROUP BY ALL) ON repo_id = r AND id = d WHERE n > 0),
{name}_norm AS (SELECT repo_id, id, sqrt(sum(x * x)) AS n FROM {name}_vec GROUP BY ALL)"""


def text_hits(questions: str, source: str = "chunks") -> str:
    """DuckDB form of text retrieval; texts without any word score zero against everything."""
    return (
        hashed("cv", source, "chunk_id") + ",\n" + hashed("qv", questions, "query_id") + f""",
dots AS (SELECT q.repo_id, q.id AS query_id, c.id AS chunk_id, sum(q.x * c.x) AS dot
  FROM qv_vec q JOIN cv_vec c ON q.repo_id = c.repo_id AND q.i = c.i GROUP BY ALL),
pairs AS (SELECT q.repo_id, q.query_id, c.chunk_id, c.file_path, c.text, c.doc_ord,
    coalesce(round(d.dot / qn.n / cn.n, 6), 0.0) AS score
  FROM {questions} q JOIN {source} c ON q.repo_id = c.repo_id
  LEFT JOIN dots d ON d.repo_id = q.repo_id AND d.query_id = q.query_id AND d.chunk_id = c.chunk_id
  LEFT JOIN qv_norm qn ON qn.repo_id = q.repo_id AND qn.id = q.query_id
  LEFT JOIN cv_norm cn ON cn.repo_id = c.repo_id AND cn.id = c.chunk_id
  WHERE trim(replace(c.text, chr(10), ' ')) <> ''),
hits AS (SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo_id, query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM pairs)
  WHERE rank <= 20)"""
    )


CONTEXT = """per_file AS (
  SELECT query_id, file_path, min(rank) AS best, '## File Path: ' || file_path || chr(10) || chr(10)
    || string_agg(text, chr(10) || chr(10) ORDER BY rank) AS part FROM hits GROUP BY query_id, file_path),
contexts AS (SELECT query_id, chr(10) || chr(10) || '----------' || string_agg(part, chr(10) || chr(10) ORDER BY best) AS context
  FROM per_file GROUP BY query_id)"""


def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return build_chunks(load(spark, sf, "files", heavy=True).select("repo_id", "doc_ord", "file_path", "text"))


def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval reads its chunks several times, each time other columns: from a stored index."""
    path = scratch(spark, "chunks")
    index_store.write_index(text_chunks(spark, sf), path)
    return index_store.read_index(spark, path)


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return embed.embed_chunks(load(spark, sf, "questions")).drop("text")


@query(
    with_inputs("files", also=CHUNKS + ",\n" + hashed("cv", "chunks", "chunk_id"))
    + """SELECT repo_id, id AS chunk_id, count(*) FILTER (WHERE x <> 0) AS n_places, round(sum(x * (i + 1)), 3) AS checksum
    FROM cv_vec GROUP BY ALL"""
)
def hash_embed(spark, sf):
    """J2, U1"""
    weighted = F.aggregate(
        F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    filled = F.size(F.filter("vector", lambda x: x != 0))
    return text_chunks(spark, sf).filter(filled > 0).select(
        "repo_id", "chunk_id", filled.cast("bigint").alias("n_places"), F.round(weighted, 3).alias("checksum")
    )


@query(
    with_inputs("files", also=CHUNKS)
    + """SELECT repo_id, count(*) FILTER (WHERE md5(text) NOT LIKE '0%') AS valid, count(*) FILTER (WHERE md5(text) LIKE '0%') AS empty,
      count(*) FILTER (WHERE md5(text) LIKE '0%') AS failed_rows, count(*) AS total,
      count(*) FILTER (WHERE md5(text) LIKE '0%') AS error_batches
    FROM chunks WHERE trim(text) <> '' GROUP BY repo_id"""
)
def batch_stats(spark, sf):
    """A model that fails for every sixteenth text, one text per call"""
    chunks = text_chunks(spark, sf).drop("vector", "embed_error").filter(F.trim("text") != "")
    embedded = embed.embed_chunks(chunks, failing_model, batch=1, batch_column="batch_no")
    return embed.batch_stats(embedded)


def failing_model():
    import hashlib

    def run(texts):
        if any(hashlib.md5(t.encode()).hexdigest().startswith("0") for t in texts):
            raise ConnectionError("no answer")
        return [[1.0, 0.0] for _ in texts]

    return run


@query(
    with_inputs("files", "questions", also=CHUNKS + ",\n" + text_hits("questions"))
    + "SELECT repo_id, query_id, chunk_id, file_path, text, score, rank FROM hits"
)
def text_retrieval(spark, sf):
    """J1 to J3 on texts"""
    return r.retrieve(question_vectors(spark, sf), stored_chunks(spark, sf))


@query(
    with_inputs("files", "questions", also=CHUNKS + ",\n" + text_hits("questions") + ",\n" + CONTEXT)
    + "SELECT query_id, context FROM contexts"
)
def context_by_file(spark, sf):
    """D3"""
    return context.group_context(r.retrieve(question_vectors(spark, sf), stored_chunks(spark, sf)))


NUMBER = "CAST(substr(repo_id, 4) AS INTEGER)"
KEPT = f"""kept AS (SELECT * FROM files WHERE {NUMBER} % 4 <> 3 AND NOT regexp_matches(file_path, '(^|/)\\.') AND CASE {NUMBER} % 4 WHEN 0 THEN {FILE_NAME} LIKE '%.py'
  ELSE NOT (list_has_any(string_split(file_path, '/'), [{DIRS}]) OR {FILE_NAME} IN ({NAMES}))
    AND NOT ({NUMBER} % 4 = 1 AND (list_has_any(string_split(file_path, '/'), ['app', 'lib']) OR {FILE_NAME} LIKE '%ReadMe.md')) END),
"""


@query(
    with_inputs("files", "questions", also=KEPT + CHUNKS.replace("FROM files", "FROM kept") + ",\n" + text_hits("questions"))
    + "SELECT repo_id, query_id, chunk_id, file_path, text, score, rank FROM hits"
)
def scan_to_retrieval(spark, sf):
    """Stored files, rules of each request, index, questions; one repository in four is not asked for"""
    root, path = scratch(spark, "repos").removeprefix("file:"), scratch(spark, "index")
    files = load(spark, sf, "files")
    write_texts(files.select(F.concat("repo_id", F.lit("/"), "file_path").alias("path"), "text"), root)
    number = F.substring("repo_id", 4, 9).cast("int") % 4
    requests = files.select("repo_id").distinct().filter(number != 3).select(
        "repo_id", F.when(number == 1, "./app/\n%2Flib%2F\n").alias("excluded_dir"), F.when(number == 1, "ReadMe.md").alias("excluded_file"),
        F.when(number == 0, "\n.py\n").alias("included_file"),
    )
    return r.retrieve(question_vectors(spark, sf), index_corpus(spark, root, path, requests=requests))
