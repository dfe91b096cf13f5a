"""Files, documents, chunks and stored tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from atlasloom.constants import CODE_SUFFIXES, DOC_SUFFIXES, EXCLUDED_DIRS, EXCLUDED_FILES
from atlasloom.functions import text as t, urls as u
from atlasloom.operators import catalogue, docs as d, embed, filters, scale
from atlasloom.plans.corpus import build_chunks, repo_dimension
from atlasloom.session import bound_batches, ensure_checkpoint_dir
from atlasloom.sources import corpus, index_store, wiki_cache

from . import query
from .inputs import load, table, with_inputs

CODE = ", ".join(f"'{s[1:]}'" for s in CODE_SUFFIXES)
KNOWN = ", ".join(f"'{s[1:]}'" for s in (*CODE_SUFFIXES, *DOC_SUFFIXES))
DIRS = ", ".join(sorted({"'" + x.strip("./") + "'" for x in EXCLUDED_DIRS}))
NAMES = ", ".join(f"'{x}'" for x in EXCLUDED_FILES)
SUFFIX = r"regexp_extract(file_path, '\.([^./]+)$', 1)"
FILE_NAME = "list_last(string_split(file_path, '/'))"

DOCS = f"""docs AS (
  SELECT repo_id, doc_ord, file_path, text, {SUFFIX} AS type, {SUFFIX} IN ({CODE}) AS is_code,
    CAST(length(text) // 4 AS INTEGER) AS token_count
  FROM files WHERE {SUFFIX} IN ({KNOWN}))"""
CHUNKS = DOCS + """,
small AS (SELECT * FROM docs WHERE token_count <= CASE WHEN is_code THEN 81920 ELSE 8192 END),
chunks AS (
  SELECT repo_id, doc_ord, file_path, CAST(i AS INTEGER) AS chunk_no,
    array_to_string(list_slice(w, i * 250 + 1, i * 250 + 350), ' ') AS text,
    repo_id || '#' || file_path || '#' || CAST(i AS STRING) AS chunk_id
  FROM (SELECT *, string_split(text, ' ') AS w FROM small) s,
    LATERAL (SELECT unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - 350) / 250.0) AS BIGINT)))) AS i))"""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")


def write_texts(rows: DataFrame, root: str) -> None:
    """Rows (`path`, `text`) as files below `root`, written by the tasks on any file system."""

    def write(frames):
        import pandas as pd
        from pyarrow import fs as pafs

        system, base = pafs.FileSystem.from_uri(root)
        for frame in frames:
            for path, text in frame.itertuples(index=False):
                target = f"{base}/{path}"
                system.create_dir(os.path.dirname(target), recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(text.encode())
            yield pd.DataFrame({"n": [len(frame)]})

    bound_batches(rows.sparkSession)
    rows.mapInPandas(write, "n int").agg(F.sum("n")).collect()


def write_pieces(rows: DataFrame, root: str) -> None:
    """Rows (`path`, `seq`, `piece`) as files below `root`: the pieces of a path in order. A task writes them as they come and holds no file whole."""

    def write(frames):
        import pandas as pd
        from pyarrow import fs as pafs

        system, base = pafs.FileSystem.from_uri(root)
        opened = out = None
        for frame in frames:
            for path, piece in frame.itertuples(index=False):
                if path != opened:
                    if out:
                        out.close()
                    target = f"{base}/{path}"
                    system.create_dir(os.path.dirname(target), recursive=True)
                    opened, out = path, system.open_output_stream(target)
                out.write(piece.encode())
            yield pd.DataFrame({"n": [len(frame)]})
        if out:
            out.close()

    bound_batches(rows.sparkSession)
    sorted_rows = rows.repartition("path").sortWithinPartitions("path", "seq").select("path", "piece")
    sorted_rows.mapInPandas(write, "n int").agg(F.sum("n")).collect()


def remove_files(names: DataFrame, root: str) -> None:
    """Delete the files `path` below `root`, in the tasks."""

    def remove(frames):
        from pyarrow import fs as pafs

        system, base = pafs.FileSystem.from_uri(root)
        for frame in frames:
            for path in frame["path"]:
                system.delete_file(f"{base}/{path}")
            yield frame

    names.select("path").mapInPandas(remove, "path string").write.format("noop").mode("overwrite").save()


def write_files(spark: SparkSession, sf: str) -> str:
    """The documents as real files."""
    root = scratch(spark, "files").removeprefix("file:")
    files = load(spark, sf, "files", heavy=True)
    write_texts(files.select(F.concat_ws("/", "repo_id", "file_path").alias("path"), "text"), root)
    return root


@query(
    with_inputs("files")
    + f"""SELECT repo_id, file_path, row_number() OVER (PARTITION BY repo_id
      ORDER BY list_position([{KNOWN}], {SUFFIX}), file_path) - 1 AS doc_ord, length(text) AS n_chars
    FROM files WHERE {SUFFIX} IN ({KNOWN}) AND file_path NOT LIKE '.%'"""
)
def corpus_scan(spark, sf):
    """A1, G1"""
    found = corpus.scan_corpus(spark, write_files(spark, sf))
    return found.select("repo_id", "file_path", "doc_ord", F.char_length("text").cast("bigint").alias("n_chars"))


@query(
    with_inputs("files")
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path) - 1 AS line_no
      FROM files WHERE file_path NOT LIKE '.%' AND file_path NOT LIKE 'node_modules/%')
    SELECT repo_id, string_agg(file_path, chr(10) ORDER BY line_no) AS file_tree
    FROM numbered GROUP BY ALL"""
)
def file_tree(spark, sf):
    """A2, F3"""
    return corpus.file_tree(load(spark, sf, "files"))


@query(
    with_inputs("files")
    + """SELECT repo_id, coalesce(arg_min(text, file_path) FILTER (WHERE file_path LIKE '%/ReadMe.md'), '') AS readme
    FROM files WHERE file_path NOT LIKE '.%' AND file_path NOT LIKE 'node_modules/%' GROUP BY repo_id"""
)
def pick_readme(spark, sf):
    """A3"""
    return corpus.pick_readme(load(spark, sf, "files"))


@query(
    with_inputs("files")
    + """SELECT repo_id,
      string_agg(file_path, chr(10) ORDER BY doc_ord // 1000, doc_ord % 2 DESC, doc_ord) AS file_tree
    FROM files WHERE doc_ord % 5 <> 0 GROUP BY repo_id"""
)
def tree_from_listing(spark, sf):
    """A4: folders (every fifth entry) are left out of the listing"""
    entry = F.struct(
        (F.lit(1) - F.col("doc_ord") % 2).alias("odd"), "doc_ord",
        F.when(F.col("doc_ord") % 5 == 0, F.lit("tree")).otherwise(F.lit("blob")).alias("type"),
        F.col("file_path").alias("path"),
    )
    rows = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["type"].alias("type"), e["path"].alias("path")))
    pages = load(spark, sf, "files").groupBy("repo_id", F.floor(F.col("doc_ord") / 1000).alias("page_no")).agg(
        F.to_json(rows).alias("payload")
    )
    return corpus.tree_from_listing(pages)


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 NOT IN (3, 5) THEN text END AS text,
      CASE doc_id % 7 WHEN 3 THEN 'Failed to get file content: GitHub API error: Not Found'
        WHEN 5 THEN 'Failed to get file content: Unexpected encoding: none' END AS error
    FROM documents"""
)
def decode_contents(spark, sf):
    """A5"""
    body = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "(.{60})", "$1\n")
    ok = F.to_json(F.struct(body.alias("content"), F.when(F.col("doc_id") % 7 == 5, "none").otherwise("base64").alias("encoding")))
    refused = F.lit('{"message": "Not Found", "documentation_url": "https://example.org"}')
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 7 == 3, refused).otherwise(ok).alias("payload")
    )
    return corpus.decode_contents(rows).select("doc_id", "text", "error")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 6 <> 0 THEN CASE WHEN doc_id % 6 = 1 THEN '{"message": ' || text ELSE text END END AS text,
      CASE WHEN doc_id % 6 = 0 THEN 'Failed to get file content: GitLab API error: ' || source END AS error
    FROM documents"""
)
def detect_error_payload(spark, sf):
    """A6"""
    key = F.col("doc_id") % 6
    content = (
        F.when(key == 0, F.concat(F.lit('{"message": "'), "source", F.lit('"}')))
        .when(key == 1, F.concat(F.lit('{"message": '), "text")).otherwise(F.col("text"))
    )
    rows = table(spark, sf, "documents").select("doc_id", "source", content.alias("content"))
    return corpus.detect_error_payload(rows).select("doc_id", "text", "error")


@query(
    with_inputs("files", also=CHUNKS)
    + "SELECT repo_id, count(*) AS n_chunks, count(DISTINCT doc_ord) AS n_docs FROM chunks GROUP BY repo_id"
)
def index_read_through(spark, sf):
    """Built and stored, then read back"""
    path = scratch(spark, "index")
    files = load(spark, sf, "files").select("repo_id", "doc_ord", "file_path", "text")
    index_store.load_or_build_index(spark, path, files, build_chunks, {"v": 1})
    again = index_store.load_or_build_index(spark, path, files, build_chunks, {"v": 1})
    return again.filter("dim = 256").groupBy("repo_id").agg(
        F.count("*").alias("n_chunks"), F.countDistinct("doc_ord").alias("n_docs")
    )


SMALL = CHUNKS.replace("250", "150").replace("350", "200")


@query(with_inputs("files", also=SMALL) + "SELECT repo_id, file_path, CAST(chunk_no AS BIGINT) AS chunk_no, md5(text) AS text FROM chunks")
def index_settings_change(spark, sf):
    """Settings change for some repositories first, then the others are asked for: all have the new chunks"""
    path = scratch(spark, "index")
    files = load(spark, sf, "files").select("repo_id", "doc_ord", "file_path", "text")
    small = lambda docs: build_chunks(docs, size=200, overlap=50, dim=8)
    index_store.load_or_build_index(spark, path, files, lambda docs: build_chunks(docs, dim=8), {"v": 1})
    index_store.load_or_build_index(spark, path, files.filter("hash(repo_id) % 2 = 0"), small, {"v": 2})
    index_store.load_or_build_index(spark, path, files.filter("hash(repo_id) % 2 <> 0"), small, {"v": 2})
    stored = index_store.read_index(spark, path)
    return stored.select("repo_id", "file_path", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("text").alias("text"))


@query(
    """SELECT source AS repo_id, count(*) AS n_docs, count(DISTINCT text) AS n_texts FROM documents GROUP BY source
    UNION ALL SELECT 'cache', count(DISTINCT text), count(DISTINCT text) FROM documents"""
)
def embedding_cache(spark, sf):
    """Equal texts are embedded once; a second run finds everything in the cache"""
    files = load(spark, sf, "files").select("repo_id", "doc_ord", "text")
    empty = spark.createDataFrame([], "model string, text_hash string, vector array<float>")
    _, cache = embed.embed_with_cache(files, empty, dim=16)
    cache = cache.checkpoint()
    embedded, _ = embed.embed_with_cache(files, cache, dim=16)
    per_repo = embedded.filter(F.size("vector") == 16).groupBy("repo_id").agg(
        F.count("*").alias("n_docs"), F.countDistinct("text").alias("n_texts")
    )
    return per_repo.unionByName(
        cache.agg(F.lit("cache").alias("repo_id"), F.count("*").alias("n_docs"), F.countDistinct("text_hash").alias("n_texts"))
    )


LANG = "CASE WHEN language = 'de' THEN 'en' ELSE language END"
NEWEST = f"""newest AS (
  SELECT repo_type, owner, repo, {LANG} AS language, arg_max(payload, updated_at) AS payload, max(updated_at) AS updated_at
  FROM stored_wikis GROUP BY ALL)"""


def stored_cache(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "stored_wikis")
    return wiki_cache.upsert_wiki(rows.limit(0), rows)


@query(with_inputs("stored_wikis", also=NEWEST) + "SELECT * FROM newest")
def wiki_cache_upsert(spark, sf):
    """Through the stored table"""
    path = scratch(spark, "cache")
    rows = load(spark, sf, "stored_wikis")
    wiki_cache.write_wiki_cache(spark, path, rows.filter("updated_at % 2 = 0"))
    wiki_cache.write_wiki_cache(spark, path, rows.filter("updated_at % 2 = 1"))
    return wiki_cache.read_wiki_cache(spark, path)


KEYS = "SELECT DISTINCT repo_type, owner, repo, {} AS language FROM stored_wikis"


def asked_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored key, with languages that are stored, unsupported or not stored."""
    rows = load(spark, sf, "stored_wikis").select(*wiki_cache.KEY)
    return rows.withColumn(
        "language", F.expr("CASE language WHEN 'fr' THEN 'xx' WHEN 'es' THEN 'ja' ELSE language END")
    ).distinct()


ASKED = "asked AS (" + KEYS.format("CASE language WHEN 'fr' THEN 'xx' WHEN 'es' THEN 'ja' ELSE language END") + ")"


@query(
    with_inputs("stored_wikis", also=NEWEST + ",\n" + ASKED)
    + """, resolved AS (SELECT repo_type, owner, repo,
        CASE WHEN language IN ('de', 'xx') THEN 'en' ELSE language END AS language FROM asked)
    SELECT r.repo_type, r.owner, r.repo, r.language, n.payload, n.updated_at FROM resolved r LEFT JOIN newest n
      ON r.repo_type = n.repo_type AND r.owner = n.owner AND r.repo = n.repo AND r.language = n.language"""
)
def wiki_cache_read(spark, sf):
    """A11"""
    return wiki_cache.read_wiki(stored_cache(spark, sf), asked_keys(spark, sf))


@query(
    with_inputs("stored_wikis", also=NEWEST + ",\n" + ASKED)
    + """SELECT a.repo_type, a.owner, a.repo, a.language, CASE WHEN a.language IN ('de', 'xx') THEN 'Language is not supported'
        WHEN n.owner IS NULL THEN 'Wiki cache not found'
        ELSE 'Wiki cache for ' || a.owner || '/' || a.repo || ' (' || a.language || ') deleted successfully' END AS status,
      n.owner IS NOT NULL AND a.language NOT IN ('de', 'xx') AS deleted
    FROM asked a LEFT JOIN newest n
      ON a.repo_type = n.repo_type AND a.owner = n.owner AND a.repo = n.repo AND a.language = n.language"""
)
def wiki_cache_delete(spark, sf):
    """Status per key"""
    return wiki_cache.delete_wiki(stored_cache(spark, sf), asked_keys(spark, sf))[1]


@query(
    with_inputs("stored_wikis", also=NEWEST + ",\n" + ASKED)
    + """SELECT n.* FROM newest n ANTI JOIN asked a
      ON a.repo_type = n.repo_type AND a.owner = n.owner AND a.repo = n.repo AND a.language = n.language"""
)
def wiki_cache_remaining(spark, sf):
    """What is left after the deletion"""
    return wiki_cache.delete_wiki(stored_cache(spark, sf), asked_keys(spark, sf))[0]


STORED = """named AS (
  SELECT source || '_' || lang || '_' || CAST(doc_id AS STRING) AS repo, doc_id, 'own' || CAST(doc_id % 9 AS STRING) AS owner,
    'wiki_cache_github_own' || CAST(doc_id % 9 AS STRING) || '_' || source || '_' || lang || '_' || CAST(doc_id AS STRING) || '_'
      || lang || '.json' AS id, lang FROM documents)"""


def project_files(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.projects_from_files(
        table(spark, sf, "documents").select(
            F.concat(
                F.lit("wiki_cache_github_own"), F.col("doc_id") % 9, F.lit("_"), "source", F.lit("_"), "lang", F.lit("_"),
                "doc_id", F.lit("_"), "lang", F.lit(".json"),
            ).alias("file_name"),
            F.timestamp_millis(F.col("doc_id") * 1000).alias("modified"),
        )
    )


@query(
    "WITH " + STORED
    + """SELECT id, owner, repo, owner || '/' || repo AS name, 'github' AS repo_type, doc_id * 1000 AS "submittedAt", lang AS language
    FROM named"""
)
def project_catalogue(spark, sf):
    """A13, H9, F1"""
    return catalogue.newest_first(project_files(spark, sf))


@query(
    "WITH " + STORED
    + """SELECT id, owner, repo, owner || '/' || repo AS name, 'github' AS repo_type, doc_id * 1000 AS "submittedAt", lang AS language
    FROM named WHERE contains(lower(repo), 'src1_e') OR contains(owner || '/' || repo, 'src1_e')
    ORDER BY doc_id DESC LIMIT 25"""
)
def project_search(spark, sf):
    """The cap is the feature"""
    return catalogue.search_projects(project_files(spark, sf), "SRC1_E", 25)


@query("WITH " + STORED + """SELECT owner, count(*) AS n FROM named WHERE doc_id % 4 <> 0 GROUP BY owner""")
def project_removal(spark, sf):
    """Projects stored at a full fourth second are deleted"""
    projects = project_files(spark, sf)
    left = catalogue.remove_projects(projects, projects.filter("submittedAt % 4000 = 0").select("id"))
    return left.groupBy("owner").agg(F.count("*").alias("n"))


@query(
    with_inputs("files")
    + f"""SELECT repo_id, file_path FROM files
    WHERE NOT list_has_any(string_split(file_path, '/'), [{DIRS}]) AND {FILE_NAME} NOT IN ({NAMES})"""
)
def filter_exclude(spark, sf):
    """B1, B3"""
    return filters.filter_paths(load(spark, sf, "files").select("repo_id", "file_path"))


@query(
    with_inputs("files")
    + f"""SELECT repo_id, file_path FROM files WHERE list_has_any(string_split(file_path, '/'), ['docs', 'src'])
      OR {FILE_NAME} LIKE '%.min.js' OR {FILE_NAME} = 'ReadMe.md'"""
)
def filter_include(spark, sf):
    """B2"""
    return filters.filter_paths(
        load(spark, sf, "files").select("repo_id", "file_path"), ["./docs/", "src"], [".min.js", "ReadMe.md"], "include"
    )


@query(
    with_inputs("files")
    + f"""SELECT repo_id, file_path FROM files WHERE CASE
      WHEN CAST(substr(repo_id, 4) AS INTEGER) % 3 = 0 THEN {FILE_NAME} LIKE '%.py'
      WHEN CAST(substr(repo_id, 4) AS INTEGER) % 3 = 1 THEN NOT list_has_any(string_split(file_path, '/'), ['build', 'app'])
      ELSE TRUE END"""
)
def filter_rules(spark, sf):
    """Rules per repository, merged from two tables"""
    files = load(spark, sf, "files").select("repo_id", "file_path")
    repos = files.select("repo_id").distinct()
    kind = F.substr("repo_id", F.lit(4)).cast("int") % 3
    include = repos.filter(kind == 0).select("repo_id", F.lit("included_file").alias("kind"), F.lit(".py").alias("pattern"))
    exclude = repos.filter(kind < 2).select(
        "repo_id", F.lit("excluded_dir").alias("kind"), F.explode(F.array(F.lit("./build/"), F.lit("app"))).alias("pattern")
    )
    return filters.filter_paths_by_rules(files, filters.merge_rules(include, exclude, exclude))


@query(
    """SELECT page_id, url AS first, CAST(2 AS INTEGER) AS n, 'x+y%' AS last FROM pages"""
)
def filter_strings(spark, sf):
    """B5"""
    encoded = F.replace(F.col("url"), F.lit("/"), F.lit("%2F"))
    raw = F.concat(encoded, F.lit("\n \n"), F.lit("x+y%"))
    parsed = t.parse_filter_string(raw)
    return table(spark, sf, "pages").select(
        "page_id", F.element_at(parsed, 1).alias("first"), F.size(parsed).alias("n"), F.element_at(parsed, -1).alias("last")
    )


@query(
    with_inputs("files", also=DOCS)
    + """SELECT doc_ord, type, is_code, is_code AND NOT starts_with(file_path, 'test_') AND NOT starts_with(file_path, 'app_')
        AND NOT contains(lower(file_path), 'test') AS is_implementation, file_path AS title, token_count,
      CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS n_words
    FROM docs"""
)
def doc_columns(spark, sf):
    """B7, H1, H2"""
    return d.derive_doc_columns(load(spark, sf, "files", heavy=True)).select(
        "doc_ord", "type", "is_code", "is_implementation", "title", "token_count",
        t.estimate_tokens(F.col("text")).alias("n_words"),
    )


@query(
    with_inputs("files", also=DOCS)
    + """SELECT doc_ord, token_count * 30 AS token_count FROM docs
    WHERE token_count * 30 <= CASE WHEN is_code THEN 81920 ELSE 8192 END"""
)
def drop_oversized(spark, sf):
    """Counts are scaled so that both limits apply"""
    docs = d.derive_doc_columns(load(spark, sf, "files", heavy=True))
    return d.drop_oversized(docs.withColumn("token_count", F.col("token_count") * 30)).select("doc_ord", "token_count")


@query(with_inputs("files", also=DOCS) + "SELECT repo_id, count(*) AS n_docs FROM docs GROUP BY repo_id")
def docs_by_repo(spark, sf):
    """D13"""
    return d.count_by_repo(d.all_documents(load(spark, sf, "files")))


@query(with_inputs("files", also=CHUNKS) + "SELECT chunk_id, repo_id, doc_ord, chunk_no, text FROM chunks")
def chunk_words(spark, sf):
    """H3"""
    docs = d.drop_oversized(d.derive_doc_columns(load(spark, sf, "files", heavy=True)))
    return d.chunk_words(docs).select("chunk_id", "repo_id", "doc_ord", "chunk_no", "text")


@query(
    with_inputs("files", also=CHUNKS)
    + """SELECT chunk_id, (row_number() OVER (ORDER BY doc_ord, chunk_no) - 1) // 25 AS batch_no FROM chunks"""
)
def batch_assignment(spark, sf):
    """E8"""
    docs = d.drop_oversized(d.derive_doc_columns(load(spark, sf, "files", heavy=True)))
    return d.assign_batches(d.chunk_words(docs), 25).select("chunk_id", "batch_no")


@query(
    """SELECT doc_id, replace(replace(s || ' ' || text || ' ' || url_encode(s), s, '***TOKEN***'), url_encode(s), '***TOKEN***') AS text
    FROM (SELECT *, split_part(text, ' ', 1) || '+/' AS s FROM documents)"""
)
def redacted(spark, sf):
    """The first word of a text is its secret"""
    secret = F.concat(F.substring_index("text", " ", 1), F.lit("+/"))
    text = F.concat(secret, F.lit(" "), "text", F.lit(" "), t.percent_encode(secret))
    return table(spark, sf, "documents").select("doc_id", t.redact(text, secret).alias("text"))


@query(
    """SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(replace(text, '. ', chr(10) || ' ' || chr(10)), chr(10))) AS line
      FROM documents) WHERE trim(line) <> '' GROUP BY doc_id"""
)
def blank_text_filter(spark, sf):
    """Lines of a text, some of them blank"""
    lines = table(spark, sf, "documents").select(
        "doc_id", F.explode(F.split(F.replace(F.col("text"), F.lit(". "), F.lit("\n \n")), "\n")).alias("text")
    )
    return filters.drop_blank_text(lines).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(
    """SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'es') THEN lang ELSE 'en' END AS language,
      CASE lang WHEN 'fr' THEN 'Français (French)' WHEN 'es' THEN 'Spanish (Español)' ELSE 'English' END AS language_name,
      CASE WHEN lang NOT IN ('en', 'fr', 'es') THEN 'Language is not supported' END AS error
    FROM documents"""
)
def languages(spark, sf):
    """B10, B11"""
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"))
    return filters.resolve_language(filters.check_language(rows))


@query(
    """SELECT event_id, user_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
      ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def latest_events(spark, sf):
    """E4"""
    rows = table(spark, sf, "events").drop("props")
    return scale.latest_wins(rows, ["user_id", "event_type"], "ts", "event_id")


@query(
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?)://([^:/?#]+)([^?#]*)', ['scheme', 'host', 'path']) AS m FROM pages)
    SELECT page_id, m.scheme || '://' || lower(m.host) AS domain, regexp_replace(regexp_replace(m.path, '^/', ''), '/$', '') AS path,
      regexp_extract(url, '([^/]*)$', 1) AS short_name, 'x.py' AS file_url,
      replace(list_last(string_split(rtrim(url, '/'), '/')), '.git', '') AS name FROM p"""
)
def url_parts(spark, sf):
    """H4, H6, H8, H27"""
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", u.url_domain(url).alias("domain"), u.url_path(url).alias("path"), u.repo_short_name(url).alias("short_name"),
        u.file_url(F.lit("web"), url, F.lit("main"), F.lit("x.py")).alias("file_url"),
        u.repo_name(url, F.lit("web")).alias("name"),
    )


@query(
    with_inputs("addresses")
    + r"""SELECT DISTINCT * FROM (
      SELECT 'github' AS type, 'org' || (page_id % 40) AS owner, 'repo' AS repo, CAST(NULL AS VARCHAR) AS local_path,
        'https://github.com/org' || (page_id % 40) || '/repo.git' AS repo_url, 'org' || (page_id % 40) || '_repo' AS repo_id,
        'repo.git' AS short_name, 'wiki_cache_github_org' || (page_id % 40) || '_repo_en.json' AS cache_key
      FROM addresses WHERE page_id % 5 = 0
      UNION ALL SELECT 'gitlab', 'sub', 'proj' || (page_id % 30), NULL, 'gitlab.com/group/sub/proj' || (page_id % 30),
        'proj' || (page_id % 30), 'proj' || (page_id % 30), 'wiki_cache_gitlab_sub_proj' || (page_id % 30) || '_en.json'
      FROM addresses WHERE page_id % 5 = 1
      UNION ALL SELECT 'local', 'local', 'proj' || (page_id % 20), '/srv/code/proj' || (page_id % 20), '/srv/code/proj' || (page_id % 20),
        'proj' || (page_id % 20), 'proj' || (page_id % 20), 'wiki_cache_local_local_proj' || (page_id % 20) || '_en.json'
      FROM addresses WHERE page_id % 5 = 2
      UNION ALL SELECT 'web', owner, repo, NULL, min(url), min(list_last(string_split(url, '/'))), min(list_last(string_split(url, '/'))),
        'wiki_cache_web_' || owner || '_' || repo || '_en.json'
      FROM (SELECT rtrim(url, '/') AS url, regexp_extract(url, '://[^/]+/([^/]+)/([^/?#]+)', 1) AS owner,
          regexp_extract(url, '://[^/]+/([^/]+)/([^/?#]+)', 2) AS repo FROM addresses WHERE page_id % 5 = 3)
      GROUP BY owner, repo)"""
)
def repositories(spark, sf):
    """J8 with H4, H5, H7, H9"""
    return repo_dimension(load(spark, sf, "addresses"))
