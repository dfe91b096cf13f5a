"""Operator inputs derived from the whole driver tables, in SQL that both engines run.

`@table` stands for a driver table and `@list(` for the array constructor. Every derived table
keeps all rows of its source, so the work grows with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from atlasloom.operators.scale import bounded_side

TITLE = "trim(substr(translate(text, chr(10) || '[]&<>#:|', '         '), 1, 40))"

INPUTS = {
    # documents as files of a repository per source
    "files": """
        SELECT source AS repo_id, doc_id AS doc_ord, lang, text,
          CASE WHEN doc_id % 31 = 0 THEN 'pkg' || CAST(doc_id AS STRING) || '/ReadMe.md' ELSE
            CASE doc_id % 10 WHEN 0 THEN 'src' WHEN 1 THEN 'docs' WHEN 2 THEN 'lib/tests' WHEN 3 THEN 'node_modules/pkg'
              WHEN 4 THEN 'app' WHEN 5 THEN 'build' WHEN 6 THEN 'src/core' WHEN 7 THEN '.github' ELSE lang END
            || '/' || CASE doc_id % 7 WHEN 0 THEN 'test_' WHEN 1 THEN 'app_' WHEN 2 THEN 'latest_' ELSE 'mod_' END
            || CAST(doc_id AS STRING)
            || CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.min.js' WHEN 3 THEN '.json'
              WHEN 4 THEN '.lock' ELSE '.ts' END
          END AS file_path
        FROM @documents""",
    # chat messages; some conversations are research requests that ask to continue
    "messages": """
        SELECT conv_id, turn, role,
          CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN '[DEEP RESEARCH] ' || text
            WHEN conv_id % 3 = 0 AND role = 'user' THEN ' [DEEP RESEARCH] Continue the research '
            ELSE text END AS content
        FROM @conversations""",
    # the same, with user messages that are too large in some conversations
    "long_messages": """
        SELECT conv_id, turn, role,
          CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN '[DEEP RESEARCH] ' || text
            WHEN conv_id % 3 = 0 AND role = 'user' THEN ' [DEEP RESEARCH] Continue the research '
            WHEN conv_id % 29 = 7 AND role = 'user' THEN repeat(text || ' ', CAST(floor(33000 / (length(text) + 1)) AS INT) + 1)
            ELSE text END AS content
        FROM @conversations""",
    # answers that carry research markers by position; four conversations make one, so there are more than five answers
    "answers": """
        SELECT conv_id - conv_id % 4 AS conv_id, turn + 1000 * (conv_id % 4) AS turn, role,
          CASE WHEN conv_id % 24 = 18 AND turn = 1 THEN '## Final Conclusion' || chr(10) || text ELSE CASE turn % 7 WHEN 1 THEN '## Research Plan' || chr(10) || text WHEN 3 THEN '## Research Update 2' || chr(10) || text
            WHEN 5 THEN text || chr(10) || '## Summary' || chr(10) || 'Next Steps' WHEN 0 THEN '## Conclusion' || chr(10) || text
            ELSE text END END AS content
        FROM @conversations""",
    # chat requests, one per conversation
    "requests": """
        SELECT conv_id, 'src' || CAST(conv_id % 20 AS STRING) AS repo_id,
          'https://github.com/org/src' || CAST(conv_id % 20 AS STRING) AS repo_url, 'github' AS repo_type,
          CASE WHEN conv_id % 4 = 0 THEN 'fr' ELSE 'en' END AS language,
          CASE WHEN conv_id % 5 = 0 THEN 'ollama' ELSE 'google' END AS provider,
          CASE WHEN conv_id % 2 = 0 THEN 'pkg' || CAST(conv_id * 31 AS STRING) || '/ReadMe.md' END AS file_path
        FROM @conversations GROUP BY conv_id""",
    # documents as pages of a wiki per source
    "wiki_pages": f"""
        SELECT d.source AS wiki_id, d.doc_id AS page_ord, 'page-' || CAST(d.doc_id AS STRING) AS page_id,
          {TITLE} AS title, d.text AS content, @list(d.lang || '/a.py', 'b ' || d.lang) AS file_paths,
          CASE WHEN l.quality = 1 THEN 'high' WHEN l.toxic = 1 THEN 'low' ELSE 'medium' END AS importance,
          CASE WHEN d.doc_id % 3 = 0 THEN @list('gone') ELSE
            @list('page-' || CAST(d.doc_id + 20 AS STRING), 'gone', 'page-' || CAST(d.doc_id - 20 AS STRING)) END AS related_pages
        FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id""",
    # generated texts: in wikis with an odd number some are empty, some belong to no page; the others are complete
    "generated": """
        SELECT source AS wiki_id,
          CASE WHEN doc_id % 13 = 0 AND CAST(substr(source, 4) AS INT) % 2 = 1 THEN 'lost-' ELSE 'page-' END
            || CAST(doc_id AS STRING) AS page_id,
          CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN '# T' || chr(10) || chr(10) || text
            WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 17 = 0 THEN 'Loading...'
            ELSE '# T' || chr(10) || chr(10) || substr(text, 1, 30) || chr(10) || chr(10) || text END AS content
        FROM @documents""",
    "wikis": """
        SELECT source AS wiki_id, 'https://github.com/org/' || source AS repo_url, 'github' AS type,
          'About ' || min(lang) AS description
        FROM @documents GROUP BY source""",
    # repositories on three hosts, and some that are local or on another one
    "hosted_wikis": """
        SELECT source AS wiki_id,
          CASE CAST(substr(source, 4) AS INT) % 5 WHEN 0 THEN 'https://github.com/org/' || source WHEN 1 THEN 'https://gitlab.com/group/sub/' || source
            WHEN 2 THEN 'https://bitbucket.org/org/' || source WHEN 3 THEN '/srv/' || source ELSE 'https://git.other.org/' || source END AS repo_url,
          CASE CAST(substr(source, 4) AS INT) % 5 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'bitbucket' WHEN 3 THEN 'local' ELSE 'web' END AS type
        FROM @documents GROUP BY source""",
    # parts as sections of 50 wikis: binary trees; number 48 is one chain, in 47 a section has two parents and leads back, 49 has none
    "sections": """
        SELECT 'w' || CAST(p_partkey % 50 AS STRING) AS wiki_id, CAST(floor(p_partkey / 50) AS BIGINT) AS sec_ord,
          's' || CAST(floor(p_partkey / 50) AS BIGINT) AS section_id, p_name AS title,
          @list('p' || CAST(p_partkey AS STRING), 'p' || CAST(p_partkey + 50 AS STRING), 'unknown') AS pages,
          CASE WHEN p_partkey % 50 = 48 THEN @list('s' || CAST(floor(p_partkey / 50) + 1 AS BIGINT))
            WHEN p_partkey % 50 = 47 AND floor(p_partkey / 50) = 5 THEN @list('s1', 's6')
            WHEN floor(p_partkey / 50) % 7 = 3 THEN @list('s' || CAST(floor(p_partkey / 50) AS BIGINT), 'none') ELSE
            @list('s' || CAST(floor(p_partkey / 50) * 2 + 1 AS BIGINT), 's' || CAST(floor(p_partkey / 50) * 2 + 2 AS BIGINT)) END
            AS subsections
        FROM @part WHERE p_partkey % 50 <> 49""",
    "section_pages": """
        SELECT 'w' || CAST(p_partkey % 50 AS STRING) AS wiki_id, p_partkey AS page_ord,
          CASE WHEN p_partkey % 9 = 0 THEN 'hidden' ELSE 'p' END || CAST(p_partkey AS STRING) AS page_id, p_type AS title
        FROM @part""",
    # vectors: one repository holds four of ten labels; every tenth vector is too short
    "vectors": """
        SELECT CASE WHEN label < 4 THEN 'hot' ELSE 'r' || CAST(label AS STRING) END AS repo_id, vec_id AS doc_ord,
          'v' || CAST(vec_id AS STRING) AS chunk_id, label,
          CASE WHEN vec_id % 10 = 0 THEN @slice32(embedding) WHEN vec_id % 37 = 0 THEN @slice0(embedding)
            ELSE embedding END AS vector
        FROM @embeddings""",
    "questions": """
        SELECT CAST(item_id AS STRING) AS query_id, 'src' || CAST(item_id % 20 AS STRING) AS repo_id, text FROM @benchmark""",
    # events as lines of a token stream per user
    "sse_lines": """
        SELECT 'u' || CAST(user_id AS STRING) AS req_id, event_id AS seq,
          CASE WHEN event_id % 401 = 400 THEN 'data: [DONE]'
            WHEN event_type = 'error' THEN ': comment' WHEN event_type = 'signup' THEN 'data: {"choices":[{"text":"t' || CAST(event_id AS STRING) || ' "}]}'
            WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'data: {broken'
            ELSE '  data: {"id":"c' || CAST(user_id AS STRING) || '","model":"' || event_type || '","created":' || CAST(event_id AS STRING)
              || ',"choices":[{"delta":{"content":"' || event_type || ' ' || CAST(event_id AS STRING) || '; "}}]}' END AS line
        FROM @events""",
    # stored wikis: the same key occurs many times, German is not a supported language
    "stored_wikis": """
        SELECT CASE doc_id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END AS repo_type, source AS owner,
          'repo_' || CAST(doc_id % 4 AS STRING) AS repo, lang AS language, text AS payload, doc_id AS updated_at
        FROM @documents""",
    "addresses": """
        SELECT page_id, url,
          CASE page_id % 5 WHEN 0 THEN 'https://github.com/org' || CAST(page_id % 40 AS STRING) || '/repo.git'
            WHEN 1 THEN ' gitlab.com/group/sub/proj' || CAST(page_id % 30 AS STRING) || '/'
            WHEN 2 THEN '/srv/code/proj' || CAST(page_id % 20 AS STRING) WHEN 3 THEN url ELSE 'word' END AS input
        FROM @pages""",
}


def table(spark: SparkSession, sf: str, name: str, heavy: bool = False) -> DataFrame:
    """A driver table. For work that is heavy per row, a table that is read in fewer splits than
    there are cores is spread by its key; a table of many splits is read as it is."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if heavy and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, df.columns[0])
    return df


def load(spark: SparkSession, sf: str, name: str, heavy: bool = False) -> DataFrame:
    text = INPUTS[name].replace("@list(", "array(")
    text = re.sub(r"@slice(\d+)\((\w+)\)", r"slice(\2, 1, \1)", text)
    for given in set(re.findall(r"@(\w+)", text)):
        df = table(spark, sf, given, heavy)
        if given == "labels":  # joined to whole texts, which are not shuffled for it while it is small
            df = bounded_side(df)
        df.createOrReplaceTempView(f"given_{given}")
    return spark.sql(re.sub(r"@(\w+)", r"given_\1", text))


def with_inputs(*names: str, also: str = "") -> str:
    """The derived tables as common table expressions for DuckDB."""
    parts = []
    for name in names:
        text = INPUTS[name].replace("@list(", "list_value(")
        text = re.sub(r"@slice(\d+)\((\w+)\)", r"list_slice(\2, 1, \1)", text)
        parts.append(f"{name} AS ({re.sub(r'@(\w+)', r'\1', text)})")
    return "WITH RECURSIVE " + ",\n".join(parts + ([also] if also else [])) + "\n"
