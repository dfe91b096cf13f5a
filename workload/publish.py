"""Exports, decks and workshops."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasloom.operators import publish as p
from atlasloom.operators.scale import ordered_md5
from atlasloom.operators.wiki import attach_content
from atlasloom.plans.wikis import derive_decks, publish_wiki, slide_pages, slide_plans, stored_wiki_tables as tables_of, workshops
from atlasloom.sources import wiki_cache
from atlasloom.sources.wiki_cache import KEY

from . import query
from .corpus import scratch
from .inputs import load, table, with_inputs
from .wikis import COMPLETE, RELATED

STAMP = "2024-01-01 00:00:00"
NL2 = "chr(10) || chr(10)"
FILLED = """filled AS (SELECT p.* REPLACE (coalesce(nullif(g.content, ''), 'Content not generated') AS content)
  FROM wiki_pages p LEFT JOIN generated g ON p.wiki_id = g.wiki_id AND p.page_id = g.page_id)"""
MARKDOWN = f"""bodies AS (SELECT wiki_id, page_ord, '- [' || title || '](#' || page_id || ')' || chr(10) AS toc,
    '<a id=''' || page_id || '''></a>' || {NL2} || '## ' || title || {NL2} || '### Related Pages' || {NL2}
    || CASE WHEN links IS NOT NULL THEN 'Related topics: ' || links || {NL2} ELSE '' END
    || content || {NL2} || '---' || {NL2} AS body
  FROM filled LEFT JOIN links USING (wiki_id, page_ord)),
markdown AS (SELECT wiki_id, '# Wiki Documentation for https://github.com/org/' || wiki_id || {NL2}
    || 'Generated on: {STAMP}' || {NL2} || '## Table of Contents' || {NL2} || string_agg(toc, '' ORDER BY page_ord) || chr(10)
    || string_agg(body, '' ORDER BY page_ord) AS markdown FROM bodies GROUP BY wiki_id)"""
JSON = f"""json_docs AS (SELECT wiki_id,
    '{{"metadata":{{"repository":"https://github.com/org/' || wiki_id || '","generated_at":"{STAMP}","page_count":' || count(*) || '}},"pages":['
    || string_agg(to_json({{'id': page_id, 'title': title, 'content': content, 'filePaths': file_paths, 'importance': importance,
      'relatedPages': related_pages}})::VARCHAR, ',' ORDER BY page_ord) || ']}}' AS json FROM filled GROUP BY wiki_id)"""


def filled(spark, sf):
    return attach_content(load(spark, sf, "wiki_pages"), load(spark, sf, "generated"))


@query(with_inputs("wiki_pages", "generated", also=RELATED + ",\n" + FILLED + ",\n" + MARKDOWN) + "SELECT * FROM markdown")
def markdown_export(spark, sf):
    """A14, C2, C5"""
    return p.export_markdown(filled(spark, sf), load(spark, sf, "wikis"), STAMP)


@query(with_inputs("wiki_pages", "generated", also=FILLED + ",\n" + JSON) + "SELECT * FROM json_docs")
def json_export(spark, sf):
    """A15"""
    return p.export_json(filled(spark, sf), load(spark, sf, "wikis"), STAMP)


READY = COMPLETE + """,
ready AS (SELECT wiki_id FROM per_wiki JOIN counted USING (wiki_id) WHERE all_done AND n_generated >= n_pages)"""


@query(
    with_inputs("wiki_pages", "generated", "wikis", also=READY)
    + """SELECT 'github' AS repo_type, 'org' AS owner, w.wiki_id AS repo, 'en' AS language, w.repo_url, 1 AS updated_at,
      count(*) AS n_pages, md5(string_agg(p.page_id || ':' || p.title || ':' || g.content, chr(10) ORDER BY page_ord)) AS pages
    FROM wikis w JOIN ready USING (wiki_id) JOIN wiki_pages p ON p.wiki_id = w.wiki_id
      JOIN generated g ON g.wiki_id = p.wiki_id AND g.page_id = p.page_id GROUP BY ALL
    UNION ALL SELECT 'github', 'org', wiki_id, 'en', 'old', 0, 0, NULL FROM wikis WHERE wiki_id NOT IN (SELECT wiki_id FROM ready)"""
)
def published_wikis(spark, sf):
    """Complete wikis replace their stored rows, with all their pages; others stay"""
    stored = publish(spark, sf)["cache"]
    text = F.concat_ws(":", "stored_page.page_id", "stored_page.title", "stored_page.content").alias("text")
    pages = stored.filter("part = 'page'").select(*KEY, "stored_page.page_ord", text)
    digests = ordered_md5(pages, KEY, "page_ord", "text", "pages", "\n")
    return stored.filter("part IS NULL").join(digests, KEY, "left").select(
        *KEY, "repo_url", "updated_at", F.coalesce("n", F.lit(0)).alias("n_pages"), "pages"
    )


def publish(spark, sf):
    wikis = load(spark, sf, "wikis").withColumns(
        {"repo_type": F.lit("github"), "owner": F.lit("org"), "repo": F.col("wiki_id"), "language": F.lit("en"), "updated_at": F.lit(1)}
    )
    cache = wikis.select(*KEY, "wiki_id", F.lit("old").alias("repo_url"), F.lit(0).alias("updated_at"))
    return publish_wiki(wikis, load(spark, sf, "wiki_pages"), load(spark, sf, "generated"), cache, STAMP)


@query(
    with_inputs("wiki_pages", "generated", also=READY)
    + """SELECT p.wiki_id, page_ord, p.page_id, title, importance, file_paths[1] AS first_file, len(related_pages) AS n_related,
      md5(g.content) AS content
    FROM wiki_pages p JOIN ready USING (wiki_id) JOIN generated g ON g.wiki_id = p.wiki_id AND g.page_id = p.page_id"""
)
def stored_wiki_tables(spark, sf):
    """Complete wikis through the stored cache and back to pages"""
    path = scratch(spark, "wikis")
    wiki_cache.write_wiki_cache(spark, path, publish(spark, sf)["stored"])
    pages = tables_of(wiki_cache.read_wiki_cache(spark, path))["pages"]
    return pages.select(
        "wiki_id", "page_ord", "page_id", "title", "importance", F.get("file_paths", F.lit(0)).alias("first_file"),
        F.size("related_pages").cast("long").alias("n_related"), F.md5("content").alias("content"),
    )


BUDGET = f"""sized AS (
  SELECT p.wiki_id, p.page_ord, CAST(p.importance <> 'high' AS INTEGER) AS rest,
    '## ' || p.title || chr(10) || g.content || {NL2} AS whole,
    '## ' || p.title || chr(10) || trim(CASE WHEN regexp_matches(g.content, '# [^\\n]*?\\n\\n([^\\n]*?)(\\n\\n|\\z)')
      THEN regexp_extract(g.content, '# [^\\n]*?\\n\\n([^\\n]*?)(\\n\\n|\\z)', 1) ELSE 'No summary available' END) || {NL2} AS brief
  FROM wiki_pages p JOIN generated g ON p.wiki_id = g.wiki_id AND p.page_id = g.page_id WHERE g.content <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY wiki_id ORDER BY rest, page_ord) AS n FROM sized),
walk(wiki_id, n, total, started, text) AS (
  SELECT wiki_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE, '## Project Overview' || chr(10) || description || {NL2} FROM wikis
  UNION ALL
  SELECT w.wiki_id, r.n, CASE WHEN open THEN w.total + length(piece) ELSE w.total END, w.started OR (open AND r.rest = 1),
    CASE WHEN open THEN w.text || piece ELSE w.text END
  FROM walk w JOIN ranked r ON r.wiki_id = w.wiki_id AND r.n = w.n + 1,
    LATERAL (SELECT CASE WHEN r.rest = 0 OR w.started THEN w.total <= 30000 ELSE w.total < 30000 END AS open,
      CASE WHEN r.rest = 0 OR w.total + length(r.whole) <= 30000 THEN r.whole ELSE r.brief END AS piece)),
packed AS (SELECT wiki_id, arg_max(text, n) AS context FROM walk GROUP BY wiki_id)"""


@query(with_inputs("wiki_pages", "generated", "wikis", also=BUDGET) + "SELECT * FROM packed")
def context_pack(spark, sf):
    """E3, H16, J10"""
    return p.pack_context(load(spark, sf, "wiki_pages"), load(spark, sf, "generated"), load(spark, sf, "wikis"))


# every line of a text, whole, as an item of a plan in one of four notations; a fifth of the plans has lines that are no items
PREFIX = "CASE doc_id % 5 WHEN 0 THEN {0} || '. ' WHEN 1 THEN {0} || ') ' WHEN 2 THEN 'Slide ' || {0} || ': ' WHEN 3 THEN '- ' ELSE ': ' END"
DEFAULTS = """(VALUES (1, 'Title Slide', 'Introduction to r'), (2, 'Overview', 'Key features and purpose of r'),
  (3, 'Architecture', 'System components and structure'), (4, 'Features', 'Main capabilities and functionalities'),
  (5, 'Implementation', 'How it works and technical details'), (6, 'Use Cases', 'How to use r effectively'),
  (7, 'Conclusion', 'Summary and next steps')) AS v(slide_no, title, description)"""
# a numbered item is only seen where the next line is another one or the text ends: in a plan of another notation that is the last line,
# or the last but one where its number stands at the end
SLIDES = f"""lines AS (SELECT doc_id, i, trim(line) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)
  WHERE trim(line) <> ''),
placed AS (SELECT doc_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY doc_id) AS total,
  CASE WHEN line LIKE '%:' THEN line || '-' ELSE line END AS line FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
whole AS (SELECT doc_id, n, total, line, {PREFIX.format("n")} || line AS item FROM placed),
ends AS (SELECT doc_id, max(item) FILTER (WHERE n = total) AS last, coalesce(max(item) FILTER (WHERE n = total - 1), '') AS before FROM whole GROUP BY doc_id),
strays AS (SELECT doc_id, CASE
    WHEN doc_id % 5 > 0 AND regexp_matches(before, '[0-9]+\\.$') THEN last
    WHEN doc_id % 5 > 0 AND regexp_matches(last, '[0-9]+\\.\\s') THEN regexp_extract(last, '[0-9]+\\.\\s+(.*)$', 1)
    WHEN doc_id % 5 > 1 AND regexp_matches(before, '[0-9]+\\)$') THEN last
    WHEN doc_id % 5 > 1 AND regexp_matches(last, '[0-9]+\\)\\s') THEN regexp_extract(last, '[0-9]+\\)\\s+(.*)$', 1) END AS stray FROM ends),
items AS (
  SELECT doc_id, n, line AS item FROM whole JOIN strays USING (doc_id) WHERE stray IS NULL AND doc_id % 5 < 3
  UNION ALL SELECT doc_id, n, string_split(item, ':')[1] FROM whole JOIN strays USING (doc_id)
    WHERE stray IS NULL AND doc_id % 5 = 3 AND length(string_split(item, ':')[1]) > 3
      AND NOT contains(lower(string_split(item, ':')[1]), 'please') AND NOT contains(lower(string_split(item, ':')[1]), 'here')
  UNION ALL SELECT doc_id, 1, stray FROM strays WHERE stray IS NOT NULL)"""


@query(
    f"""WITH {SLIDES} SELECT 'd' || doc_id AS wiki_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS slide_no,
      trim(string_split(item, ':')[1]) AS title, trim(coalesce(string_split(item, ':')[2], '')) AS description FROM items
    UNION ALL SELECT 'd' || doc_id, slide_no, title, description FROM documents, {DEFAULTS} WHERE doc_id NOT IN (SELECT doc_id FROM items)"""
)
def slide_plan(spark, sf):
    """Every line of a text, whole, in four notations; plans without an item get the default slides"""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def item(x, i):
        number, whole = (i + 1).cast("string"), F.when(x.endswith(":"), F.concat(x, F.lit("-"))).otherwise(x)
        kind = F.col("doc_id") % 5
        return F.concat(
            F.when(kind == 0, F.concat(number, F.lit(". "))).when(kind == 1, F.concat(number, F.lit(") ")))
            .when(kind == 2, F.concat(F.lit("Slide "), number, F.lit(": "))).when(kind == 3, "- ").otherwise(": "),
            whole,
        )

    plans = table(spark, sf, "documents", heavy=True).select(
        F.concat(F.lit("d"), "doc_id").alias("wiki_id"), F.lit("r").alias("repo"), F.array_join(F.transform(lines, item), "\n").alias("plan")
    )
    return slide_plans(plans)


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN regexp_replace(html, '^\\s+|\\s+$', '', 'g')
      WHEN 2 THEN coalesce(nullif(regexp_extract(html, '(?is)<html.*?</html>', 0), ''), 'intro ' || substr(html, instr(html, '<html'))) ELSE regexp_extract('<div class="slide">' || html || '</div> </div>', '(?s)<div class="slide".*?</div>\\s*</div>', 0) END AS html
    FROM pages"""
)
def slide_page(spark, sf):
    """Raw, fenced, first element and slide division"""
    kind = F.col("page_id") % 4
    text = (
        F.when(kind == 0, F.col("html")).when(kind == 1, F.concat(F.lit("Here:\n```html\n"), "html", F.lit("\n```\ndone")))
        .when(kind == 2, F.concat(F.lit("intro "), F.substr("html", F.instr("html", F.lit("<html")))))
        .otherwise(F.concat(F.lit('<div class="slide">'), "html", F.lit("</div> </div> tail")))
    )
    return slide_pages(table(spark, sf, "pages", heavy=True).select("page_id", text.alias("text")))


NOTE = "'<div style=\"text-align: right; font-size: 0.85em; color: #666;\">' || chr(10) || "
SHOWN = NOTE + "'Exercise {0} of 3 | Estimated time: {1} minutes' || chr(10) || '</div>' || chr(10) || chr(10)"


def with_toc(name: str, source: str) -> str:
    """DuckDB form of H22 on `source` (`doc_id`, `text`): the list goes before the first `## ` behind the first `# `."""
    return f"""{name}_heads AS (SELECT doc_id, text, regexp_extract_all(text, '(?m)^## (.*)$', 1) AS heads, instr(text, '# ') AS intro FROM {source}),
{name}_place AS (SELECT *, instr(substr(text, intro + 1), '## ') + intro AS place FROM {name}_heads),
{name} AS (SELECT doc_id, CASE WHEN contains(text, '## Table of Contents') OR contains(text, '## Contents') OR len(heads) = 0 OR place <= intro THEN text
  ELSE substr(text, 1, place - 1) || '## Table of Contents' || {NL2} || array_to_string(list_transform(heads, lambda h: '- [' || h || '](#'
    || regexp_replace(regexp_replace(lower(h), '[^\\w\\s-]', '', 'g'), '\\s+', '-', 'g') || ')' || chr(10)), '') || chr(10) || substr(text, place) END AS text FROM {name}_place)"""


def noted(text: str, line: str, note: str) -> str:
    return f"replace({text}, '{line}' || chr(10), '{line}' || chr(10) || {note})"


WORKSHOP = f"""SELECT doc_id, '# Guide' || chr(10) || text || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '## Contents' || chr(10) ELSE '' END
  || '## Setup, now' || chr(10) || '## Exercise 1: start' || chr(10) || text || chr(10) || '## Exercise 2: go on (2.5 h)' || chr(10) || text || chr(10)
  || '## Exercise 3: end' || chr(10) || '## Final Project' || chr(10) || 'x' || chr(10) AS text FROM documents"""
EFFORT = NOTE + "'Estimated time: 20-30 minutes | Combines concepts from all exercises' || chr(10) || '</div>' || chr(10) || chr(10)"
ANNOTATED = noted(
    noted(noted(noted("text", "## Exercise 1: start", SHOWN.format(1, 5)), "## Exercise 2: go on (2.5 h)", SHOWN.format(2, 10)), "## Exercise 3: end", SHOWN.format(3, 15)),
    "## Final Project", EFFORT,
)


@query("WITH guides AS (" + WORKSHOP + "),\n" + with_toc("listed", "guides") + f"\nSELECT doc_id, {ANNOTATED} AS text FROM listed")
def workshop(spark, sf):
    """Whole texts with their numbers, colons and headings"""
    text = F.concat(
        F.lit("```markdown\n# Guide\n"), "text", F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "## Contents\n").otherwise(""),
        F.lit("## Setup, now\n## Exercise 1: start\n"), "text", F.lit("\n## Exercise 2: go on (2.5 h)\n"), "text",
        F.lit("\n## Exercise 3: end\n## Final Project\nx\n```"),
    )
    return workshops(table(spark, sf, "documents", heavy=True).select("doc_id", text.alias("text")))


@query(
    with_inputs(
        "wiki_pages", "generated", "wikis",
        also=BUDGET + ",\nbare AS (SELECT doc_id, regexp_replace('# Notes' || chr(10) || text || chr(10) || '## Last' || chr(10) || text, '```\\s*$', '') AS text FROM documents),\n" + with_toc("listed", "bare"),
    )
    + """SELECT 'context' AS kind, wiki_id AS id, md5(context) AS text FROM packed
    UNION ALL SELECT 'plan', wiki_id || ' ' || n, md5(CASE n WHEN 1 THEN 'T|' || description ELSE 'Next|2' END) FROM wikis, (SELECT unnest([1, 2]) AS n)
    UNION ALL SELECT 'slide', CAST(page_id AS VARCHAR), md5(regexp_replace(html, '^\\s+|\\s+$', '', 'g')) FROM pages
    UNION ALL SELECT 'workshop', CAST(doc_id AS VARCHAR), md5(text) FROM listed"""
)
def derived_decks(spark, sf):
    """J10 as one job: every text that it makes, by its hash"""
    pages, wikis = load(spark, sf, "wiki_pages"), load(spark, sf, "wikis")
    plans = wikis.select("wiki_id", F.lit("r").alias("repo"), F.concat(F.lit("1. T: "), "description", F.lit("\n2. Next: 2")).alias("plan"))
    slides = table(spark, sf, "pages", heavy=True).select("page_id", F.concat(F.lit("```html\n"), "html", F.lit("\n```")).alias("text"))
    texts = table(spark, sf, "documents", heavy=True).select(
        "doc_id", F.concat(F.lit("```markdown\n# Notes\n"), "text", F.lit("\n## Last\n"), "text").alias("text")
    )
    out = derive_decks(wikis, pages, load(spark, sf, "generated"), plans, slides, texts)

    def hashed(kind, df, key, text):
        return df.select(F.lit(kind).alias("kind"), key.cast("string").alias("id"), F.md5(text).alias("text"))

    return (
        hashed("context", out["contexts"], F.col("wiki_id"), F.col("context"))
        .unionByName(hashed("plan", out["plans"], F.concat_ws(" ", "wiki_id", "slide_no"), F.concat_ws("|", "title", "description")))
        .unionByName(hashed("slide", out["slides"], F.col("page_id"), F.col("html"))).unionByName(hashed("workshop", out["workshops"], F.col("doc_id"), F.col("text")))
    )
