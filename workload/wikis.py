"""Wiki tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from atlasloom.constants import CATEGORIES
from atlasloom.functions.markup import page_summary, strip_fences
from atlasloom.operators import wiki as w
from atlasloom.operators.scale import running_total
from atlasloom.plans.wikis import ingest_wiki
from atlasloom.sources.wiki_cache import list_projects, read_wiki_files

from . import query
from .corpus import scratch, write_pieces
from .inputs import load, table, with_inputs

# every wiki holds 25 consecutive documents of a source; one in four has a broken block
KEY = "wiki_id || '-' || CAST(CAST(floor(page_ord / 500) AS BIGINT) AS STRING)"
BROKEN = "CAST(floor(page_ord / 500) AS BIGINT) % 4 = 1"
LEVEL = "CASE page_ord % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'weird' END"


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Generated structures: fenced, with bare ampersands and control characters, some unparsable."""
    pages = load(spark, sf, "wiki_pages").select(
        F.expr(KEY).alias("wiki"), "page_ord", "page_id", "title", F.col("file_paths")[0].alias("path"),
        F.expr(BROKEN).alias("broken"), F.expr(LEVEL).alias("level"),
    )
    text = F.concat(
        F.lit('<page id="'), "page_id", F.lit('"><title>'), "title", F.lit(" & more\x02</title>"),
        F.coalesce(F.concat(F.lit("<importance>"), "level", F.lit("</importance>")), F.lit("")),
        F.lit("<relevant_files><file_path>"), "path", F.lit("</file_path><file_path></file_path></relevant_files>"),
        F.lit("<related_pages><related>page-1</related></related_pages></page>\n"),
    )
    blocks = pages.withColumn("text", text).groupBy("wiki").agg(
        F.expr("listagg(text, '') WITHIN GROUP (ORDER BY page_ord)").alias("pages"),
        F.min("page_id").alias("first"), F.bool_or("broken").alias("broken"),
    )
    section = (
        '<section id="one"><title>One</title><pages><page_ref>{0}</page_ref></pages><subsections><section_ref>two</section_ref>'
        '</subsections></section><section><title>Two</title></section><section id="three"><title>Three</title>'
        "<subsections><section_ref>three</section_ref></subsections></section>"
        '<section id="four"><!-- <section> --><section id="five"><title>Five</title><pages><page_ref>a &amp; b</page_ref></pages>'
        '<section id="six"><title>Six</title><subsections><section_ref>two</section_ref></subsections></section></section>'
        "<section id='seven'/><title>Four</title></section><section id=\"eight\"><title>Eight</title></section>"
    )
    body = F.concat(
        F.lit("```xml\n<wiki_structure>\n<title>Wiki &amp; "), "wiki", F.lit("</title><description>About it"),
        F.when(F.col("broken"), "<br>").otherwise(""), F.lit("</description><sections>"),
        F.replace(F.lit(section), F.lit("{0}"), F.col("first")), F.lit("</sections><pages>\n"), "pages",
        F.lit("</pages></wiki_structure> \n```"),
    )
    return blocks.select(F.col("wiki").alias("wiki_id"), body.alias("response"))


SPLIT = f"split AS (SELECT *, {KEY} AS wiki, {BROKEN} AS broken, {LEVEL} AS level FROM wiki_pages)"


@query(
    with_inputs("wiki_pages", also=SPLIT)
    + """SELECT wiki AS wiki_id, 'Wiki & ' || wiki AS title, 'About it' || CASE WHEN bool_or(broken) THEN '<br>' ELSE '' END AS description,
      bool_or(broken) AS rebuilt, CAST(NULL AS VARCHAR) AS error FROM split GROUP BY wiki"""
)
def wiki_from_xml(spark, sf):
    """header"""
    return ingest_wiki(responses(spark, sf))["wikis"]


@query(
    with_inputs("wiki_pages", also=SPLIT)
    + """SELECT wiki AS wiki_id, CAST(row_number() OVER (PARTITION BY wiki ORDER BY page_ord) - 1 AS INTEGER) AS page_ord, page_id,
      title || ' & more' AS title, file_paths[1] AS path, CASE level WHEN 'weird' THEN 'low' ELSE coalesce(level, 'medium') END AS importance,
      'page-1' AS related FROM split"""
)
def wiki_pages_from_xml(spark, sf):
    """pages"""
    return ingest_wiki(responses(spark, sf))["pages"].select(
        "wiki_id", "page_ord", "page_id", "title", F.array_join("file_paths", ",").alias("path"), "importance",
        F.array_join("related_pages", ",").alias("related"),
    )


@query(
    with_inputs("wiki_pages", also=SPLIT)
    + """SELECT wiki AS wiki_id, s.* FROM (SELECT wiki, min(page_id) AS first FROM split WHERE NOT broken GROUP BY wiki),
      LATERAL (VALUES (0, 'one', 'One', first, 'two', TRUE, 0, NULL), (1, 'section-2', 'Two', '', '', TRUE, 0, NULL), (2, 'three', 'Three', '', 'three', FALSE, 0, NULL),
        (3, 'four', 'Five', 'a & b', 'two', TRUE, 0, NULL), (4, 'five', 'Five', 'a & b', 'two', TRUE, 1, 'four'), (5, 'six', 'Six', '', 'two', TRUE, 2, 'five'),
        (6, 'seven', '', '', '', TRUE, 1, 'four'), (7, 'eight', 'Eight', '', '', TRUE, 0, NULL)) AS s(sec_ord, section_id, title, pages, subsections, is_root, depth, parent_id)"""
)
def wiki_sections_from_xml(spark, sf):
    """Sections; broken blocks lose theirs"""
    out = ingest_wiki(responses(spark, sf))
    roots = out["roots"].select("wiki_id", "section_id", F.lit(True).alias("root"))
    return out["sections"].join(roots, ["wiki_id", "section_id"], "left").select(
        "wiki_id", "sec_ord", "section_id", "title", "depth", "parent_id", F.array_join("pages", ",").alias("pages"),
        F.array_join("subsections", ",").alias("subsections"), F.coalesce("root", F.lit(False)).alias("is_root"),
    )


def case_of(title: str) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({title}), '{k}')" for k in words) + f" THEN '{name}'"
        for name, _, words in CATEGORIES
    )
    return f"CASE {arms} ELSE 'other' END"


@query(
    with_inputs("wiki_pages", also=SPLIT)
    + f"""SELECT wiki AS wiki_id, 'section-' || {case_of("title || ' & more'")} AS section_id, count(*) AS n_pages
    FROM split WHERE broken GROUP BY ALL"""
)
def wiki_inferred_sections(spark, sf):
    """Only wikis without sections get them from titles"""
    return ingest_wiki(responses(spark, sf))["inferred_sections"].select("wiki_id", "section_id", "n_pages")


TITLED = "p_name || ' ' || CASE p_partkey % 5 WHEN 0 THEN 'Overview' WHEN 1 THEN 'Maintenance' WHEN 2 THEN 'Server Setup' ELSE p_type END"


@query(
    f"""SELECT 'w' || (p_partkey % 50) AS wiki_id, 'page-' || p_partkey AS page_id, 'section-' || {case_of(f'({TITLED})')} AS parent_id FROM part"""
)
def cluster_titles(spark, sf):
    """D7, E5"""
    pages = table(spark, sf, "part").select(
        F.expr("'w' || CAST(p_partkey % 50 AS STRING)").alias("wiki_id"), F.expr("'page-' || CAST(p_partkey AS STRING)").alias("page_id"),
        F.expr(TITLED).alias("title"),
    )
    return w.cluster_pages(pages)[0].select("wiki_id", "page_id", "parent_id")


@query(
    f"""SELECT wiki_id, 'section-' || cat AS section_id, n_pages,
      CAST(list_position([{", ".join(repr(c[0]) for c in CATEGORIES)}, 'other'], cat) - 1 AS INTEGER) AS sec_ord FROM (
      SELECT 'w' || (p_partkey % 50) AS wiki_id, {case_of(f'({TITLED})')} AS cat, count(*) AS n_pages FROM part GROUP BY ALL)"""
)
def cluster_sections(spark, sf):
    """D7"""
    pages = table(spark, sf, "part").select(
        F.expr("'w' || CAST(p_partkey % 50 AS STRING)").alias("wiki_id"), F.expr(TITLED).alias("title")
    )
    return w.cluster_pages(pages)[1].select("wiki_id", "section_id", "n_pages", "sec_ord")


@query(
    with_inputs("wiki_pages")
    + """SELECT wiki_id, 'section-' || importance AS section_id, count(*) AS n_pages, CASE importance WHEN 'high' THEN 'Core Components'
      WHEN 'medium' THEN 'Key Features' ELSE 'Additional Information' END AS title FROM wiki_pages GROUP BY ALL"""
)
def importance_groups(spark, sf):
    """D8"""
    return w.group_by_importance(load(spark, sf, "wiki_pages"))[1].select("wiki_id", "section_id", "n_pages", "title")


RELATED = """links AS (
  SELECT a.wiki_id, a.page_ord, string_agg('[' || b.title || '](#' || b.page_id || ')', ', ' ORDER BY a.pos) AS links
  FROM (SELECT wiki_id, page_ord, unnest(related_pages) AS related_id, unnest(generate_series(1, len(related_pages))) AS pos FROM wiki_pages) a
  JOIN wiki_pages b ON a.wiki_id = b.wiki_id AND a.related_id = b.page_id GROUP BY ALL)"""


@query(with_inputs("wiki_pages", also=RELATED) + "SELECT * FROM links")
def related_pages(spark, sf):
    """C2"""
    return w.resolve_related(load(spark, sf, "wiki_pages"))


ROOTS = """refs AS (SELECT DISTINCT wiki_id, unnest(subsections) AS section_id FROM sections),
roots AS (SELECT s.* FROM sections s ANTI JOIN refs r ON s.wiki_id = r.wiki_id AND s.section_id = r.section_id)"""


@query(with_inputs("sections", also=ROOTS) + "SELECT wiki_id, section_id, title FROM roots")
def root_sections(spark, sf):
    """C3"""
    return w.root_sections(load(spark, sf, "sections")).select("wiki_id", "section_id", "title")


@query(
    with_inputs(
        "sections", "section_pages",
        also=ROOTS + """,
edges AS (SELECT e.wiki_id, e.parent, e.pos, c.section_id, c.title FROM (
    SELECT wiki_id, section_id AS parent, unnest(subsections) AS child, unnest(generate_series(0, len(subsections) - 1)) AS pos FROM sections) e
  JOIN sections c ON e.wiki_id = c.wiki_id AND e.child = c.section_id),
tree AS (
  SELECT wiki_id, section_id, title, 0 AS level, '0.' || lpad(CAST(sec_ord AS STRING), 19, '0') AS sort_path, [section_id] AS seen FROM roots
  UNION ALL
  SELECT t.wiki_id, e.section_id, e.title, t.level + 1, t.sort_path || '.1.' || lpad(CAST(e.pos AS STRING), 19, '0'), list_append(t.seen, e.section_id)
  FROM tree t JOIN edges e ON t.wiki_id = e.wiki_id AND t.section_id = e.parent WHERE NOT list_contains(t.seen, e.section_id)),
listed AS (SELECT t.wiki_id, t.level + 1 AS level, t.sort_path || '.0.' || lpad(CAST(r.pos AS STRING), 19, '0') AS sort_path, p.page_id, p.title
  FROM tree t JOIN (SELECT wiki_id, section_id, unnest(pages) AS page_id, unnest(generate_series(0, len(pages) - 1)) AS pos FROM sections) r
    ON t.wiki_id = r.wiki_id AND t.section_id = r.section_id
  JOIN section_pages p ON r.wiki_id = p.wiki_id AND r.page_id = p.page_id),
whole AS (SELECT wiki_id, sort_path, level, 'section' AS kind, section_id AS node_id, title FROM tree
  UNION ALL SELECT wiki_id, sort_path, level, 'page', page_id, title FROM listed
  UNION ALL SELECT wiki_id, lpad(CAST(page_ord AS STRING), 19, '0'), 0, 'page', page_id, title FROM section_pages
    WHERE wiki_id NOT IN (SELECT wiki_id FROM roots))""",
    )
    + """SELECT wiki_id, row_number() OVER (PARTITION BY wiki_id ORDER BY sort_path) - 1 AS ord, CAST(level AS INTEGER) AS level, kind, node_id, title FROM whole"""
)
def section_tree(spark, sf):
    """C4"""
    return w.traverse_tree(load(spark, sf, "sections"), load(spark, sf, "section_pages"))


@query(
    with_inputs("wiki_pages", "generated")
    + """SELECT p.wiki_id, p.page_id, coalesce(nullif(g.content, ''), 'Content not generated') AS content
    FROM wiki_pages p LEFT JOIN generated g ON p.wiki_id = g.wiki_id AND p.page_id = g.page_id"""
)
def attached_content(spark, sf):
    """C5"""
    out = w.attach_content(load(spark, sf, "wiki_pages"), load(spark, sf, "generated"))
    return out.select("wiki_id", "page_id", "content")


COMPLETE = """per_wiki AS (
  SELECT p.wiki_id, count(*) AS n_pages, bool_and(coalesce(g.content <> '' AND g.content <> 'Loading...', FALSE)) AS all_done
  FROM wiki_pages p LEFT JOIN generated g ON p.wiki_id = g.wiki_id AND p.page_id = g.page_id GROUP BY p.wiki_id),
counted AS (SELECT wiki_id, count(*) AS n_generated FROM generated GROUP BY wiki_id)"""


@query(
    with_inputs("wiki_pages", "generated", also=COMPLETE)
    + """SELECT p.wiki_id, n_pages, coalesce(n_generated, 0) AS n_generated, all_done, all_done AND coalesce(n_generated, 0) >= n_pages AS ready
    FROM per_wiki p LEFT JOIN counted c ON p.wiki_id = c.wiki_id"""
)
def wiki_completeness(spark, sf):
    """D9, B15"""
    return w.wiki_completeness(load(spark, sf, "wiki_pages"), load(spark, sf, "generated"))


@query(
    with_inputs("wiki_pages", "generated")
    + """SELECT p.wiki_id, p.page_id FROM wiki_pages p ANTI JOIN (SELECT * FROM generated WHERE content <> '') g
      ON p.wiki_id = g.wiki_id AND p.page_id = g.page_id"""
)
def pending_pages(spark, sf):
    """B15"""
    return w.pending_pages(load(spark, sf, "wiki_pages"), load(spark, sf, "generated")).select("wiki_id", "page_id")


FILE_OF = "'wiki_cache_github_' || wiki_id || '_wiki_en.json'"
CUT_SHORT = "CAST(substr(wiki_id, 4) AS INT) % 5 = 2"


def wiki_files(spark, sf) -> str:
    """A folder with the wikis as cached documents; one in five is cut short."""
    page = lambda content: F.struct(
        F.col("page_id").alias("id"), "title", content.alias("content"), F.col("file_paths").alias("filePaths"), "importance", F.col("related_pages").alias("relatedPages")
    )
    made = load(spark, sf, "generated").select("wiki_id", "page_id", F.col("content").alias("made"))
    rows = load(spark, sf, "wiki_pages").drop("content").join(made, ["wiki_id", "page_id"], "left")
    ends = rows.groupBy("wiki_id").agg(F.min("page_ord").alias("first"), F.min(F.when(F.col("made").isNotNull(), F.col("page_ord"))).alias("first_made"))
    rows = rows.join(ends.select("wiki_id", "first", "first_made"), "wiki_id")
    quoted = lambda c: F.expr(f"substr(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    comma = lambda first: F.when(F.col("page_ord") == F.col(first), "").otherwise(",")
    # a document as its pieces in order: parts are 2^50 positions apart
    piece = lambda part, text: F.struct((F.lit(part << 50) + F.col("page_ord")).alias("seq"), text.alias("piece"))
    frame = lambda part, *text: F.struct(F.lit(part << 50).alias("seq"), F.concat(*text).alias("piece"))
    pieces = rows.select("wiki_id", F.inline(F.array(
        piece(1, F.concat(comma("first"), F.to_json(page(F.lit(""))))),
        piece(3, F.concat(comma("first"), quoted("page_id"))),
        piece(5, F.when(F.col("made").isNotNull(), F.concat(comma("first_made"), quoted("page_id"), F.lit(":"), F.to_json(page(F.col("made")))))),
    ))).filter("piece IS NOT NULL").unionByName(ends.select("wiki_id", F.inline(F.array(
        frame(0, F.lit('{"wiki_structure":{"id":"w","title":'), quoted("'About ' || wiki_id"), F.lit(',"description":"","pages":[')),
        frame(2, F.lit('],"sections":[{"id":"all","title":"All","pages":[')),
        frame(4, F.lit(']}],"rootSections":["all"]},"generated_pages":{')),
        frame(6, F.lit('},"provider":"google"}')),
    ))))
    short = pieces.filter(CUT_SHORT).withColumn("n", F.length("piece"))
    half = short.groupBy("wiki_id").agg(F.floor(F.sum("n") / 2).alias("half"))
    short = running_total(short, ["wiki_id"], "seq", "n", "before").join(half, "wiki_id").filter("before < half").select(
        "wiki_id", "seq", F.expr("substr(piece, 1, CAST(half - before AS INT))").alias("piece")
    )
    files = pieces.filter(f"NOT ({CUT_SHORT})").unionByName(short).select(F.expr(FILE_OF).alias("path"), "seq", "piece")
    folder = scratch(spark, "wiki-files").removeprefix("file:")
    write_pieces(files, folder)
    return folder


@query(
    with_inputs("wiki_pages")
    + f"""SELECT {FILE_OF} AS id, wiki_id || '/wiki' AS name, CASE WHEN {CUT_SHORT} THEN NULL ELSE 'About ' || wiki_id END AS title,
      {CUT_SHORT} AS is_malformed FROM wiki_pages GROUP BY wiki_id"""
)
def stored_wiki_projects(spark, sf):
    """The catalogue of cached documents, with those that cannot be read"""
    folder = wiki_files(spark, sf)
    listed = list_projects(spark, folder).select("id", "name")
    inside = read_wiki_files(spark, folder)["projects"].select("id", "title", F.col("malformed").isNotNull().alias("is_malformed"))
    return listed.join(inside, "id")


@query(
    with_inputs("wiki_pages", "generated")
    + f"""SELECT {FILE_OF} AS id, CAST(row_number() OVER (PARTITION BY wiki_id ORDER BY page_ord) - 1 AS INTEGER) AS page_ord, page_id, title,
      coalesce(content, '') AS content, made IS NOT NULL AS generated, file_paths[1] AS path
    FROM (SELECT p.* EXCLUDE (content), g.content, g.page_id AS made FROM wiki_pages p LEFT JOIN generated g USING (wiki_id, page_id)) WHERE NOT ({CUT_SHORT})"""
)
def stored_wiki_pages(spark, sf):
    """The pages inside of cached documents"""
    pages = read_wiki_files(spark, wiki_files(spark, sf))["pages"]
    return pages.select("id", "page_ord", "page_id", "title", "content", "generated", F.col("file_paths")[0].alias("path"))


LINKED = """'- [' || {0} || '](' || CASE type WHEN 'github' THEN repo_url || '/blob/main/' WHEN 'gitlab' THEN repo_url || '/-/blob/main/'
  WHEN 'bitbucket' THEN repo_url || '/src/main/' ELSE '' END || {0} || ')'"""


@query(
    with_inputs("wiki_pages", "hosted_wikis")
    + f"""SELECT wiki_id, page_id, {LINKED.format("file_paths[1]")} || chr(10) || {LINKED.format("file_paths[2]")} AS links
    FROM wiki_pages JOIN hosted_wikis USING (wiki_id)"""
)
def source_links(spark, sf):
    """On three hosts, local and on a host of another kind"""
    return w.source_links(load(spark, sf, "wiki_pages"), load(spark, sf, "hosted_wikis"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'page-' || (doc_id + 1) ELSE source END AS page_id FROM documents")
def default_ids(spark, sf):
    """E9"""
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 6 == 0, "").when(F.col("doc_id") % 3 != 0, F.col("source")).alias("page_id")
    )
    return w.default_ids(rows, "page", "page_id", "doc_id")


@query(
    with_inputs("generated")
    + r"""SELECT page_id, CASE WHEN regexp_matches(content, '# [^\n]*?\n\n([^\n]*?)(\n\n|\z)')
      THEN trim(regexp_extract(content, '# [^\n]*?\n\n([^\n]*?)(\n\n|\z)', 1)) ELSE 'No summary available' END AS summary FROM generated"""
)
def page_summaries(spark, sf):
    """H16"""
    return load(spark, sf, "generated").select("page_id", page_summary(F.col("content")).alias("summary"))


@query(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || ' ' ELSE text END AS text FROM (SELECT doc_id, 'T ' || text || '.' AS text FROM documents)"""
)
def fences(spark, sf):
    """H11"""
    text = F.concat(F.lit("T "), "text", F.lit("."))
    key = F.col("doc_id") % 3
    fenced = (
        F.when(key == 0, F.concat(F.lit("```Markdown \n"), text, F.lit(" ```\n")))
        .when(key == 1, F.concat(text, F.lit("```")))
        .otherwise(F.concat(F.lit("```markdown"), text))
    )
    return table(spark, sf, "documents").select("doc_id", strip_fences(fenced).alias("text"))
