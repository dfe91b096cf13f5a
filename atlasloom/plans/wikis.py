"""Wiki jobs: structure from generated XML (J6), publication (J7), decks and workshops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import NO_XML_ERROR
from ..functions.decks import (
    annotate_exercises, build_toc, final_project_note, slide_description, slide_html, slide_items, slide_title,
)
from ..functions.markup import (
    extract_wiki_xml, first_element, nested, pages_anywhere, pages_from_text, pages_from_xml, parse_xml, repair_xml, sections_from_xml, strip_fences,
    trimmed_element, unescape_xml,
)
from ..operators.publish import export_json, export_markdown, pack_context
from ..operators.filters import resolve_language
from ..operators.scale import bounded_side, latest_wins
from ..operators.wiki import attach_content, infer_sections, ready_wikis, root_sections
from ..session import ensure_checkpoint_dir
from ..sources.index_store import new_build
from ..sources.wiki_cache import KEY, upsert_wiki


def flatten_wiki_xml(responses: DataFrame, comprehensive: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(`wikis`, `pages`, `sections`) of generated responses (`wiki_id, response`).

    A block that does not parse is read by pattern instead; a response without a block keeps an
    error in `wikis`. What is read from a response is stored once, as a checkpoint that all tables come from.
    """
    ensure_checkpoint_dir(responses.sparkSession)
    blocks = responses.select(
        "wiki_id", extract_wiki_xml(strip_fences(F.col("response"), "xml")).alias("block")
    )
    def read(w: Column) -> Column:
        broken = w["_corrupt_record"].isNotNull()
        return F.struct(
            broken.alias("rebuilt"),
            F.when(broken, pages_from_text(F.col("xml")))
            .when(nested(F.col("xml"), w, "page"), pages_anywhere(F.col("xml"))).otherwise(pages_from_xml(w)).alias("pages"),
            F.when(~broken, sections_from_xml(F.col("xml"))).alias("sections"),
        )

    def text(tag: str) -> Column:
        # a rebuilt block is trimmed, a parsed one is taken as it is
        found = unescape_xml(first_element(F.col("xml"), tag))
        return F.coalesce(F.when(F.col("rebuilt"), trimmed_element(F.col("xml"), tag)).otherwise(found), F.lit("")).alias(tag)

    xml = blocks.select("wiki_id", "block", repair_xml(F.col("block")).alias("xml"))
    # Bound as a lambda variable, a block is parsed once for all that is read from it.
    parsed = F.transform(F.array(F.when(F.col("block") != "", parse_xml(F.col("xml")))), read)
    structured = xml.select("wiki_id", "xml", F.when(F.col("block") == "", F.lit(NO_XML_ERROR)).alias("error"), F.inline(parsed))
    structured = structured.select("wiki_id", text("title"), text("description"), F.coalesce("rebuilt", F.lit(False)).alias("rebuilt"), "error", "pages", "sections").checkpoint()
    wikis = structured.drop("pages", "sections")
    pages = structured.select("wiki_id", F.posexplode("pages").alias("page_ord", "p")).select(
        "wiki_id", "page_ord", "p.page_id", "p.title", F.lit("").alias("content"), "p.file_paths",
        "p.importance", "p.related_pages",
    )
    sections = structured.filter(F.lit(comprehensive)).select(
        "wiki_id", F.posexplode("sections").alias("sec_ord", "s")
    ).select("wiki_id", "sec_ord", "s.*")
    return wikis, pages, sections


def ingest_wiki(responses: DataFrame, comprehensive: bool = True) -> dict[str, DataFrame]:
    """Wiki tables with roots; wikis without sections get them from their page titles.

    `inferred_pages` / `inferred_sections` hold the pages (with parent) and root sections of those.
    """
    wikis, pages, sections = flatten_wiki_xml(responses, comprehensive)
    inferred_pages, inferred_sections = infer_sections(pages, sections)
    return {
        "wikis": wikis,
        "pages": pages,
        "sections": sections,
        "roots": root_sections(sections),
        "inferred_pages": inferred_pages,
        "inferred_sections": inferred_sections,
    }


_PAGE = ["page_ord", "page_id", "title", "importance", "file_paths", "related_pages", "content"]
_SECTION = ["sec_ord", "section_id", "title", "pages", "subsections"]


def stored_form(wikis: DataFrame, filled: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """The rows of the wikis, all with their header: one of each wiki (`part` is null), one of each of its generated
    pages (`stored_page`) and sections (`stored_section`). A wiki is never gathered in a row, so it may have any size.

    `wikis`: the cache key columns and `wiki_id`, each pair of them once. `stored_id` is the same in all rows of a wiki and new in each call.
    """
    heads = wikis.withColumn("stored_id", F.md5(F.concat(F.lit(new_build()), F.to_json(F.struct(*KEY, "wiki_id")))))

    def parts(rows: DataFrame, fields: list[str], kind: str) -> DataFrame:
        return rows.select("wiki_id", F.lit(kind).alias("part"), F.struct(*fields).alias(f"stored_{kind}")).join(heads, "wiki_id")

    rows = heads.unionByName(parts(filled, _PAGE, "page"), allowMissingColumns=True)
    if sections is not None:
        rows = rows.unionByName(parts(sections, _SECTION, "section"), allowMissingColumns=True)
    return rows


def stored_wiki_tables(cache: DataFrame) -> dict[str, DataFrame]:
    """The stored rows back as tables: `wikis`, `pages` with their content, and `sections`.

    Wikis that were stored without sections get them from their page titles.
    """
    pages = cache.filter("part = 'page'").select("wiki_id", "stored_page.*")
    if "stored_section" in cache.columns:
        sections = cache.filter("part = 'section'").select("wiki_id", "stored_section.*")
    else:
        sections = cache.select("wiki_id", F.inline(F.array().cast(
            "array<struct<sec_ord:bigint,section_id:string,title:string,pages:array<string>,subsections:array<string>>>"
        )))
    inferred_pages, inferred_sections = infer_sections(pages, sections)
    return {
        "wikis": cache.filter("part IS NULL").drop("stored_id", "part", "stored_page", "stored_section"), "pages": pages, "sections": sections,
        "inferred_pages": inferred_pages, "inferred_sections": inferred_sections,
    }


def publish_wiki(
    wikis: DataFrame, pages: DataFrame, generated: DataFrame, cache: DataFrame, stamp: str, sections: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Store the complete wikis, structure and pages, and export all of them.

    `wikis`: `wiki_id`, the cache key columns, `repo_url`, `updated_at`.
    """
    ready = bounded_side(ready_wikis(pages, generated))
    complete = resolve_language(wikis.join(ready, "wiki_id", "left_semi")).select(*KEY, "wiki_id", "repo_url", "updated_at")
    complete = bounded_side(latest_wins(complete, [*KEY, "wiki_id"], "updated_at"))
    filled = attach_content(pages, generated)
    whole = attach_content(*[rows.join(ready, "wiki_id", "left_semi") for rows in (pages, generated)])
    stored = stored_form(complete, whole, sections)
    return {
        "stored": stored,
        "cache": upsert_wiki(cache, stored),
        "markdown": export_markdown(filled, wikis, stamp),
        "json": export_json(filled, wikis, stamp),
    }


def slide_plans(plans: DataFrame, mode: str = "strict") -> DataFrame:
    """`wiki_id, slide_no, title, description` from plan texts (`wiki_id, repo, plan`)."""
    items = slide_items(F.col("plan"), F.col("repo"), mode)
    return plans.select("wiki_id", F.posexplode(items).alias("pos", "item")).select(
        "wiki_id", (F.col("pos") + 1).alias("slide_no"),
        slide_title(F.col("item")).alias("title"), slide_description(F.col("item")).alias("description"),
    )


def slide_pages(texts: DataFrame) -> DataFrame:
    """HTML of generated slides (`..., text`)."""
    return texts.withColumn("html", slide_html(F.col("text"))).drop("text")


def workshops(texts: DataFrame) -> DataFrame:
    """H11, H22, E6 and H23 on generated workshop texts (`..., text`)."""
    return (
        texts.withColumn("text", strip_fences(F.col("text")))
        .withColumn("text", build_toc(F.col("text")))
        .withColumn("text", annotate_exercises(F.col("text")))
        .withColumn("text", final_project_note(F.col("text")))
    )


def derive_decks(
    wikis: DataFrame, pages: DataFrame, generated: DataFrame, plans: DataFrame, slides: DataFrame, texts: DataFrame
) -> dict[str, DataFrame]:
    """Deck contexts, slide plans, slide pages and workshops over all wikis."""
    return {
        "contexts": pack_context(pages, generated, wikis),
        "plans": slide_plans(plans),
        "slides": slide_pages(slides),
        "workshops": workshops(texts),
    }
