"""Wiki exports and deck contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import DECK_CHAR_LIMIT
from ..functions.markup import page_summary
from ..functions.text import utf16_length
from .scale import RANGE, bounded_side, joined, ordered_text
from .wiki import resolve_related


def export_markdown(pages: DataFrame, wikis: DataFrame, generated_on: str, span: int = RANGE) -> DataFrame:
    """One markdown document per wiki (`wiki_id, markdown`).

    Contents lines and page bodies are joined in the same aggregations, first per (wiki, page range), then per wiki.
    A wiki without pages is a document without contents.
    """
    title, page_id = F.col("title"), F.col("page_id")
    heading = F.concat(
        F.lit("<a id='"), page_id, F.lit("'></a>\n\n## "), title, F.lit("\n\n"),
        F.when(F.size("related_pages") > 0, F.lit("### Related Pages\n\n")).otherwise(F.lit("")),
    )
    toc = F.concat(F.lit("- ["), title, F.lit("](#"), page_id, F.lit(")\n"))
    slots = pages.select(
        "wiki_id", "page_ord",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("slot"), toc.alias("toc"), heading.alias("body")),
                F.struct(
                    F.lit(2).alias("slot"), F.lit(None).cast("string").alias("toc"),
                    F.concat("content", F.lit("\n\n---\n\n")).alias("body"),
                ),
            )
        ),
    )
    related = resolve_related(pages.drop("content")).select(
        "wiki_id", "page_ord", F.lit(1).alias("slot"), F.lit(None).cast("string").alias("toc"),
        F.concat(F.lit("Related topics: "), "links", F.lit("\n\n")).alias("body"),
    )
    whole = (
        slots.unionByName(related)
        .groupBy("wiki_id", F.floor(F.col("page_ord") / span).alias("part"))
        .agg(
            joined("toc", "page_ord").alias("toc"),
            F.expr("listagg(body, '') WITHIN GROUP (ORDER BY page_ord, slot)").alias("body"),
        )
        .groupBy("wiki_id").agg(joined("toc", "part").alias("toc"), joined("body", "part").alias("body"))
    )
    text = F.concat(
        F.lit("# Wiki Documentation for "), "repo_url", F.lit(f"\n\nGenerated on: {generated_on}\n\n## Table of Contents\n\n"),
        F.coalesce("toc", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")),
    )
    return wikis.select("wiki_id", "repo_url").join(whole, "wiki_id", "left").select("wiki_id", text.alias("markdown"))


def export_json(pages: DataFrame, wikis: DataFrame, generated_at: str, span: int = RANGE) -> DataFrame:
    """One JSON document per wiki (`wiki_id, json`); a wiki without pages has an empty list."""
    page = F.struct(
        F.col("page_id").alias("id"), "title", "content", F.col("file_paths").alias("filePaths"),
        "importance", F.col("related_pages").alias("relatedPages"),
    )
    whole = (
        pages.select("wiki_id", "page_ord", F.to_json(page, {"ignoreNullFields": "false"}).alias("text"))
        .groupBy("wiki_id", F.floor(F.col("page_ord") / span).alias("part"))
        .agg(joined("text", "page_ord", ",").alias("text"), F.count(F.lit(1)).alias("n"))
        .groupBy("wiki_id").agg(joined("text", "part", ",").alias("text"), F.sum("n").alias("n"))
    )
    meta = F.to_json(
        F.struct(
            F.col("repo_url").alias("repository"), F.lit(generated_at).alias("generated_at"),
            F.coalesce("n", F.lit(0)).alias("page_count"),
        )
    )
    text = F.concat(F.lit('{"metadata":'), meta, F.lit(',"pages":['), F.coalesce("text", F.lit("")), F.lit("]}"))
    return wikis.select("wiki_id", "repo_url").join(whole, "wiki_id", "left").select("wiki_id", text.alias("json"))


def _budget_fold(sizes: Column, limit: int) -> Column:
    """Pages that fit the budget, in order, each whole or as its summary."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("total"), F.lit(False).alias("started"),
        F.array().cast("array<struct<page_ord: bigint, whole: boolean>>").alias("picks"),
    )

    def step(acc: Column, page: Column) -> Column:
        total, high = acc["total"], page["rest"] == 0
        whole = high | (total + page["full_len"] <= limit)
        open_ = F.when(high | acc["started"], total <= limit).otherwise(total < limit)
        size = F.when(whole, page["full_len"]).otherwise(page["sum_len"])
        pick = F.struct(page["page_ord"].alias("page_ord"), whole.alias("whole"))
        return F.struct(
            F.when(open_, total + size).otherwise(total).alias("total"),
            (acc["started"] | (~high & open_)).alias("started"),
            F.when(open_, F.array_append(acc["picks"], pick)).otherwise(acc["picks"]).alias("picks"),
        )

    return F.aggregate(sizes, start, step, lambda acc: acc["picks"])


def pack_context(
    pages: DataFrame, generated: DataFrame, wikis: DataFrame, limit: int = DECK_CHAR_LIMIT
) -> DataFrame:
    """Overview plus as many pages as the character budget takes (`wiki_id, context`).

    High-importance pages come first, each whole; then the others, as a summary where the whole
    page would exceed the budget. The fold runs on lengths only. A page adds at least six
    characters, so no wiki can use more than `limit / 6 + 2` pages of either kind; the rest cannot
    matter and are dropped before the shuffle by the ranking, which keeps the array bounded.
    """
    written = generated.filter(F.col("content") != "")
    size = lambda c: utf16_length(c).cast("bigint")
    head = lambda title: F.concat(F.lit("## "), title, F.lit("\n"))
    # Lengths add up, so only numbers are joined here; texts are fetched for what is picked.
    bodies = written.select(
        "wiki_id", "page_id", size(F.col("content")).alias("body_len"), size(page_summary(F.col("content"))).alias("brief_len")
    )
    listed = pages.select("wiki_id", F.col("page_ord").cast("bigint").alias("page_ord"), "page_id", "title", "importance")
    rest_of = size(head(F.col("title"))) + 2
    sizes = listed.join(bodies, ["wiki_id", "page_id"]).select(
        "wiki_id", F.when(F.col("importance") == "high", 0).otherwise(1).alias("rest"), "page_ord",
        (rest_of + F.col("body_len")).alias("full_len"), (rest_of + F.col("brief_len")).alias("sum_len"),
    )
    place = F.row_number().over(Window.partitionBy("wiki_id", "rest").orderBy("page_ord"))
    picks = (
        sizes.withColumn("rn", place)
        .filter(F.col("rn") <= limit // 6 + 2)
        .groupBy("wiki_id")
        .agg(F.array_sort(F.collect_list(F.struct("rest", "page_ord", "full_len", "sum_len"))).alias("sizes"))
        .select("wiki_id", F.posexplode(_budget_fold(F.col("sizes"), limit)).alias("pos", "pick"))
        .select("wiki_id", "pick.page_ord", "pick.whole", (F.col("pos") + 1).cast("bigint").alias("ord"))
    )
    picked = bounded_side(listed.join(picks, ["wiki_id", "page_ord"]).select("wiki_id", "page_id", "title", "whole", "ord"))
    text = F.when(F.col("whole"), F.col("content")).otherwise(page_summary(F.col("content")))
    pieces = written.select("wiki_id", "page_id", "content").join(picked, ["wiki_id", "page_id"]).select(
        "wiki_id", "ord", F.concat(head(F.col("title")), text, F.lit("\n\n")).alias("text")
    )
    overview = wikis.select(
        "wiki_id", F.lit(0).cast("bigint").alias("ord"),
        F.concat(F.lit("## Project Overview\n"), F.coalesce("description", F.lit("")), F.lit("\n\n")).alias("text"),
    )
    return ordered_text(overview.unionByName(pieces), ["wiki_id"], "ord", "text", "context")
