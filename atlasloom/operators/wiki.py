"""Wiki structure tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import CATEGORIES, CONTENT_MISSING, CONTENT_PENDING, IMPORTANCE_SECTIONS, OTHER_CATEGORY
from ..functions.research import contains_any
from ..functions.urls import file_url
from ..session import ensure_checkpoint_dir
from .scale import bounded_side, running_total, sorted_index

LOCAL_SECTIONS = 100_000


def first_by_id(rows: DataFrame, id_col: str, order: str, *columns: str) -> DataFrame:
    """The first row with each id in a wiki; duplicates are folded before the shuffle."""
    return (
        rows.groupBy("wiki_id", id_col)
        .agg(F.min_by(F.struct(order, *columns), order).alias("__first"))
        .select("wiki_id", id_col, "__first.*")
    )


def default_ids(rows: DataFrame, prefix: str, id_col: str, position: str) -> DataFrame:
    """A missing id becomes `<prefix>-<position + 1>`."""
    named = F.concat(F.lit(f"{prefix}-"), (F.col(position) + 1).cast("string"))
    return rows.withColumn(id_col, F.coalesce(F.nullif(F.col(id_col), F.lit("")), named))


def resolve_related(pages: DataFrame) -> DataFrame:
    """Links to the known related pages of every page, in order (`wiki_id, page_ord, links`)."""
    asked = pages.select("wiki_id", "page_ord", F.posexplode("related_pages").alias("pos", "related_id"))
    titles = first_by_id(pages, "page_id", "page_ord", "title").select(
        "wiki_id", F.col("page_id").alias("related_id"), F.col("title").alias("related_title")
    )
    return (
        asked.join(titles, ["wiki_id", "related_id"])
        .withColumn("link", F.concat(F.lit("["), "related_title", F.lit("](#"), "related_id", F.lit(")")))
        .groupBy("wiki_id", "page_ord")
        .agg(F.expr("listagg(link, ', ') WITHIN GROUP (ORDER BY pos)").alias("links"))
    )


def root_sections(sections: DataFrame) -> DataFrame:
    """Sections that no section refers to (a reference to itself counts)."""
    referenced = sections.select("wiki_id", F.explode("subsections").alias("section_id")).distinct()
    return sections.join(referenced, ["wiki_id", "section_id"], "left_anti")


def traverse_tree(
    sections: DataFrame, pages: DataFrame, roots: DataFrame | None = None, max_depth: int | None = None, local: int = LOCAL_SECTIONS
) -> DataFrame:
    """C4: every wiki's tree in reading order (`wiki_id, ord, level, kind, node_id, title`; `ord` counts from 0 in a wiki).

    A section's pages come before its subsections, unknown ids are skipped, and a wiki without roots is its flat page
    list. Wikis whose sections have one parent at most are forests: wikis of up to `local` sections are placed in a task
    each, larger ones by pointers along the tour through the tree, doubled in logarithmically many rounds. In other wikis a
    section stands below each of its parents and a branch stops where it would revisit a section; these are
    unfolded level by level. `max_depth` leaves out deeper sections, whose places stay empty.
    """
    ensure_checkpoint_dir(sections.sparkSession)
    known = first_by_id(sections, "section_id", "sec_ord", "title", "pages", "subsections").checkpoint()
    asked = known.select("wiki_id", F.col("section_id").alias("parent"), F.posexplode("subsections").alias("pos", "child")).filter("parent <> child")
    edges = asked.join(known.select("wiki_id", F.col("section_id").alias("child")), ["wiki_id", "child"]).checkpoint()
    tops = (root_sections(sections) if roots is None else roots).groupBy("wiki_id", "section_id").agg(F.min("sec_ord").alias("sec_ord"))
    tops = tops.join(known.select("wiki_id", "section_id"), ["wiki_id", "section_id"], "left_semi").checkpoint()

    first_pages = first_by_id(pages, "page_id", "page_ord", "title")
    in_section = Window.partitionBy("wiki_id", "section_id").orderBy("pos")
    listed = known.select("wiki_id", "section_id", F.posexplode("pages").alias("pos", "page_id")).join(first_pages, ["wiki_id", "page_id"])
    listed = listed.withColumn("nth", F.row_number().over(in_section)).select("wiki_id", "section_id", "nth", "page_id", "title").checkpoint()

    parents = edges.groupBy("wiki_id", F.col("child").alias("section_id")).agg(F.count(F.lit(1)).alias("n"), F.min_by("parent", "pos").alias("parent"), F.min("pos").alias("pos"))
    nodes = (
        known.select("wiki_id", "section_id").join(parents, ["wiki_id", "section_id"], "left").join(tops, ["wiki_id", "section_id"], "left")
        .join(listed.groupBy("wiki_id", "section_id").agg(F.count(F.lit(1)).alias("listed")), ["wiki_id", "section_id"], "left")
        .select("wiki_id", "section_id", "parent", F.coalesce("sec_ord", "pos").cast("long").alias("pos"), F.col("sec_ord").isNotNull().alias("top"),
                (1 + F.coalesce("listed", F.lit(0))).cast("long").alias("size"), F.coalesce("n", F.lit(0)).alias("n"))
        .checkpoint()
    )
    shape = nodes.groupBy("wiki_id").agg(
        F.count(F.lit(1)).alias("sections"), F.max((F.col("n") > 1) | (F.col("top") & (F.col("n") > 0))).alias("tangled"), F.bool_or("top").alias("rooted")
    ).checkpoint()
    forest = nodes.join(bounded_side(shape.filter("rooted AND NOT tangled").select("wiki_id", (F.col("sections") > local).alias("large"))), "wiki_id")
    placed = _placed_in_tasks(forest.filter("NOT large"))
    largest, tangled = shape.agg(F.max(F.when(~F.col("tangled") & F.col("rooted"), F.col("sections"))), F.bool_or(F.col("tangled") & F.col("rooted"))).first()
    if (largest or 0) > local:
        placed = placed.unionByName(_placed_by_doubling(forest.filter("large"), largest))
    if tangled:
        some = shape.filter("rooted AND tangled").select("wiki_id")
        placed = placed.unionByName(_placed_by_unfolding(edges.join(some, "wiki_id", "left_semi"), tops.join(some, "wiki_id", "left_semi"), nodes, max_depth))
    placed = placed.checkpoint()
    if max_depth is not None:
        placed = placed.filter(F.col("level") <= max_depth)

    titles = known.select("wiki_id", "section_id", "title")
    flat = pages.join(shape.filter("rooted").select("wiki_id"), "wiki_id", "left_anti").select("wiki_id", "page_ord", "page_id", "title")
    return (
        placed.join(titles, ["wiki_id", "section_id"])
        .select("wiki_id", "ord", "level", F.lit("section").alias("kind"), F.col("section_id").alias("node_id"), "title")
        .unionByName(placed.join(listed, ["wiki_id", "section_id"]).select(
            "wiki_id", (F.col("ord") + F.col("nth")).alias("ord"), (F.col("level") + 1).alias("level"), F.lit("page").alias("kind"),
            F.col("page_id").alias("node_id"), "title",
        ))
        .unionByName(sorted_index(flat, ["wiki_id"], ["page_ord", "page_id"], "ord").select(
            "wiki_id", "ord", F.lit(0).alias("level"), F.lit("page").alias("kind"), F.col("page_id").alias("node_id"), "title"
        ))
    )


PLACED = "wiki_id string, section_id string, ord long, level int"


def _placed_in_tasks(nodes: DataFrame) -> DataFrame:
    """Places of the sections of small forests: a wiki is walked in one task."""

    def walk(table: pa.Table) -> pa.Table:
        names, parents, tops, sizes = (table.column(c).to_pylist() for c in ("section_id", "parent", "top", "size"))
        order = np.argsort(table.column("pos").to_numpy(), kind="stable")[::-1].tolist()  # the last is pushed first
        below: dict = {}
        for i in order:
            if not tops[i]:
                below.setdefault(parents[i], []).append(i)
        stack, out, at = [(i, 0) for i in order if tops[i]], [], 0
        while stack:
            i, level = stack.pop()
            out.append((names[i], at, level))
            at += sizes[i]
            stack += [(j, level + 1) for j in below.get(names[i], ())]
        section, place, level = zip(*out)
        return pa.table({"wiki_id": pa.array([table.column("wiki_id")[0].as_py()] * len(out)), "section_id": section, "ord": pa.array(place, pa.int64()), "level": pa.array(level, pa.int32())})

    return nodes.select("wiki_id", "section_id", "parent", "pos", "top", "size").groupBy("wiki_id").applyInArrow(walk, PLACED)


def _placed_by_doubling(nodes: DataFrame, largest: int) -> DataFrame:
    """Places of the sections of large forests.

    The tour enters and leaves every section once; each step knows the next. A step's distance to the end of the tour is
    summed along pointers that are doubled each round, so a chain of n sections takes log2(2 n) rounds. Steps are hashed by
    wiki and section, so one wiki is spread over the cluster.
    """
    above = F.when(F.col("top"), F.lit("")).otherwise(F.coalesce(F.concat(F.lit("<"), "parent"), F.concat(F.lit("!"), "section_id")))
    family = sorted_index(nodes.withColumn("above", above), ["wiki_id", "above"], ["pos"], "nth")
    younger = family.select("wiki_id", "above", (F.col("nth") - 1).alias("nth"), F.col("section_id").alias("sibling"))
    tour = family.join(younger, ["wiki_id", "above", "nth"], "left").checkpoint()
    # first children: one row per parent
    first = tour.filter("NOT top AND parent IS NOT NULL").groupBy("wiki_id", F.col("parent").alias("section_id")).agg(F.min_by("section_id", "pos").alias("child"))
    tour = tour.join(first, ["wiki_id", "section_id"], "left")
    entered, left = (lambda c: F.concat(F.lit("<"), c)), (lambda c: F.concat(F.lit(">"), c))
    step = lambda name, then, size, depth: F.struct(name.alias("step"), then.alias("then"), size.cast("long").alias("far"), F.lit(depth).alias("deep"))
    after = F.when(F.col("sibling").isNotNull(), entered(F.col("sibling"))).when(~F.col("top"), F.coalesce(left(F.col("parent")), left(F.col("section_id"))))
    steps = tour.select("wiki_id", F.inline(F.array(
        step(entered(F.col("section_id")), F.coalesce(entered(F.col("child")), left(F.col("section_id"))), F.col("size"), 1),
        step(left(F.col("section_id")), after, F.lit(0), -1),
    ))).checkpoint()
    for _ in range(max(1, (2 * largest).bit_length())):
        ahead = steps.select("wiki_id", F.col("step").alias("then"), F.col("then").alias("then_2"), F.col("far").alias("far_2"), F.col("deep").alias("deep_2"))
        steps = steps.join(ahead, ["wiki_id", "then"], "left").select(
            "wiki_id", "step", F.col("then_2").alias("then"), (F.col("far") + F.coalesce("far_2", F.lit(0))).alias("far"),
            (F.col("deep") + F.coalesce("deep_2", F.lit(0))).alias("deep"),
        ).checkpoint()
    ended = steps.filter("then IS NULL")  # circles that no root leads to never end
    total = ended.groupBy("wiki_id").agg(F.max("far").alias("total"))
    return ended.filter("startswith(step, '<')").join(total, "wiki_id").select(
        "wiki_id", F.expr("substr(step, 2)").alias("section_id"), (F.col("total") - F.col("far")).alias("ord"), (-F.col("deep")).cast("int").alias("level")
    )


def _placed_by_unfolding(edges: DataFrame, tops: DataFrame, nodes: DataFrame, max_depth: int | None) -> DataFrame:
    """Places where sections have several parents: every path that revisits no section, one level per step."""
    key = lambda c: F.lpad(F.col(c).cast("string"), 19, "0")
    frontier = tops.select("wiki_id", "section_id", F.lit(0).alias("level"), key("sec_ord").alias("path"), F.array("section_id").alias("seen")).checkpoint()
    levels, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        frontier = (
            frontier.withColumnRenamed("section_id", "parent").join(edges, ["wiki_id", "parent"]).filter(~F.array_contains("seen", F.col("child")))
            .select("wiki_id", F.col("child").alias("section_id"), (F.col("level") + 1).alias("level"), F.concat("path", F.lit("."), key("pos")).alias("path"),
                    F.array_append("seen", F.col("child")).alias("seen"))
            .checkpoint()
        )
        if frontier.isEmpty():
            break
        levels.append(frontier)
        depth += 1
    rows = reduce(DataFrame.unionByName, levels).drop("seen").join(nodes.select("wiki_id", "section_id", "size"), ["wiki_id", "section_id"])
    numbered = sorted_index(rows, ["wiki_id"], ["path"], "nth")
    return running_total(numbered, ["wiki_id"], "nth", "size", "ord").select("wiki_id", "section_id", F.col("ord").cast("long").alias("ord"), "level")


def attach_content(pages: DataFrame, generated: DataFrame) -> DataFrame:
    """Generated content of every page, or a fixed text where there is none."""
    content = generated.select("wiki_id", "page_id", F.col("content").alias("__content"))
    return (
        pages.drop("content")
        .join(content, ["wiki_id", "page_id"], "left")
        .withColumn("content", F.coalesce(F.nullif(F.col("__content"), F.lit("")), F.lit(CONTENT_MISSING)))
        .drop("__content")
    )


def source_links(pages: DataFrame, repos: DataFrame, branch: str = "main") -> DataFrame:
    """The source files of every page as link lines; built inside the row."""
    repo = bounded_side(repos.select("wiki_id", F.col("type").alias("repo_type"), "repo_url"))

    def line(path: Column) -> Column:
        target = file_url(F.col("repo_type"), F.col("repo_url"), F.lit(branch), path)
        return F.concat(F.lit("- ["), path, F.lit("]("), target, F.lit(")"))

    return pages.join(repo, "wiki_id", "left").select(
        "wiki_id", "page_id", F.array_join(F.transform("file_paths", line), "\n").alias("links")
    )


def category_of(title: Column) -> Column:
    """E5: ordinal of the first category with a keyword inside the title; past the last for none."""
    lowered = F.lower(title)
    branches = [F.when(contains_any(lowered, words), F.lit(i)) for i, (_, _, words) in enumerate(CATEGORIES)]
    return F.coalesce(*branches, F.lit(len(CATEGORIES)))


def first_category(pages: DataFrame) -> DataFrame:
    """E5: `category` and its ordinal for every page; a column expression, no join."""
    ids = F.array(*[F.lit(c[0]) for c in (*CATEGORIES, OTHER_CATEGORY)])
    return pages.withColumn("cat_ord", category_of(F.col("title"))).withColumn(
        "category", F.get(ids, F.col("cat_ord"))
    )


def cluster_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with their category section as parent, and one row per non-empty section.

    Membership stays one row per page (`parent_id`, `page_ord`) instead of an array per section,
    so no section is ever gathered in one place. Every section is a root.
    """
    titles = F.array(*[F.lit(c[1]) for c in (*CATEGORIES, OTHER_CATEGORY)])
    assigned = (
        first_category(pages)
        .withColumn("parent_id", F.concat(F.lit("section-"), "category"))
        .drop("category")
    )
    sections = (
        assigned.groupBy("wiki_id", "cat_ord", F.col("parent_id").alias("section_id"))
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .withColumn("title", F.get(titles, F.col("cat_ord")))
        .withColumnRenamed("cat_ord", "sec_ord")
    )
    return assigned.drop("cat_ord"), sections


def infer_sections(pages: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D7 where it applies: wikis that have no sections or no root among them."""
    rooted = root_sections(sections).select("wiki_id").distinct()
    return cluster_pages(pages.join(rooted, "wiki_id", "left_anti"))


def group_by_importance(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same two tables with one section per importance level."""
    pick = lambda i: F.coalesce(*[F.when(F.col("importance") == s[0], F.lit(s[i])) for s in IMPORTANCE_SECTIONS])
    rank = F.coalesce(
        *[F.when(F.col("importance") == s[0], F.lit(n)) for n, s in enumerate(IMPORTANCE_SECTIONS)]
    )
    assigned = pages.filter(F.col("importance").isin(*[s[0] for s in IMPORTANCE_SECTIONS])).withColumn(
        "parent_id", pick(1)
    )
    sections = assigned.groupBy(
        "wiki_id", rank.alias("sec_ord"), F.col("parent_id").alias("section_id"), pick(2).alias("title")
    ).agg(F.count(F.lit(1)).alias("n_pages"))
    return assigned, sections


def wiki_completeness(pages: DataFrame, generated: DataFrame) -> DataFrame:
    """Page and content counts per wiki, and whether it may be stored."""
    content = F.col("content")
    done = F.coalesce((content != "") & (content != CONTENT_PENDING), F.lit(False))
    # Only a flag per page goes into the join, not the text.
    flags = generated.select("wiki_id", "page_id", done.alias("done"))
    per_wiki = (
        pages.select("wiki_id", "page_id")
        .join(flags, ["wiki_id", "page_id"], "left")
        .groupBy("wiki_id")
        .agg(F.count(F.lit(1)).alias("n_pages"), F.bool_and(F.coalesce("done", F.lit(False))).alias("all_done"))
    )
    counts = generated.groupBy("wiki_id").agg(F.count(F.lit(1)).alias("n_generated"))
    return per_wiki.join(counts, "wiki_id", "left").select(
        "wiki_id", "n_pages", F.coalesce("n_generated", F.lit(0)).alias("n_generated"), "all_done",
        (F.col("all_done") & (F.coalesce("n_generated", F.lit(0)) >= F.col("n_pages"))).alias("ready"),
    )


def ready_wikis(pages: DataFrame, generated: DataFrame) -> DataFrame:
    """Wikis of which every page has content."""
    return wiki_completeness(pages, generated).filter("ready").select("wiki_id")


def pending_pages(pages: DataFrame, generated: DataFrame) -> DataFrame:
    """Pages still to be generated (no content yet)."""
    filled = generated.filter(F.col("content") != "").select("wiki_id", "page_id")
    return pages.join(filled, ["wiki_id", "page_id"], "left_anti")
