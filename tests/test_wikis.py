"""Wiki tables, exports and deck contexts against plain re-statements."""

import json
import random

import pytest
from pyspark.sql import functions as F

from atlasloom import schemas
from atlasloom.constants import CATEGORIES
from atlasloom.operators import catalogue, publish, wiki


def make_pages(n_wikis=6, seed=4):
    rng, rows = random.Random(seed), []
    words = ["Overview", "System Design", "Maintain", "API Guide", "Misc", "Dataflow", "Login Page", "Deploying", "Überblick"]
    for w in range(n_wikis):
        for i in range(60 if w == 0 else rng.randrange(1, 12)):
            ids = [f"p{rng.randrange(14)}" for _ in range(rng.randrange(4))] + (["nope"] if i % 3 == 0 else [])
            body = "" if i % 5 == 4 else f"# T{i}\n\nSummary {i}.\n\n" + "x" * rng.choice([10, 900, 4000, 13000])
            rows.append((f"w{w}", i, f"p{i}", rng.choice(words) + f" {i}", body, [f"f{i}.py"], rng.choice(["high", "medium", "low"]), ids, None))
    return rows


@pytest.fixture(scope="module")
def data():
    return make_pages()


@pytest.fixture(scope="module")
def pages(spark, data):
    return spark.createDataFrame(data, schemas.WIKI_PAGES).repartition(5)


@pytest.fixture(scope="module")
def wikis(spark):
    return spark.createDataFrame([(f"w{i}", f"https://github.com/o/r{i}", f"About {i}") for i in range(6)], "wiki_id string, repo_url string, description string")


def by_wiki(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return out


def markdown(url, stamp, pages):
    md = f"# Wiki Documentation for {url}\n\nGenerated on: {stamp}\n\n## Table of Contents\n\n"
    md += "".join(f"- [{p[3]}](#{p[2]})\n" for p in pages) + "\n"
    for p in pages:
        md += f"<a id='{p[2]}'></a>\n\n## {p[3]}\n\n"
        if p[7]:
            md += "### Related Pages\n\n"
            known = [(q[3], i) for i in p[7] for q in [next((q for q in pages if q[2] == i), None)] if q]
            if known:
                md += "Related topics: " + ", ".join(f"[{t}](#{i})" for t, i in known) + "\n\n"
        md += f"{p[4]}\n\n---\n\n"
    return md


@pytest.mark.parametrize("span, shift", [(10_000, 0), (7, 0), (10_000, 1_000_000)])
def test_markdown_export(data, pages, wikis, span, shift):
    shifted = pages.withColumn("page_ord", F.col("page_ord") + shift)
    rows = publish.export_markdown(shifted, wikis, "S", span).collect()
    got = {r.wiki_id: r.markdown for r in rows}
    assert len(got) == len(rows) == wikis.count()
    for w, own in by_wiki(data).items():
        assert got[w] == markdown(f"https://github.com/o/r{w[1:]}", "S", own)


@pytest.mark.parametrize("span, shift", [(10_000, 0), (7, 0), (10_000, 1_000_000)])
def test_json_export(data, pages, wikis, span, shift):
    shifted = pages.withColumn("page_ord", F.col("page_ord") + shift)
    got = {r.wiki_id: r.json for r in publish.export_json(shifted, wikis, "S", span).collect()}
    for w, rows in by_wiki(data).items():
        assert json.loads(got[w]) == {
            "metadata": {"repository": f"https://github.com/o/r{w[1:]}", "generated_at": "S", "page_count": len(rows)},
            "pages": [
                dict(id=p[2], title=p[3], content=p[4], filePaths=p[5], importance=p[6], relatedPages=p[7]) for p in rows
            ],
        }


def packed(description, pages, limit):
    import re

    out, total = f"## Project Overview\n{description}\n\n", 0
    for p in (p for p in pages if p[6] == "high" and p[4]):
        text = f"## {p[3]}\n{p[4]}\n\n"
        out, total = out + text, total + len(text)
        if total > limit:
            break
    if total < limit:
        for p in (p for p in pages if p[6] != "high" and p[4]):
            text = f"## {p[3]}\n{p[4]}\n\n"
            if total + len(text) > limit:
                m = re.search(r"# .*?\n\n(.*?)(\n\n|\Z)", p[4])
                text = f"## {p[3]}\n{m.group(1).strip() if m else 'No summary available'}\n\n"
            out, total = out + text, total + len(text)
            if total > limit:
                break
    return out


@pytest.mark.parametrize("limit", [30000, 2000, 100, 5])
def test_context_budget(data, pages, wikis, limit):
    generated = pages.select("wiki_id", "page_id", "content")
    got = {r.wiki_id: r.context for r in publish.pack_context(pages, generated, wikis, limit).collect()}
    assert got == {w: packed(f"About {w[1:]}", rows, limit) for w, rows in by_wiki(data).items()}


def test_content_and_completeness(spark, pages):
    generated = spark.createDataFrame(
        [("w1", "p0", "x"), ("w1", "p1", ""), ("w2", "p0", "Loading...")], "wiki_id string, page_id string, content string"
    )
    rows = {(r.wiki_id, r.page_id): r.content for r in wiki.attach_content(pages, generated).collect()}
    assert rows[("w1", "p0")] == "x" and rows.get(("w1", "p1"), "Content not generated") == "Content not generated"
    assert wiki.ready_wikis(pages, generated).isEmpty()
    full = pages.select("wiki_id", "page_id", F.lit("done").alias("content"))
    assert wiki.ready_wikis(pages, full).count() == 6
    pending = wiki.pending_pages(pages, generated)
    assert pending.count() == pages.count() - 2


def test_categories(data, pages):
    assigned, sections = wiki.cluster_pages(pages)
    want = {}
    for r in data:
        t = r[3].lower()
        cat = next((c[0] for c in CATEGORIES if any(k in t for k in c[2])), "other")
        want[(r[0], r[2])] = f"section-{cat}"
    assert {(r.wiki_id, r.page_id): r.parent_id for r in assigned.collect()} == want
    counts = {}
    for (w, _), s in want.items():
        counts[(w, s)] = counts.get((w, s), 0) + 1
    assert {(r.wiki_id, r.section_id): r.n_pages for r in sections.collect()} == counts
    assert "section-models" in {s for s in want.values()}  # "Maintain" contains "ai"


def test_importance_groups(data, pages):
    _, sections = wiki.group_by_importance(pages)
    want = {}
    for r in data:
        want[(r[0], f"section-{r[6]}")] = want.get((r[0], f"section-{r[6]}"), 0) + 1
    assert {(r.wiki_id, r.section_id): r.n_pages for r in sections.collect()} == want


def test_source_links(spark):
    p = spark.createDataFrame([("w", 0, "p", "", "", ["a.py", "b/c.py"], "high", [], None), ("v", 0, "p", "", "", ["x"], "low", [], None)], schemas.WIKI_PAGES)
    repos = spark.createDataFrame([("w", "github", "https://github.com/o/r"), ("v", "local", "/x")], "wiki_id string, type string, repo_url string")
    got = {r.wiki_id: r.links for r in wiki.source_links(p, repos).collect()}
    base = "https://github.com/o/r/blob/main/"
    assert got == {"w": f"- [a.py]({base}a.py)\n- [b/c.py]({base}b/c.py)", "v": "- [x](x)"}


def walk(sections, pages):
    known = {}
    for s in sections:
        known.setdefault(s[2], s)
    refs = {r for s in sections for r in s[5]}
    titles = {}
    for p in pages:
        titles.setdefault(p[2], p[3])
    roots = [s[2] for s in sections if s[2] not in refs]
    if not roots:
        return [(0, "page", p[2]) for p in pages]
    out = []

    def visit(sid, level, seen):
        if sid not in known or sid in seen:
            return
        out.append((level, "section", sid))
        out.extend((level + 1, "page", p) for p in known[sid][4] if p in titles)
        for child in known[sid][5]:
            visit(child, level + 1, seen | {sid})

    for r in roots:
        visit(r, 0, set())
    return out


def test_tree(spark, data, pages):
    rng, sections = random.Random(9), []
    for w in range(5):
        for i in range(12):
            refs = [f"s{rng.randrange(i + 1, 15)}" for _ in range(rng.randrange(3))]
            if w == 3 and i == 11:
                refs = ["s2"]  # a cycle below a root
            if w == 4:
                refs = [f"s{(i + 1) % 12}"]  # no root at all
            sections.append((f"w{w}", i, f"s{i}", f"S{i}", [f"p{rng.randrange(9)}" for _ in range(2)], refs))
    for i in range(40):  # a forest: two roots, several children each, a section that no root leads to, a circle beside it
        refs = {0: ["s2", "s3", "none", "s4"], 1: ["s5"], 4: ["s6", "s7", "s4"], 5: [f"s{j}" for j in range(8, 36)], 36: ["s37"], 37: ["s36"], 38: ["s38"]}.get(i, [])
        sections.append(("w2" if i < 0 else "forest", i, f"s{i}", f"S{i}", [f"p{rng.randrange(9)}" for _ in range(i % 3)], refs))
    df = spark.createDataFrame(sections, schemas.WIKI_SECTIONS)
    both = pages.unionByName(pages.filter("wiki_id = 'w0'").withColumn("wiki_id", F.lit("forest")))
    grouped, mine = by_wiki(data), by_wiki(sections)
    grouped["forest"] = grouped["w0"]
    for local in (100_000, 0):
        got = {}
        for r in sorted(wiki.traverse_tree(df, both, local=local).collect(), key=lambda r: (r.wiki_id, r.ord)):
            got.setdefault(r.wiki_id, []).append((r.level, r.kind, r.node_id))
            assert r.ord == len(got[r.wiki_id]) - 1
        for w in grouped:
            assert got[w] == walk(mine.get(w, []), grouped[w]), (w, local)


@pytest.mark.parametrize("local", [100_000, 1_000])
def test_tree_of_a_long_chain(spark, local):
    n = 10_000
    chain = spark.range(n).select(
        F.lit("deep").alias("wiki_id"), F.col("id").alias("sec_ord"), F.concat(F.lit("s"), "id").alias("section_id"), F.lit("t").alias("title"),
        F.array(F.lit("p")).alias("pages"), F.array(F.concat(F.lit("s"), F.col("id") + 1)).alias("subsections"),
    )
    pages = spark.createDataFrame([("deep", 0, "p", "P"), ("flat", 1, "b", "B"), ("flat", 0, "a", "A")], "wiki_id string, page_ord long, page_id string, title string")
    spark.sparkContext.setJobGroup(f"chain-{local}", "tree of a chain")
    rows = wiki.traverse_tree(chain, pages, local=local).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{local}"))
    spark.sparkContext.setJobGroup("", "")
    got = {(r.wiki_id, r.ord): (r.level, r.kind, r.node_id) for r in rows}
    assert len(rows) == 2 * n + 2 and got["flat", 0] == (0, "page", "a") and got["flat", 1] == (0, "page", "b")
    assert all(got["deep", 2 * i] == (i, "section", f"s{i}") and got["deep", 2 * i + 1] == (i + 1, "page", "p") for i in range(n))
    print(local, "jobs", jobs)


def test_catalogue(spark):
    from datetime import datetime

    files = spark.createDataFrame(
        [(f"wiki_cache_github_own{i % 3}_Repo_{i}_en.json", datetime(2024, 1, 1 + i)) for i in range(9)] + [("wiki_cache_x_en.json", datetime(2024, 1, 1)), ("other.json", datetime(2024, 1, 1))],
        "file_name string, modified timestamp",
    )
    projects = catalogue.projects_from_files(files)
    assert projects.count() == 9
    assert [r.repo for r in catalogue.search_projects(projects, "rePO", 2).collect()] == ["Repo_8", "Repo_7"]
    assert catalogue.search_projects(projects, "OWN1/").count() == 3
    assert catalogue.search_projects(projects, "  ").count() == 9
    first = catalogue.newest_first(projects).first()
    assert (first.name, first.submittedAt) == ("own2/Repo_8", int(datetime(2024, 1, 9).timestamp() * 1000)) or first.name == "own2/Repo_8"
    assert catalogue.remove_projects(projects, projects.limit(2)).count() == 7


def test_default_ids(spark):
    df = spark.createDataFrame([(0, ""), (1, None), (2, "x")], "pos int, page_id string")
    assert [r.page_id for r in wiki.default_ids(df, "page", "page_id", "pos").collect()] == ["page-1", "page-2", "x"]


def test_exports_of_wikis_without_pages(pages, wikis):
    none = pages.filter("wiki_id = 'none'")
    assert all(r.markdown.endswith("## Table of Contents\n\n\n") for r in publish.export_markdown(none, wikis, "S").collect())
    assert all(json.loads(r.json)["pages"] == [] for r in publish.export_json(none, wikis, "S").collect())
