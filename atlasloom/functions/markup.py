"""Generated XML and markdown as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import NO_SUMMARY
from ..schemas import WIKI_XML
from .text import WS, replace_all, trim_ws

_LINE = r"[^\n\r\x{2028}\x{2029}]"


def strip_fences(s: Column, kind: str = "markdown") -> Column:
    """Drop a leading fence (`markdown`, or bare / `xml`) and a trailing fence."""
    opening = "```markdown" if kind == "markdown" else "```(?:xml)?"
    return F.regexp_replace(F.regexp_replace(s, rf"(?i)\A{opening}[{WS}]*", ""), rf"```[{WS}]*\z", "")


def extract_wiki_xml(s: Column) -> Column:
    """First structure block without control characters; empty when there is none."""
    block = F.regexp_extract(s, r"(?s)<wiki_structure>.*?</wiki_structure>", 0)
    return F.regexp_replace(block, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def repair_xml(s: Column) -> Column:
    """Escape bare ampersands."""
    escaped = F.regexp_replace(s, "&(?!amp;|lt;|gt;|apos;|quot;)", "&amp;")
    return replace_all(escaped, "  >", ">")


def trimmed_element(s: Column, tag: str) -> Column:
    """Unescaped text of the first such element without surrounding white space, or null."""
    return unescape_xml(trim_ws(first_element(s, tag)))


def unescape_xml(s: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = replace_all(s, entity, char)
    return s


def first_element(s: Column, tag: str) -> Column:
    """Text of the first such element anywhere, or null."""
    pattern = rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1))


def _non_empty(*arrays: Column) -> Column:
    empty = F.array().cast("array<string>")
    joined = F.concat(*[F.coalesce(a, empty) for a in arrays])
    return F.filter(joined, lambda x: x.isNotNull() & (x != ""))


def _importance(level: Column) -> Column:
    return (
        F.when(level.isNull(), F.lit("medium"))
        .when(level.isin("high", "medium"), level)
        .otherwise(F.lit("low"))
    )


def _default_id(given: Column, prefix: str, position: Column) -> Column:
    """A missing id is named after its one-based position."""
    return F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit(prefix), (position + 1).cast("string")))


def _page_struct(page_id, title, importance, file_paths, related) -> Column:
    return F.struct(
        page_id.alias("page_id"), F.coalesce(title, F.lit("")).alias("title"),
        _importance(importance).alias("importance"),
        file_paths.alias("file_paths"), related.alias("related_pages"),
    )


def parse_xml(xml: Column) -> Column:
    """Structured form of a structure block under a fixed schema (never inferred per row)."""
    return F.from_xml(
        xml, WIKI_XML,
        {"ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_corrupt_record"},
    )


def pages_from_xml(parsed: Column) -> Column:
    """Page structs of a parsed block, in document order."""
    page = F.coalesce(parsed["pages"]["page"], parsed["page"])
    return F.transform(
        page,
        lambda p, i: _page_struct(
            _default_id(p["_id"], "page-", i), p["title"], p["importance"],
            _non_empty(p["relevant_files"]["file_path"], p["file_path"]),
            _non_empty(p["related_pages"]["related"], p["related"]),
        ),
    )


_TOKEN = r"(?s)<(/?)(section|title|page_ref|section_ref)(?=[\s/>])((?:\s[^>]*?)?)(/?)>([^<]*)"
_OPENED = "array<struct<no: int, depth: int, parent: int, at: int>>"
_FOLD = f"struct<stack: array<int>, n: int, opened: {_OPENED}, closed: array<struct<no: int, at: int>>>"


def _tokens(xml: Column) -> Column:
    """Tags of sections and of what they hold, in document order, each with the text behind it."""
    bare = F.regexp_replace(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.arrays_zip(*[
        F.regexp_extract_all(bare, F.lit(_TOKEN), F.lit(i)).alias(n) for i, n in enumerate(("shut", "name", "attributes", "lone", "text"), 1)
    ])


def _folded(tokens: Column) -> Column:
    """One left-to-right pass with a stack of open sections: where each section opens, with its depth and parent, and closes."""
    marks = F.filter(F.transform(tokens, lambda t, i: F.struct(t["name"].alias("name"), (t["shut"] == "/").alias("shut"), (t["lone"] == "/").alias("lone"), i.alias("at"))), lambda t: t["name"] == "section")

    def step(a: Column, t: Column) -> Column:
        top = F.try_element_at(a["stack"], F.lit(-1))
        # a tag that closes nothing is passed over
        closing, no = t["shut"] & top.isNotNull(), F.when(t["shut"], top).otherwise(a["n"])
        opening = ~t["shut"]
        opened = F.struct(no.alias("no"), F.size(a["stack"]).alias("depth"), F.coalesce(top, F.lit(-1)).alias("parent"), t["at"].alias("at"))
        return F.struct(
            F.when(closing, F.slice(a["stack"], F.lit(1), F.size(a["stack"]) - 1)).when(opening & ~t["lone"], F.array_append(a["stack"], no)).otherwise(a["stack"]).alias("stack"),
            F.when(opening, a["n"] + 1).otherwise(a["n"]).alias("n"),
            F.when(opening, F.array_append(a["opened"], opened)).otherwise(a["opened"]).alias("opened"),
            F.when(closing | opening & t["lone"], F.array_append(a["closed"], F.struct(no.alias("no"), t["at"].alias("at")))).otherwise(a["closed"]).alias("closed"),
        ).cast(_FOLD)

    empty = F.struct(F.array().alias("stack"), F.lit(0).alias("n"), F.array().alias("opened"), F.array().alias("closed")).cast(_FOLD)
    return F.aggregate(marks, empty, step)


def sections_from_xml(xml: Column) -> Column:
    """Section structs at any depth, in document order, with their depth and the section that they stand in.

    A section holds the references of the sections inside it as well; its title is the first one inside.
    """

    def section(tokens: Column, fold: Column) -> Column:
        ends = F.map_from_entries(fold["closed"])
        ids = F.transform(fold["opened"], lambda o: _default_id(_id(F.get(tokens, o["at"])["attributes"]), "section-", o["no"]))

        def one(o: Column) -> Column:
            end = F.coalesce(F.try_element_at(ends, o["no"]), F.size(tokens))
            inside = F.filter(F.slice(tokens, o["at"] + 2, F.greatest(F.lit(0), end - o["at"] - 1)), lambda t: t["shut"] == "")
            texts = lambda name: _non_empty(F.transform(F.filter(inside, lambda t: t["name"] == name), lambda t: unescape_xml(t["text"])))
            titles = F.transform(F.filter(inside, lambda t: t["name"] == "title"), lambda t: unescape_xml(t["text"]))
            return F.struct(
                F.get(ids, o["no"]).alias("section_id"), F.coalesce(F.get(titles, F.lit(0)), F.lit("")).alias("title"),
                texts("page_ref").alias("pages"), texts("section_ref").alias("subsections"),
                o["depth"].alias("depth"), F.when(o["parent"] >= 0, F.get(ids, o["parent"])).alias("parent_id"),
            )

        return F.transform(fold["opened"], one)

    # bound as lambda variables, tokens are cut out and folded once
    bound = F.transform(F.array(_tokens(xml)), lambda t: F.struct(t.alias("tokens"), _folded(t).alias("fold")))
    return F.flatten(F.transform(bound, lambda b: section(b["tokens"], b["fold"])))


def _count(xml: Column, tag: str) -> Column:
    """Opening tags of this very name."""
    return F.size(F.regexp_extract_all(xml, F.lit(rf"<{tag}[\s>]"), F.lit(0)))


def nested(xml: Column, parsed: Column, tag: str) -> Column:
    """Whether a well-formed block has such elements where the fixed schema does not look (inside other elements)."""
    seen = F.coalesce(F.size(F.coalesce(parsed[f"{tag}s"][tag], parsed[tag])), F.lit(0))
    return _count(xml, tag) > F.greatest(seen, F.lit(0))


def _elements(xml: Column, tag: str, end: str) -> Column:
    """Attributes and bodies of the elements of a name at any depth, in document order."""
    pattern = F.lit(rf"(?s)<{tag}((?:\s[^>]*)?)>(.*?)(?:{end})")
    return F.arrays_zip(
        F.regexp_extract_all(xml, pattern, F.lit(1)).alias("tag"), F.regexp_extract_all(xml, pattern, F.lit(2)).alias("body")
    )


def _texts(body: Column, tag: str) -> Column:
    found = F.regexp_extract_all(body, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return _non_empty(F.transform(found, unescape_xml))


def _id(attributes: Column) -> Column:
    return unescape_xml(F.regexp_extract(attributes, r"""\sid\s*=\s*["']([^"']*)""", 1))


def pages_anywhere(xml: Column) -> Column:
    """Page structs of a block whose pages stand at any depth."""
    return F.transform(
        _elements(xml, "page", "</page>"),
        lambda p, i: _page_struct(
            _default_id(_id(p["tag"]), "page-", i), F.get(_texts(p["body"], "title"), F.lit(0)),
            F.get(_texts(p["body"], "importance"), F.lit(0)), _texts(p["body"], "file_path"), _texts(p["body"], "related"),
        ),
    )


def pages_from_text(xml: Column) -> Column:
    """The same page structs cut out of unparsable text by pattern; sections are lost."""

    def all_of(body: Column, tag: str) -> Column:
        found = F.regexp_extract_all(body, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
        return _non_empty(F.transform(found, lambda x: unescape_xml(trim_ws(x))))

    def one_of(body: Column, tag: str) -> Column:
        pattern = f"(?s)<{tag}>(.*?)</{tag}>"
        return F.when(body.rlike(pattern), unescape_xml(trim_ws(F.regexp_extract(body, pattern, 1))))

    page = F.lit('(?s)<page id="(.*?)">(.*?)</page>')
    both = F.arrays_zip(
        F.regexp_extract_all(xml, page, F.lit(1)).alias("id"),
        F.regexp_extract_all(xml, page, F.lit(2)).alias("body"),
    )
    return F.transform(
        both,
        lambda p, i: _page_struct(
            _default_id(p["id"], "page-", i), one_of(p["body"], "title"), one_of(p["body"], "importance"),
            all_of(p["body"], "file_path"), all_of(p["body"], "related"),
        ),
    )


def page_summary(content: Column) -> Column:
    """The one-line paragraph after a heading and a blank line, else a fixed fallback."""
    pattern = rf"# {_LINE}*?\n\n({_LINE}*?)(?:\n\n|\z)"
    return F.when(content.rlike(pattern), trim_ws(F.regexp_extract(content, pattern, 1))).otherwise(
        F.lit(NO_SUMMARY)
    )
