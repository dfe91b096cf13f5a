"""Slide decks and workshops as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import DEFAULT_SLIDES, FINAL_PROJECT_NOTE, NOTE_DIV
from .text import WS, replace_all, trim_ws


def _found(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(1))


def slide_items(plan: Column, repo: Column, mode: str = "strict") -> Column:
    """Slide lines of a plan; the first of four patterns that finds any, else the defaults.

    In `strict` mode an item is only seen when the next line is another item or the text ends;
    `robust` reads every numbered line.
    """
    end = r"\n*\z"
    patterns = [
        rf"\d+\.[{WS}]+(.*?)(?=\n\d+\.|{end})",
        rf"\d+\)[{WS}]+(.*?)(?=\n\d+\)|{end})",
        rf"(?i)Slide[{WS}]+\d+[{WS}]*:?[{WS}]*(.*?)(?=\nSlide|{end})",
    ]
    if mode == "robust":
        patterns[0] = rf"(?m)^\d+\.[{WS}]+(.*)$"
    loose = F.filter(
        _found(plan, rf"(?m)^([^:\n]+)(?::[{WS}]*(.*?))?$"),
        lambda x: (F.char_length(x) > 3)
        & ~F.lower(x).contains("please")
        & ~F.lower(x).contains("here"),
    )
    defaults = F.array(*[replace_all(F.lit(line), "{repo}", repo) for line in DEFAULT_SLIDES])
    choices = [_found(plan, p) for p in patterns] + [loose]
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in choices], defaults)


def slide_title(item: Column) -> Column:
    return trim_ws(F.element_at(F.split(item, ":"), 1))


def slide_description(item: Column) -> Column:
    """Only the piece between the first and the second colon."""
    return F.coalesce(trim_ws(F.try_element_at(F.split(item, ":"), F.lit(2))), F.lit(""))


def slide_html(s: Column) -> Column:
    """Fenced block, slide div, or the first tag up to its closing tag; else the raw text."""
    fence = rf"(?s)```(?:html)?[{WS}]*(.*?)[{WS}]*```"
    slide_div = rf'(?s)<div class="slide".*?</div>[{WS}]*</div>'
    first_tag = F.regexp_extract(
        F.regexp_extract(s, r"(?s)<.*?>", 0), r"(?i)<([a-z][a-z0-9]*)", 1
    )
    element = F.call_function(
        "regexp_extract", s, F.concat(F.lit("(?is)<"), first_tag, F.lit(".*?</"), first_tag, F.lit(">")), F.lit(0)
    )
    chosen = (
        F.when(s.rlike(fence), F.regexp_extract(s, fence, 1))
        .when(s.contains('<div class="slide"'), F.regexp_extract(s, slide_div, 0))
        .when(s.contains("<") & s.contains(">") & (first_tag != ""), element)
    )
    return F.coalesce(F.nullif(chosen, F.lit("")), s)


def _literal_replacement(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def _replace(s: Column, pattern: Column | str, replacement: Column) -> Column:
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.regexp_replace(s, pattern, replacement)


def _after_line(s: Column, marker: Column, note: Column) -> Column:
    """Insert on the line below the first place where `marker` occurs, if that line ends.

    One pass of a regular expression; markers hold no special characters.
    """
    pattern = F.concat(F.lit(r"(?s)\A((?>.*?"), marker, F.lit(r")[^\n]*+\n)"))
    return _replace(s, pattern, F.concat(F.lit("$1"), _literal_replacement(note)))


def build_toc(s: Column) -> Column:
    """A contents list before the second heading, unless one is there."""
    headings = _found(s, r"(?m)^## (.*)$")
    entries = F.transform(
        headings,
        lambda h: F.concat(
            F.lit("- ["), h, F.lit("](#"),
            F.regexp_replace(F.regexp_replace(F.lower(h), rf"[^\w{WS}-]", ""), rf"[{WS}]+", "-"),
            F.lit(")\n"),
        ),
    )
    toc = F.concat(F.lit("## Table of Contents\n\n"), F.array_join(entries, ""), F.lit("\n"))
    # The list goes before the first "## " behind the first "# ", wherever in a line they are.
    wanted = ~s.contains("## Table of Contents") & ~s.contains("## Contents") & (F.size(headings) > 0)
    place = r"(?s)\A((?>.*?# ).*?)(?=## )"
    return F.when(wanted, _replace(s, place, F.concat(F.lit("$1"), _literal_replacement(toc)))).otherwise(s)


def exercise_minutes(i: Column, n: Column) -> Column:
    return (
        F.when(i == 0, F.lit(5)).when(i == n - 1, F.lit(15)).when(i > F.floor(n / 2), F.lit(12)).otherwise(F.lit(10))
    )


def annotate_exercises(s: Column) -> Column:
    """A progress note below every exercise heading."""
    headings = F.regexp_extract_all(s, F.lit(r"(?m)^## Exercise \d+:"), F.lit(0))

    def note(i: Column, n: Column) -> Column:
        return F.concat(
            F.lit(NOTE_DIV + "Exercise "), (i + 1).cast("string"), F.lit(" of "), n.cast("string"),
            F.lit(" | Estimated time: "), exercise_minutes(i, n).cast("string"),
            F.lit(" minutes\n</div>\n\n"),
        )

    steps = F.transform(
        headings, lambda h, i: F.struct(h.alias("heading"), note(i, F.size(headings)).alias("note"))
    )
    return F.aggregate(steps, s, lambda text, step: _after_line(text, step["heading"], step["note"]))


def final_project_note(s: Column) -> Column:
    """An effort note below the final project heading."""
    return F.when(
        s.rlike("(?m)^## Final Project"), _after_line(s, F.lit("## Final Project"), F.lit(FINAL_PROJECT_NOTE))
    ).otherwise(s)
