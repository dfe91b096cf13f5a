"""Operator 3: personal data by bootstrapped contextual extraction, in column expressions only.

Base spans come from four patterns. They are the seeds: the words on either side of a seed are lexical patterns (a word
on a side, for a kind). A graph links patterns with the instances (values) that stand in them. Scores pass between both
for `ROUNDS` rounds: a pattern is as good as the share of its occurrences in the whole corpus that good instances make up,
an instance as good as its best pattern; seeds stay at 1. Patterns of at least `SUPPORT` different seeds and a score of `CONFIDENT`
or more discover identifiers that only resemble a kind (a number without the sign or the checksum, an address
written with "at"). Base spans always stay; found spans never overlap them.

The expressions read a text once from left to right: what precedes a match is skipped by possessive patterns, and matches
become rows whose places are running sums, so long texts and texts of very many matches take linear time. Null text: empty, no spans. Null or repeated ids: a row each. Empty table: no rows.
Hot patterns: occurrences are summed per (pattern, value) before any join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import prepare, text_of

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 3
CONFIDENT = 0.6
SMOOTH = 1.0
CONTEXT = 48

# What the kinds look like. Possessive forms of the given patterns, with failing matches left out where a
# pattern can tell; `_SKIP` runs to the next match.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?![0-9])"
MATCH = {
    "email": rf"{_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": rf"{_PART}\.{_PART}\.{_PART}\.{_PART}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){8,14}+(?![ ().-]*+[0-9])",
}
_SKIP = {
    "email": rf"(?:[^A-Za-z0-9._%+-]++|{_LOCAL}++(?!@{_LABEL}++\.{_LABEL}))*+",
    # a run of digits and dots is read four parts at a time, as the pattern does, valid or not
    "ip": rf"(?:[^0-9]++|(?!{_PART}\.{_PART}\.{_PART}\.{_PART})(?:[0-9]++(?:\.[0-9]++){{3}}+|[0-9]++))*+",
    "card": r"(?:[^0-9]++|(?![0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9]))[0-9](?:[ -]?[0-9])*+)*+",
    "phone": r"(?:[^+]++|\+(?![0-9](?:[ ().-]*+[0-9]){8,14}+(?![ ().-]*+[0-9])))*+",
}
#: Only texts with this are read for a kind.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
#: What only resembles a kind: numbers of seven digits or more, and addresses with other separators.
LOOSE = {
    "number": r"[0-9(][0-9().\x20-]{6,40}[0-9](?![A-Za-z0-9])",
    "address": r"[A-Za-z0-9._%+-]{1,64}(?:\x20?[(\[]at[)\]]\x20?|@)[A-Za-z0-9._-]{1,64}",
}
_LOOSE_START = {"number": r"(?<![A-Za-z0-9.@+(])", "address": r"(?<![A-Za-z0-9._%+@-])"}
_LOOSE_HINT = {"number": r"[0-9(][0-9().\x20-]{6}", "address": r"@|[(\[]at[)\]]"}
_LOOSE_KINDS = {"number": ("ip", "card", "phone"), "address": ("email",)}


_PIECE = "array<struct<kind:string,i:int,gap:bigint,size:bigint,value:string,left:string,right:string>>"


def _pieces(text: Column, kind: str, skip: str, match: str) -> Column:
    """Matches of a kind in a text, in order: the number of code points before each and in it, its value and the words beside it."""
    pattern = F.lit(f"(?s)({skip})({match}|\\z)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("gap"), F.regexp_extract_all(text, pattern, 2).alias("value"))

    def piece(all_: Column, x: Column, i: Column) -> Column:
        then = F.get(all_, i + 1)
        after = F.concat(F.coalesce(F.substring(then["gap"], 1, CONTEXT), F.lit("")), F.coalesce(F.substring(then["value"], 1, CONTEXT), F.lit("")))
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["value"]).cast("long").alias("size"), x["value"].alias("value"),
            _word(F.substring(x["gap"], -CONTEXT, CONTEXT), False).alias("left"), _word(F.substring(after, 1, CONTEXT), True).alias("right"),
        )

    # bound as a lambda variable, the text is read once
    bound = F.transform(F.array(pairs), lambda all_: F.transform(all_, lambda x, i: piece(all_, x, i)))
    return F.filter(F.get(bound, F.lit(0)), lambda x: x["value"] != "")


def luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    def weigh(d, i):
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)
    total = F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), weigh), F.lit(0), lambda s, x: s + x)
    return total % 10 == 0


def base_pieces(text: Column, kind: str) -> Column:
    """What `kind` matches in a text; matches that fail its test are still there, since they take their place."""
    hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_HINT[kind])
    return F.when(hint, _pieces(text, kind, _SKIP[kind], MATCH[kind])).otherwise(F.array().cast(_PIECE))


def loose_pieces(text: Column, shape: str) -> Column:
    """What resembles a kind in a text."""
    one = f"{_LOOSE_START[shape]}{LOOSE[shape]}"
    return F.when(text.rlike(_LOOSE_HINT[shape]), _pieces(text, shape, f"(?:(?!{one}).)*+", LOOSE[shape])).otherwise(F.array().cast(_PIECE))


def numbered(docs: DataFrame, place: str) -> DataFrame:
    """`docs` with a number per row, stored: a task that runs again must not number its rows otherwise."""
    return docs.withColumn(place, F.monotonically_increasing_id()).checkpoint()


def piece_rows(docs: DataFrame, place: str | None = None) -> DataFrame:
    """(`place`, `doc_id`, `pieces`) of every row, stored; `place` names a stored number of the rows, or they get one here."""
    number = F.monotonically_increasing_id() if place is None else F.col(place)
    text = text_of()
    pieces = F.concat(*[base_pieces(text, k) for k in KINDS], *[loose_pieces(text, s) for s in LOOSE])
    return docs.select(number.alias("place"), F.col("doc_id").cast("long").alias("doc_id"), pieces.alias("pieces")).checkpoint()


def span_rows(rows: DataFrame) -> DataFrame:
    """From stored `piece_rows`: (`place`, `kind`, `start`, `end`, `value`, `left`, `right`, `base`): base spans, and spans that resemble a kind (`number`,
    `address`) where no base span is. Places are sums over the matches before; all work is linear in the spans of a text."""
    found = rows.select("place", F.inline("pieces"))
    before = Window.partitionBy("place", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    spans = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).filter((F.col("kind") != "card") | luhn(F.col("value")))
    spans = spans.withColumn("base", F.col("kind").isin(*KINDS))
    # base spans that begin earlier (or at the same place) end before, and none begins inside
    order = (F.col("start"), F.desc("base"), F.col("kind"))
    passed = Window.partitionBy("place").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    coming = Window.partitionBy("place").orderBy(F.desc("start"), "base", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(passed)
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(coming)
    clear = F.col("base") | ((F.coalesce(ended, F.lit(0)) <= F.col("start")) & (F.coalesce(begins, F.col("end")) >= F.col("end")))
    return spans.withColumn("clear", clear).filter("clear").select("place", "kind", "start", "end", "value", "left", "right", "base")


def _word(context: Column, first: bool) -> Column:
    """The nearest word of a context, lower-case, digits as 0; empty at the end of a line or text."""
    near = F.regexp_extract(context, r"^[ \t]*(\S+)" if first else r"(\S+)[ \t]*$", 1)
    return F.regexp_replace(F.lower(near), "[0-9]+", "0")


def _occurrences(spans: DataFrame) -> DataFrame:
    """One row per span and side: place, span, the word on that side."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("word")) for s in ("left", "right")])
    return spans.select("place", "kind", "start", "end", "value", F.explode(sides).alias("s")).select(
        "place", "kind", "start", "end", "value", "s.side", "s.word"
    ).filter("word <> ''")


def discovered(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(`place`, `kind`, `start`, `end`) of identifiers that confident patterns find. `spans` is a stored `span_rows`."""
    seeds = _occurrences(spans.filter("base")).groupBy("kind", "side", "word", "value").agg(F.count(F.lit(1)).alias("n"))
    loose = _occurrences(spans.filter("NOT base")).checkpoint()
    kinds = F.when(F.col("kind") == "address", F.array(F.lit("email"))).otherwise(F.array(*[F.lit(k) for k in _LOOSE_KINDS["number"]]))
    others = loose.withColumn("kind", F.explode(kinds)).groupBy("kind", "side", "word", "value").agg(F.count(F.lit(1)).alias("n"))
    cues = seeds.groupBy("kind", "side", "word").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= SUPPORT).checkpoint()
    if cues.isEmpty():
        return loose.select("place", "kind", "start", "end").limit(0)
    graph = seeds.withColumn("seed", F.lit(1.0)).unionByName(others.withColumn("seed", F.lit(0.0)))
    graph = graph.join(cues.select("kind", "side", "word"), ["kind", "side", "word"]).checkpoint()
    words = cues.select("word").distinct()
    corpus = (
        docs.select(F.explode(F.split(F.regexp_replace(F.lower(text_of()), "[0-9]+", "0"), r"\s+")).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("total")).join(words, "word").checkpoint()
    )
    scores = graph.select("kind", "value", F.col("seed").alias("score"))
    for _ in range(ROUNDS):
        scores = scores.groupBy("kind", "value").agg(F.max("score").alias("score")).checkpoint()
        held = graph.join(scores, ["kind", "value"]).groupBy("kind", "side", "word").agg(F.sum(F.col("n") * F.col("score")).alias("good"))
        patterns = held.join(corpus, "word").join(cues, ["kind", "side", "word"]).select(
            "kind", "side", "word", (F.col("good") / (F.greatest("total", "good") + SMOOTH)).alias("p")
        ).checkpoint()
        scores = graph.join(patterns, ["kind", "side", "word"]).select(
            "kind", "value", F.greatest("seed", "p").alias("score")
        )
    good = patterns.filter(F.col("p") >= CONFIDENT)
    best = loose.withColumn("kind", F.explode(kinds)).join(good, ["kind", "side", "word"])
    return best.groupBy("place", "start", "end").agg(F.max(F.struct("p", "kind")).alias("b")).select(
        "place", F.col("b.kind").alias("kind"), "start", "end"
    )


def _listed(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(
        order[x["kind"]].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")
    )))
    return F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


_PLAIN = "array<struct<kind:string,start:bigint,end:bigint>>"


def found_spans(docs: DataFrame, place: str | None = None) -> DataFrame:
    """(`place`, `doc_id`, `base`, `found`): base spans and found spans of every row. `place` names a stored number of the rows."""
    prepare(docs.sparkSession)
    rows = piece_rows(docs, place)
    spans = span_rows(rows).checkpoint()
    one = F.struct("kind", "start", "end")
    both = spans.filter("base").select("place", one.alias("b"), F.lit(None).cast("struct<kind:string,start:bigint,end:bigint>").alias("f")).unionByName(
        discovered(docs, spans).select("place", F.lit(None).cast("struct<kind:string,start:bigint,end:bigint>").alias("b"), one.alias("f"))
    )
    lists = both.groupBy("place").agg(F.collect_list("b").alias("base"), F.collect_list("f").alias("found"))  # spans of one text
    empty = F.array().cast(_PLAIN)
    return rows.select("place", "doc_id").join(lists, "place", "left").select(
        "place", "doc_id", F.coalesce("base", empty).alias("base"), F.coalesce("found", empty).alias("found")
    )


def digest(spans: DataFrame) -> DataFrame:
    """Counts by kind, a hash of the base spans, and all spans."""
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind))
    counts = [of(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "found")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in brackets; `n_chars`, where there is one, counts anew."""
    prepare(docs.sparkSession)
    name = f"place_{uuid.uuid4().hex}"
    placed = numbered(docs, name)
    spans = found_spans(placed, name).filter(F.size("base") + F.size("found") > 0).select(
        F.col("place").alias(name),
        F.array_sort(F.transform(F.concat("base", "found"), lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")
        ))).alias(f"{name}_s"),
    )
    text = F.col("text")

    def step(state, x):
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(x["start"] - state["at"], F.lit(0)).cast("int"))
        tag = F.when(x["start"] < state["at"], "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(x["end"], state["at"]).alias("at"), F.concat(state["out"], F.array(gap, tag)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    new = F.when(F.col(f"{name}_s").isNull(), text).otherwise(F.aggregate(f"{name}_s", start, step, rest))
    rows = placed.join(spans, name, "left").withColumn("text", new)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
