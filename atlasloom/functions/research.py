"""State of multi-turn research responses as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from ..constants import (
    CLOSING_HEADERS, COMPLETION_PHRASES, CONTINUING_PHRASES, FINAL_MARKER, FORCED_CONCLUSION,
    MAX_RESEARCH_ITERATIONS, PLAN_MARKER, UPDATE_MARKER,
)


def contains_any(s: Column, phrases) -> Column:
    return reduce(or_, [s.contains(p) for p in phrases])


def research_complete(s: Column) -> Column:
    """Does the response say that the research is finished?"""
    closed = contains_any(s, CLOSING_HEADERS) & ~contains_any(s, CONTINUING_PHRASES)
    said = contains_any(s, COMPLETION_PHRASES) | (s.contains("Final") & s.contains("Conclusion"))
    one_file = (
        s.contains("Dockerfile")
        & contains_any(s, ("This Dockerfile", "The Dockerfile"))
        & ~contains_any(s, ("Next Steps", "In the next iteration"))
    )
    return s.contains(FINAL_MARKER) | closed | said | one_file


def research_stage(s: Column, iteration: Column) -> Column:
    """Stage of a response (`type`, `title`, `content`, `iteration`), or null."""
    number = iteration.cast("string")
    planned = (iteration == 1) & s.contains(PLAN_MARKER)
    updated = iteration.between(1, 4) & F.contains(s, F.concat(F.lit(UPDATE_MARKER), number))
    kind = (
        F.when(planned, F.lit("plan"))
        .when(updated, F.lit("update"))
        .when(s.contains(FINAL_MARKER), F.lit("conclusion"))
    )
    title = (
        F.when(kind == "plan", F.lit("Research Plan"))
        .when(kind == "update", F.concat(F.lit("Research Update "), number))
        .otherwise(F.lit("Final Conclusion"))
    )
    return F.when(
        kind.isNotNull(),
        F.struct(kind.alias("type"), title.alias("title"), s.alias("content"), iteration.alias("iteration")),
    )


def force_complete(s: Column, iteration: Column) -> Column:
    """From the last iteration on, an unfinished response is closed with a fixed note."""
    done = research_complete(s)
    forced = (iteration >= MAX_RESEARCH_ITERATIONS) & ~done
    return F.struct(
        F.when(forced, F.concat(s, F.lit(FORCED_CONCLUSION))).otherwise(s).alias("content"),
        (done | forced).alias("complete"),
        forced.alias("forced"),
    )
