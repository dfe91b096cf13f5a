"""Conversations (E2, D4-D6, E7, E10, C10). `turn` is the zero-based position in the message list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import MAX_RESEARCH_ITERATIONS, RESEARCH_TAG
from ..functions.prompts import turn_text
from ..functions.research import force_complete, research_stage
from ..functions.text import replace_all, trim_ws
from .filters import is_too_large
from .scale import bounded_side, dense_index, ordered_text


def pair_turns(messages: DataFrame, mode: str = "strict") -> DataFrame:
    """User / assistant pairs.

    `strict` pairs positions (0, 1), (2, 3), ...; a pair with other roles is dropped. `adjacent`
    pairs any user message with an assistant message right after it. Both group on (conversation,
    pair), at most two rows each, so a long conversation is spread like any other.
    """
    if mode == "strict":
        first = F.floor(F.col("turn") / 2) * 2
        slots = messages.select("conv_id", "turn", "role", "content", first.alias("start"))
    elif mode == "adjacent":
        slots = messages.filter(F.col("role").isin("user", "assistant")).select(
            "conv_id", "turn", "role", "content",
            F.when(F.col("role") == "user", F.col("turn")).otherwise(F.col("turn") - 1).alias("start"),
        )
    else:
        raise ValueError(f"unknown mode: {mode}")
    asks = (F.col("turn") == F.col("start")) & (F.col("role") == "user")
    answers = (F.col("turn") == F.col("start") + 1) & (F.col("role") == "assistant")
    return (
        slots.filter(asks | answers)
        .groupBy("conv_id", F.col("start").cast("bigint").alias("start"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.when(asks, F.col("content"))).alias("user_text"),
            F.max(F.when(answers, F.col("content"))).alias("assistant_text"),
        )
        .filter("n = 2")
        .select("conv_id", F.col("start").alias("turn_no"), "user_text", "assistant_text")
    )


def fold_history(turns: DataFrame) -> DataFrame:
    """Tagged dialog text per conversation (`conv_id, history`)."""
    tagged = turns.select("conv_id", "turn_no", turn_text(F.col("user_text"), F.col("assistant_text")).alias("text"))
    return ordered_text(tagged, ["conv_id"], "turn_no", "text", "history")


def _without_tag(content: Column, tag: str) -> Column:
    return trim_ws(replace_all(content, tag, ""))


def conversation_state(messages: DataFrame, tag: str = RESEARCH_TAG) -> DataFrame:
    """D5, D6 and E10 in one aggregation: one row per conversation.

    Columns: `is_research`, `iteration`, `phase`, `query` (last message without the tag, or the
    original topic when it asks to continue), `original_topic`, `last_role`, `too_large` (B9).
    """
    content, role = F.col("content"), F.col("role")
    opens = (role == "user") & ~F.lower(content).contains("continue")
    per_conv = messages.groupBy("conv_id").agg(
        F.bool_or(content.contains(tag)).alias("is_research"),
        (F.count_if(role == "assistant") + 1).alias("n"),
        F.max_by(F.struct(role, content), "turn").alias("last"),
        F.min_by(F.when(opens, content), F.when(opens, F.col("turn"))).alias("topic"),
    )
    raw = F.col("last.content")
    last = F.when(raw.contains(tag), _without_tag(raw, tag)).otherwise(raw)
    topic = _without_tag(F.col("topic"), tag)
    lowered = F.lower(last)
    continues = F.col("is_research") & lowered.contains("continue") & lowered.contains("research")
    replaced = continues & (F.coalesce(topic, F.lit("")) != "")
    iteration = F.when(F.col("is_research"), F.col("n")).otherwise(F.lit(1))
    return per_conv.select(
        "conv_id",
        F.col("last.role").alias("last_role"),
        "is_research",
        iteration.cast("int").alias("iteration"),
        F.when(~F.col("is_research"), F.lit("answer"))
        .when(iteration == 1, F.lit("first"))
        .when(iteration >= MAX_RESEARCH_ITERATIONS, F.lit("final"))
        .otherwise(F.lit("intermediate"))
        .alias("phase"),
        F.when(replaced, topic).alias("original_topic"),
        F.when(replaced, topic).otherwise(last).alias("query"),
        is_too_large(raw).alias("too_large"),
    )


def research_phase(messages: DataFrame) -> DataFrame:
    """Iteration and phase."""
    return conversation_state(messages).select("conv_id", "iteration", "phase")


def detect_research(messages: DataFrame, tag: str = RESEARCH_TAG) -> DataFrame:
    """Flag, and the messages' last text without the tag."""
    content = F.col("content")
    last = F.max_by("content", "turn")
    return messages.groupBy("conv_id").agg(
        F.bool_or(content.contains(tag)).alias("is_research"), last.alias("last")
    ).select(
        "conv_id", "is_research",
        F.when(F.col("last").contains(tag), _without_tag(F.col("last"), tag))
        .otherwise(F.col("last"))
        .alias("last_content"),
    )


def original_topic(messages: DataFrame) -> DataFrame:
    """What a "continue the research" request goes back to."""
    return conversation_state(messages).select("conv_id", "original_topic", "query")


def focus_query(requests: DataFrame, query: str = "query") -> DataFrame:
    """With a file path the retrieval query names that file."""
    named = requests.withColumn("file_path", F.nullif("file_path", F.lit("")))
    return named.withColumn(
        "rag_query",
        F.coalesce(F.concat(F.lit("Contexts related to "), "file_path"), F.col(query)),
    )


def focus_file(requests: DataFrame, docs: DataFrame, query: str = "query") -> DataFrame:
    """The focused query and the text of the named file."""
    named = focus_query(requests, query)
    # Only the named files are wanted: their paths are broadcast when few, so texts do not move.
    wanted = named.filter("file_path IS NOT NULL").select("repo_id", "file_path").distinct()
    texts = docs.select("repo_id", "file_path", F.col("text").alias("file_content")).join(
        bounded_side(wanted), ["repo_id", "file_path"]
    )
    return named.join(texts, ["repo_id", "file_path"], "left")


def upsert_stages(stages: DataFrame) -> DataFrame:
    """One stage per (iteration, type); the newest content at the first-seen position."""
    newest = F.max_by(F.struct("title", "content"), "seq")
    return (
        stages.groupBy("conv_id", "iteration", "type")
        .agg(newest.alias("newest"), F.min("seq").alias("seq"))
        .select("conv_id", "iteration", "type", "newest.title", "newest.content", "seq")
    )


def response_stages(messages: DataFrame) -> DataFrame:
    """H18 / H19 over assistant messages; the iteration is the number of answers so far.

    The number comes from positions in ranges, not from one sorted task per conversation.
    """
    answers = dense_index(
        messages.filter("role = 'assistant'"), ["conv_id"], ["turn"], "nth"
    ).withColumn("iteration", (F.col("nth") + 1).cast("int"))
    return answers.select(
        "conv_id",
        F.col("turn").alias("seq"),
        "iteration",
        research_stage(F.col("content"), F.col("iteration")).alias("stage"),
        force_complete(F.col("content"), F.col("iteration")).alias("outcome"),
    )
