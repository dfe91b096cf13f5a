"""Chat jobs: prompts for a table of requests (J5), research states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..constants import TOP_K
from ..functions.prompts import is_token_limit_error, render_fallback, render_prompt
from ..functions.urls import repo_short_name
from ..operators.chat import (
    conversation_state, focus_file, focus_query, fold_history, pair_turns, response_stages, upsert_stages,
)
from ..operators.context import group_context
from ..operators.embed import embed_chunks
from ..operators.filters import language_name, request_error
from ..operators.retrieval import retrieve
from ..operators.scale import bounded_side
from ..session import ensure_checkpoint_dir

# Placeholders a caller's system texts may use; one text per research phase.
SYSTEM_FIELDS = ("repo_type", "repo_url", "repo_name", "language_name", "iteration")
DEFAULT_SYSTEM = {
    phase: "Repository {repo_type} {repo_url} ({repo_name}); language {language_name}; " + f"phase {phase}, " + "iteration {iteration}."
    for phase in ("answer", "first", "intermediate", "final")
}


def _system_text(templates: dict[str, str]):
    text = F.coalesce(*[F.when(F.col("phase") == p, F.lit(t)) for p, t in templates.items()])
    for field in SYSTEM_FIELDS:
        text = F.replace(text, F.lit("{" + field + "}"), F.coalesce(F.col(field).cast("string"), F.lit("")))
    return text


def prepare_requests(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """Validation, research state and query of every request."""
    state = conversation_state(messages).select("conv_id", "phase", "iteration", "query", "last_role", "too_large")
    return requests.join(state, "conv_id", "left").withColumns(
        {
            "error": request_error(F.col("last_role")),
            "repo_name": repo_short_name(F.col("repo_url")),
            "language_name": language_name(F.col("language")),
        }
    )


def prompt_parts(
    requests: DataFrame,
    messages: DataFrame,
    chunks: DataFrame,
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    k: int = TOP_K,
    embedder: str = "hashing",
    **options,
) -> DataFrame:
    """What a prompt is made of, one row per valid request: `conv_id, system, history, file_path, file_content, context, query, provider`.

    `requests`: `conv_id, repo_id, repo_url, repo_type, language, provider, file_path`. Messages are folded once and the
    valid requests stored; requests with a too large input skip retrieval before any vector is scored. Histories are
    joined by ranges of turns, so a very long conversation is several parts until the end.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    ready = prepare_requests(requests, messages).filter("error IS NULL").checkpoint()
    focused = focus_file(ready, docs).withColumn("system", _system_text(templates or DEFAULT_SYSTEM))
    asked = focus_query(ready).filter(~F.col("too_large")).select(
        "repo_id", F.col("conv_id").cast("string").alias("query_id"), F.col("rag_query").alias("text")
    )
    hits = retrieve(embed_chunks(asked, embedder, **options).drop("text"), chunks, k)
    context = group_context(hits, ["query_id"])
    history = fold_history(pair_turns(messages))
    return (
        focused.join(context, focused["conv_id"].cast("string") == context["query_id"], "left").join(history, "conv_id", "left")
        .select("conv_id", "system", "history", "file_path", "file_content", "context", "query", "provider")
    )


def assemble_requests(
    requests: DataFrame,
    messages: DataFrame,
    chunks: DataFrame,
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    k: int = TOP_K,
    embedder: str = "hashing",
    call: Callable[[DataFrame], DataFrame] | None = None,
    **options,
) -> DataFrame:
    """One prompt per valid request (`conv_id, prompt`).

    With `call`, prompts are tried: it takes them and returns `conv_id, error`, null where a model answered. Requests that met a
    token limit get the smaller prompt without context (H26), all others keep theirs; `retried` tells them apart.
    """
    parts = prompt_parts(requests, messages, chunks, docs, templates, k, embedder, **options)
    if call is None:
        return render_rows(parts).select("conv_id", "prompt")
    parts = parts.checkpoint()  # read again for what is tried a second time
    first = render_rows(parts).select("conv_id", "prompt").checkpoint()
    return retry_smaller(parts, first, call(first))


def retry_smaller(parts: DataFrame, prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Second pass over `prompts`: only rows whose answer is a token limit error are rendered again, without context."""
    failed = bounded_side(answers.filter(is_token_limit_error(F.col("error"))).select("conv_id"))
    again = render_rows(parts.drop("context").join(failed, "conv_id", "left_semi"), fallback=True)
    kept = prompts.join(failed, "conv_id", "left_anti").select("conv_id", "prompt", F.lit(False).alias("retried"))
    return kept.unionByName(again.select("conv_id", "prompt", F.lit(True).alias("retried")))


def render_rows(rows: DataFrame, fallback: bool = False) -> DataFrame:
    """H25 / H26 over rows that already hold every piece of the prompt (`provider`, if there, decides its suffix)."""
    c = F.col
    history = c("history")
    provider = c("provider") if "provider" in rows.columns else None
    text = (
        render_fallback(c("system"), history, c("file_path"), c("file_content"), c("query"), provider)
        if fallback
        else render_prompt(c("system"), history, c("file_path"), c("file_content"), c("context"), c("query"), provider)
    )
    return rows.withColumn("prompt", text)


def classify_responses(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(research stages, completion per conversation).

    Completion is that of the newest answer; an unfinished fifth or later one is closed by force.
    """
    answers = response_stages(messages)
    stages = upsert_stages(answers.filter("stage IS NOT NULL").select("conv_id", "seq", "stage.*"))
    newest = answers.groupBy("conv_id").agg(
        F.max("iteration").alias("iterations"),
        F.max_by(F.struct("outcome.complete", "outcome.forced"), "iteration").alias("outcome"),
    )
    return stages, newest.select("conv_id", "iterations", "outcome.complete", "outcome.forced")
