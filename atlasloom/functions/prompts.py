"""Prompt text as column expressions (H25, H26, D3 pieces). System texts are supplied by the caller."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from ..constants import NO_RETRIEVAL_NOTE, SIZE_LIMIT_NOTE, TOKEN_LIMIT_ERRORS
from .text import is_blank


def turn_text(user_text: Column, assistant_text: Column) -> Column:
    """One dialog turn in tags."""
    return F.concat(
        F.lit("<turn>\n<user>"), user_text, F.lit("</user>\n<assistant>"), assistant_text,
        F.lit("</assistant>\n</turn>\n"),
    )


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def prompt_head(system: Column) -> Column:
    return F.concat(F.lit("/no_think "), system, F.lit("\n\n"))


def history_block(history: Column) -> Column:
    return F.when(
        _filled(history),
        F.concat(F.lit("<conversation_history>\n"), history, F.lit("</conversation_history>\n\n")),
    ).otherwise(F.lit(""))


def file_block(path: Column, content: Column) -> Column:
    return F.when(
        _filled(content),
        F.concat(
            F.lit('<currentFileContent path="'), path, F.lit('">\n'), content, F.lit("\n</currentFileContent>\n\n")
        ),
    ).otherwise(F.lit(""))


def context_block(context: Column) -> Column:
    return F.when(is_blank(context), F.lit(NO_RETRIEVAL_NOTE)).otherwise(
        F.concat(F.lit("<START_OF_CONTEXT>\n"), context, F.lit("\n<END_OF_CONTEXT>\n\n"))
    )


def query_block(query: Column, provider: Column | None = None) -> Column:
    text = F.concat(F.lit("<query>\n"), query, F.lit("\n</query>\n\nAssistant: "))
    if provider is None:
        return text
    return F.when(provider == "ollama", F.concat(text, F.lit(" /no_think"))).otherwise(text)


def render_prompt(
    system: Column, history: Column, path: Column, file_content: Column, context: Column,
    query: Column, provider: Column | None = None,
) -> Column:
    """System, history, file, context or a note, query."""
    return F.concat(
        prompt_head(system), history_block(history), file_block(path, file_content),
        context_block(context), query_block(query, provider),
    )


def render_fallback(
    system: Column, history: Column, path: Column, file_content: Column, query: Column,
    provider: Column | None = None,
) -> Column:
    """The same without context, with a note on the size limit."""
    return F.concat(
        prompt_head(system), history_block(history), file_block(path, file_content),
        F.lit(SIZE_LIMIT_NOTE), query_block(query, provider),
    )


def is_token_limit_error(message: Column) -> Column:
    return reduce(or_, [message.contains(m) for m in TOKEN_LIMIT_ERRORS])
