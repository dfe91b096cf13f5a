"""Token counts, chunking and text helpers as native column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from ..constants import CHUNK_OVERLAP, CHUNK_WORDS, REDACTED

# Whitespace as a Unicode-aware trim or split sees it; Java's \s alone is ASCII only.
WS = (
    r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)


WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])
) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_ws(c: Column) -> Column:
    """Only the ends are looked at, however long the text is."""
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(rf"[^{WS}]")


def replace_all(c: Column, old: str | Column, new: str | Column) -> Column:
    old = F.lit(old) if isinstance(old, str) else old
    new = F.lit(new) if isinstance(new, str) else new
    return F.replace(c, old, new)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, which is what the character budgets count."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def count_tokens(text: Column) -> Column:
    """H1: a quarter of the characters, rounded down."""
    return F.floor(F.char_length(text) / 4).cast("int")


def encoder_token_counter(encoding: str):
    """U4: exact counts of a named encoding; a quarter of the characters where it is not available."""
    @F.pandas_udf("int")
    def counter(text: pd.Series) -> pd.Series:
        try:
            import tiktoken

            encode = tiktoken.get_encoding(encoding).encode
        except Exception:  # not installed, unknown, or its files cannot be fetched
            encode = None

        def count(t: str | None) -> int | None:
            if t is None:
                return None
            try:
                return len(encode(t)) if encode else len(t) // 4
            except ValueError:  # text that spells a control token
                return len(t) // 4

        return text.map(count)

    return counter


def estimate_tokens(text: Column) -> Column:
    """H2: number of whitespace-separated words."""
    return F.size(F.filter(F.split(text, rf"[{WS}]+"), lambda w: w != ""))


def chunk_texts(text: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """H3: array of overlapping word windows.

    The split words are bound once as a lambda variable, so a long text is split a single time
    however many windows it has.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the window")
    step = size - overlap

    def windows(words: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(words) - 1, F.lit(step)),
            lambda i: (i == 0) | (i + (size - step) < F.size(words)),
        )
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))

    return F.element_at(F.transform(F.array(F.split(text, " ")), windows), 1)


def clean_dir_pattern(pattern: Column) -> Column:
    """Every leading and trailing dot and slash is removed."""
    return F.btrim(pattern, F.lit("./"))


def parse_filter_string(raw: Column) -> Column:
    """One URL-decoded pattern per non-blank line; a plus sign stays a plus sign."""
    lines = F.filter(F.split(raw, "\n"), lambda x: ~is_blank(x))
    return F.transform(
        lines, lambda x: F.coalesce(F.try_url_decode(replace_all(x, "+", "%2B")), x)
    )


def percent_encode(c: Column) -> Column:
    """Percent-encoding that leaves only unreserved characters as they are."""
    form = F.url_encode(c)
    return replace_all(replace_all(replace_all(form, "+", "%20"), "*", "%2A"), "%7E", "~")


def redact(text: Column, secret: Column) -> Column:
    """The secret and its URL-encoded form are masked; an empty secret masks nothing."""
    masked = replace_all(replace_all(text, secret, REDACTED), percent_encode(secret), REDACTED)
    return F.when(F.coalesce(secret, F.lit("")) == "", text).otherwise(masked)
