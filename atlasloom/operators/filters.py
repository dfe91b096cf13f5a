"""Path and request filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    DEFAULT_LANGUAGE, EXCLUDED_DIRS, EXCLUDED_FILES, LANGUAGES, NO_MESSAGES_ERROR, NOT_FROM_USER_ERROR,
    REQUEST_TOKEN_LIMIT,
)
from ..functions.text import clean_dir_pattern, count_tokens, is_blank, parse_filter_string
from .scale import bounded_side, stored_side


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _as_glob(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")


def filter_paths(
    files: DataFrame,
    dirs: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
    mode: str = "exclude",
    path: str = "file_path",
    glob: bool = False,
) -> DataFrame:
    """B1 / B2: keep or drop files by path segment or file name, in a narrow projection.

    Exclusion compares names literally (a pattern such as `*.map` is not a glob unless `glob=True`).
    Inclusion also accepts a name that ends with a pattern. Segments are those of the path
    relative to the repository.
    """
    if mode == "exclude":
        dirs = EXCLUDED_DIRS if dirs is None else dirs
        names = EXCLUDED_FILES if names is None else names
    cleaned = sorted({d.strip("./") for d in dirs or ()} - {""})
    in_dir = F.arrays_overlap(F.split(F.col(path), "/"), _strings(cleaned)) if cleaned else F.lit(False)
    name = _file_name(F.col(path))
    by_name = name.isin(*names) if names else F.lit(False)
    if mode == "exclude":
        for pattern in (n for n in names or () if glob and ("*" in n or "?" in n)):
            by_name = by_name | name.like(_as_glob(pattern))
        return files.filter(~(in_dir | by_name))
    if not dirs and not names:
        return files
    for pattern in names or ():
        by_name = by_name | F.endswith(name, F.lit(pattern))
    return files.filter(in_dir | by_name)


def filter_paths_by_rules(files: DataFrame, rules: DataFrame, path: str = "file_path", max_rows: int | None = None) -> DataFrame:
    """B1 / B2 where every repository has its own rules (`repo_id, kind, pattern`).

    `kind` is one of `excluded_dir`, `excluded_file`, `included_dir`, `included_file`. A repository with any inclusion rule ignores
    its exclusions, one without rules keeps everything. Rules that are measured small are folded to one row per repository and
    broadcast, so files are neither multiplied nor shuffled. Beyond that rules are never gathered.
    """
    known, small = stored_side(rules.select("repo_id", "kind", "pattern").distinct(), max_rows)
    return _by_folded_rules(files, known, path) if small else _by_looked_up_rules(files, known, path)


def _by_folded_rules(files: DataFrame, rules: DataFrame, path: str) -> DataFrame:
    def patterns(kind: str) -> Column:
        value = clean_dir_pattern(F.col("pattern")) if kind.endswith("dir") else F.col("pattern")
        return F.collect_set(F.when(F.col("kind") == kind, value)).alias(kind)

    per_repo = rules.groupBy("repo_id").agg(
        *[patterns(k) for k in ("excluded_dir", "excluded_file", "included_dir", "included_file")]
    )
    segments, name = F.split(F.col(path), "/"), _file_name(F.col(path))
    including = (F.size("included_dir") > 0) | (F.size("included_file") > 0)
    included = F.arrays_overlap(segments, F.col("included_dir")) | F.exists(
        "included_file", lambda p: F.endswith(name, p)
    )
    excluded = F.arrays_overlap(segments, F.col("excluded_dir")) | F.array_contains(F.col("excluded_file"), name)
    keep = F.when(F.col("excluded_dir").isNull(), F.lit(True)).otherwise(
        F.when(including, included).otherwise(~excluded)
    )
    return files.join(F.broadcast(per_repo), "repo_id", "left").filter(keep).select(*files.columns)


def _by_looked_up_rules(files: DataFrame, rules: DataFrame, path: str) -> DataFrame:
    """What a path could match - its segments, its name and the ends of its name - is looked up among the rules, in a
    projection of repository and path; a repository with very many rules is spread like any other."""
    value = F.when(F.col("kind").endswith("dir"), clean_dir_pattern(F.col("pattern"))).otherwise(F.col("pattern"))
    known = rules.select("repo_id", "kind", value.alias("part")).distinct()
    modes = bounded_side(rules.groupBy("repo_id").agg(F.bool_or(F.col("kind").startswith("included")).alias("including")))
    name = _file_name(F.col(path))
    one = lambda kind, part: F.struct(F.lit(kind).alias("kind"), part.alias("part"))
    segments = F.split(F.col(path), "/")
    ends = F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: one("included_file", F.substr(name, i)))
    excluding = F.concat(F.transform(segments, lambda x: one("excluded_dir", x)), F.array(one("excluded_file", name)))
    including = F.concat(F.transform(segments, lambda x: one("included_dir", x)), ends)
    listed = files.select("repo_id", path).distinct().join(modes, "repo_id")
    asked = listed.select("repo_id", path, F.inline(F.array_distinct(F.when(F.col("including"), including).otherwise(excluding))))
    matched = asked.join(known, ["repo_id", "kind", "part"], "left_semi").select("repo_id", path).distinct().withColumn("__hit", F.lit(True))
    marked = files.join(modes, "repo_id", "left").join(matched, ["repo_id", path], "left")
    keep = F.col("including").isNull() | (F.col("including") == F.col("__hit").isNotNull())
    return marked.filter(keep).select(*files.columns)


def union_rules(*rules: DataFrame) -> DataFrame:
    """Union of rule tables as a set."""
    merged = rules[0]
    for more in rules[1:]:
        merged = merged.unionByName(more)
    return merged.distinct()


merge_rules = union_rules


def default_rules(repos: DataFrame) -> DataFrame:
    """The default exclusions as rule rows for every repository."""
    def listed(kind: str, values: Sequence[str]) -> Column:
        return F.transform(_strings(values), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern")))

    rules = F.concat(listed("excluded_dir", EXCLUDED_DIRS), listed("excluded_file", EXCLUDED_FILES))
    return repos.select("repo_id", F.explode(rules).alias("rule")).select("repo_id", "rule.*")


def rules_from_strings(requests: DataFrame) -> DataFrame:
    """Rule rows of requests (`repo_id`, and filter strings `excluded_dir`, `excluded_file`, `included_dir`, `included_file`
    where they are given), as a set."""
    found = None
    for kind in ("excluded_dir", "excluded_file", "included_dir", "included_file"):
        if kind in requests.columns:
            rows = requests.select("repo_id", F.lit(kind).alias("kind"), F.explode(parse_filter_string(F.col(kind))).alias("pattern"))
            found = rows if found is None else found.unionByName(rows)
    return found.distinct() if found is not None else requests.select("repo_id", F.lit("").alias("kind"), F.lit("").alias("pattern")).limit(0)


def drop_blank_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is null or only whitespace are not embedded."""
    return df.filter(~is_blank(F.col(text)))


def validate_requests(messages: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """One row per conversation with its last role, last text, error and too-large flag.

    `requests` (`conv_id`) adds the conversations that have no message at all.
    """
    # the last positions are found on numbers alone, so no text is sorted or kept for a message that is not the last
    newest = messages.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    last = messages.select("conv_id", "turn", "role", "content").join(newest, ["conv_id", "turn"])
    if requests is not None:
        last = requests.select("conv_id").distinct().join(last, "conv_id", "left")
    return last.select(
        "conv_id",
        F.col("role").alias("last_role"),
        F.col("content").alias("last_content"),
        request_error(F.col("role")).alias("error"),
        F.coalesce(is_too_large(F.col("content")), F.lit(False)).alias("too_large"),
    )


def request_error(last_role: Column) -> Column:
    """Without a last message there are none; it must come from the user."""
    return F.when(last_role.isNull(), F.lit(NO_MESSAGES_ERROR)).when(
        last_role != "user", F.lit(NOT_FROM_USER_ERROR)
    )


def is_too_large(content: Column) -> Column:
    """Retrieval is skipped above the request limit."""
    return count_tokens(content) > REQUEST_TOKEN_LIMIT


def _supported(code: Column) -> Column:
    return code.isin(*LANGUAGES)


def _names() -> Column:
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])


def resolve_language(df: DataFrame, code: str = "language") -> DataFrame:
    """Unsupported codes become the default; adds the display name."""
    return df.withColumn(
        code, F.when(_supported(F.col(code)), F.col(code)).otherwise(F.lit(DEFAULT_LANGUAGE))
    ).withColumn("language_name", F.try_element_at(_names(), F.col(code)))


def language_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_names(), code), F.lit(LANGUAGES[DEFAULT_LANGUAGE]))


def check_language(df: DataFrame, code: str = "language") -> DataFrame:
    """An unsupported code is an error here."""
    return df.withColumn(
        "error", F.when(~F.coalesce(_supported(F.col(code)), F.lit(False)), F.lit("Language is not supported"))
    )
