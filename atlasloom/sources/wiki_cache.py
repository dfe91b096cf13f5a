"""The stored wiki table and the catalogue of stored wikis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import WS_CHARS
from ..functions.urls import CACHE_PREFIX
from ..operators.catalogue import newest_first, projects_from_files
from ..operators.filters import check_language, resolve_language
from ..operators.scale import bounded_side, latest_wins, stored_side
from ..schemas import WIKI_FILE
from .corpus import list_folder
from .index_store import new_build

KEY = ["repo_type", "owner", "repo", "language"]


def upsert_wiki(cache: DataFrame, updates: DataFrame, version: str = "updated_at") -> DataFrame:
    """A10: the table after an upsert; the newest row per key wins, of equally new ones the update's.

    An unsupported language becomes the default first. View and model are not part of the key, so
    a later view replaces an earlier one.
    """
    fitted = resolve_language(updates).drop("language_name").withColumn("__update", F.lit(True))
    rows = fitted.unionByName(cache.withColumn("__update", F.lit(False)), allowMissingColumns=True)
    return newest_with_parts(rows, KEY, version, "__update").drop("__update")


def newest_with_parts(rows: DataFrame, keys: list[str], *version: str) -> DataFrame:
    """The newest row per key. Rows that are parts of a stored wiki (`part`) stay where the wiki's own row does, and are not ranked."""
    if "part" not in rows.columns:
        return latest_wins(rows, keys, *version)
    heads, small = stored_side(latest_wins(rows.filter("part IS NULL"), keys, *version))
    kept = heads.select("stored_id", *version)
    parts = rows.filter("part IS NOT NULL").join(F.broadcast(kept) if small else kept, ["stored_id", *version], "left_semi")
    return heads.unionByName(parts)


def append_rows(path: str, updates: DataFrame, deleted: bool = False) -> None:
    """Append rows to a stored log; `written` orders equal versions. Nothing that is stored is read or rewritten."""
    marks = {"deleted": F.lit(deleted), "written": F.lit(new_build())}
    updates.withColumns(marks).write.mode("append").parquet(path)


def newest_rows(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    """The table that a stored log stands for: the newest row of each key, unless that deletes it."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return newest_with_parts(rows, keys, version, "written").filter("NOT deleted").drop("deleted", "written")


def compact_rows(spark: SparkSession, path: str, target: str, keys: list[str], version: str) -> None:
    """The log's newest rows as a new log."""
    append_rows(target, newest_rows(spark, path, keys, version))


def write_wiki_cache(spark: SparkSession, path: str, updates: DataFrame) -> None:
    """A10 on a stored table: the upsert is an append."""
    append_rows(path, resolve_language(updates).drop("language_name"))


def read_wiki_cache(spark: SparkSession, path: str, version: str = "updated_at") -> DataFrame:
    """The stored table."""
    return newest_rows(spark, path, KEY, version)


def delete_stored_wikis(spark: SparkSession, path: str, keys: DataFrame, version: str = "updated_at") -> DataFrame:
    """A12 on a stored table: a mark per deleted key is appended -> status per key."""
    stored = read_wiki_cache(spark, path, version)
    _, status = delete_wiki(stored, keys)
    status = status.checkpoint()
    gone = stored.select(*KEY, version).distinct().join(status.filter("deleted").select(*KEY), KEY, "left_semi")
    append_rows(path, gone, deleted=True)
    return status


def read_wiki(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored rows for the asked keys; a missing wiki is a row of nulls."""
    asked = bounded_side(resolve_language(keys).drop("language_name").select(*KEY).distinct())
    found = cache.join(asked, KEY, "left_semi")
    return resolve_language(keys).drop("language_name").join(found, KEY, "left")


def delete_wiki(cache: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table without the keys, status per key). Unsupported languages and unknown keys are errors."""
    checked = bounded_side(check_language(keys.select(*KEY)))
    asked = checked.select(*KEY)
    present = cache.select(*KEY).join(asked, KEY, "left_semi").distinct().withColumn("present", F.lit(True))
    status = checked.join(present, KEY, "left").select(
        *KEY,
        F.coalesce(
            "error",
            F.when(F.col("present").isNull(), F.lit("Wiki cache not found")),
            F.concat(
                F.lit("Wiki cache for "), "owner", F.lit("/"), "repo", F.lit(" ("), "language",
                F.lit(") deleted successfully"),
            ),
        ).alias("status"),
        (F.col("error").isNull() & F.col("present").isNotNull()).alias("deleted"),
    )
    return cache.join(checked.filter("error IS NULL").select(*KEY), KEY, "left_anti"), status


def _file_name() -> Column:
    return F.try_url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def stored_names(spark: SparkSession, folder: str, prefix: str = CACHE_PREFIX) -> DataFrame:
    """Names and times of the stored wiki files in a folder (`file_name, modified`), listed by a task; no file is opened."""
    name = F.substring_index("path", "/", -1)
    return list_folder(spark, folder).filter(name.startswith(f"{prefix}_") & name.endswith(".json")).select(name.alias("file_name"), "modified")


def list_projects(spark: SparkSession, folder: str, prefix: str = CACHE_PREFIX) -> DataFrame:
    """Catalogue of the stored wiki files in a folder, newest first; no file is opened."""
    return newest_first(projects_from_files(stored_names(spark, folder, prefix), prefix))


def read_wiki_files(spark: SparkSession, folder: str, prefix: str = CACHE_PREFIX) -> dict[str, DataFrame]:
    """Stored wiki files as tables, read under one schema that is never inferred.

    `projects`: a row per file (`id` is its name) with the columns of the catalogue, its header and `malformed`: the text of a
    file that is no such document, else null. `pages`: the pages of the structure in order, with the generated content where
    there is some; a generated page that the structure lacks comes last. `sections`: the sections in order and whether they
    are roots. A document is one row, whatever its size; Spark does not see files without a byte.
    """
    texts = spark.read.option("pathGlobFilter", f"{prefix}_*.json").text(folder, wholetext=True)
    parsed = F.from_json("value", WIKI_FILE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"})

    def shaped(d: Column) -> Column:
        # a document of another shape is as malformed as one that is no JSON at all; trimming both ends would need eight bytes for each of the text
        right = F.ltrim("value", F.lit(WS_CHARS)).startswith("{") & d["wiki_structure"].isNotNull() & d["generated_pages"].isNotNull() & d["malformed"].isNull()
        return F.coalesce(right, F.lit(False))

    def read(d: Column) -> Column:
        return F.struct(
            F.when(~shaped(d), F.col("value")).alias("malformed"),
            *[d[c].alias(c) for c in ("wiki_structure", "generated_pages", "repo", "repo_url", "provider", "model")],
        )

    # Bound as a lambda variable, a document is parsed once for all that is read from it; behind it the text is only kept where it is malformed.
    files = texts.select(
        _file_name().alias("file_name"), F.col("_metadata.file_modification_time").alias("modified"), F.inline(F.transform(F.array(parsed), read))
    )
    structure = F.col("wiki_structure")
    header = files.select(
        "file_name", "modified", "malformed", structure["title"].alias("title"), structure["description"].alias("description"),
        F.coalesce("repo.repoUrl", "repo_url").alias("repo_url"), "provider", "model",
    )
    projects = projects_from_files(header, prefix, "malformed", "title", "description", "repo_url", "provider", "model")
    whole = files.filter("malformed IS NULL")
    # a document falls into its pages where it is parsed; nothing but its name goes along, so it is never a row of its own
    split = texts.select(
        _file_name().alias("id"), F.inline(F.element_at(F.transform(F.array(parsed), lambda d: F.when(shaped(d), _page_rows(d))), 1))
    )
    roots = F.coalesce(structure["rootSections"], F.array())
    sections = whole.select(F.col("file_name").alias("id"), roots.alias("roots"), F.posexplode(structure["sections"]).alias("sec_ord", "s")).select(
        "id", "sec_ord", F.col("s.id").alias("section_id"), "s.title", "s.pages", F.coalesce("s.subsections", F.array().cast("array<string>")).alias("subsections"),
        F.array_contains("roots", F.col("s.id")).alias("is_root"),
    )
    return {"projects": projects, "pages": _pages_of(split), "sections": sections}


def _page_rows(d: Column) -> Column:
    """The pages of a parsed document in an array, by name. Kind 0: generated, under its key and its id; 1: under its key only; 2: under its id only; 3: of the structure."""
    listed, entries = F.coalesce(d["wiki_structure"]["pages"], F.array()), F.map_entries(d["generated_pages"])

    def row(kind: Column, at: Column, name: Column, p: Column) -> Column:
        return F.struct(F.size(listed).alias("n_listed"), kind.alias("kind"), at.alias("at"), name.alias("name"), p.alias("p"))

    same = lambda e: e["value"]["id"].eqNullSafe(e["key"])
    own = F.transform(entries, lambda e, i: row(F.when(same(e), 0).otherwise(1), i, e["key"], e["value"]))
    others = F.transform(F.filter(entries, lambda e: ~same(e)), lambda e, i: row(F.lit(2), i, e["value"]["id"], e["value"]))
    return F.concat(F.transform(listed, lambda p, i: row(F.lit(3), i, p["id"], p)), own, others)


def _pages_of(rows: DataFrame) -> DataFrame:
    """Pages from the rows of documents (`id` and those of `_page_rows`): they meet their content by name, not inside of a document."""
    named = Window.partitionBy("id", "name")
    made = F.first(F.when(F.col("kind") < 2, F.struct(F.col("p.content").alias("content"))), ignorenulls=True)
    # the entry of a name is the first that has it as its key
    rows = rows.withColumn("made", made.over(named.orderBy(F.col("kind") >= 2, "at"))).withColumn("known", F.max(F.col("kind") == 3).over(named))
    extra = rows.filter("kind IN (0, 2) AND NOT known").withColumn(
        "page_ord", F.col("n_listed") + F.row_number().over(Window.partitionBy("id").orderBy("p")) - 1
    )
    pages = rows.filter("kind = 3").withColumn("page_ord", F.col("at")).unionByName(extra)
    return pages.select(
        "id", "page_ord", F.col("p.id").alias("page_id"), "p.title", F.coalesce(F.nullif("made.content", F.lit("")), "p.content", F.lit("")).alias("content"),
        F.col("p.filePaths").alias("file_paths"), "p.importance", F.col("p.relatedPages").alias("related_pages"), F.col("made").isNotNull().alias("generated"),
    )
