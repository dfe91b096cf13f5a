"""Reading repositories."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import CODE_SUFFIXES, DOC_SUFFIXES, TREE_SKIPPED_DIRS, TREE_SKIPPED_FILES
from ..functions.text import replace_all
from ..operators.scale import dense_index, ordered_text, sorted_index
from ..session import BATCH_BYTES, bound_batches, ensure_checkpoint_dir

READ_TRIES = 4
READ_BYTES = BATCH_BYTES
LIST_ROWS = 20_000
_ENTRY = "path string, is_dir boolean, length bigint, modified timestamp"


def _entries(path: str, recursive: bool) -> Iterator[tuple]:
    """Visible entries of a folder on any file system that Arrow can open."""
    from pyarrow import fs as pafs

    system, base = pafs.FileSystem.from_uri(path)
    prefix = path[: len(path) - len(base)]
    pending = [base]
    while pending:
        for info in system.get_file_info(pafs.FileSelector(pending.pop(), recursive=False)):
            if info.base_name.startswith("."):
                continue
            folder = info.type == pafs.FileType.Directory
            if folder and recursive:
                pending.append(info.path)
            else:
                yield prefix + info.path, folder, info.size or 0, info.mtime


def _lister(recursive: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "is_dir", "length", "modified"]
        for frame in frames:
            entries = (entry for path in frame["path"] for entry in _entries(path, recursive))
            while rows := list(islice(entries, LIST_ROWS)):
                yield pd.DataFrame(rows, columns=names)

    return run


def list_files(spark: SparkSession, root: str, split_levels: int = 3) -> DataFrame:
    """All visible files below `root` (`path, length, modified`).

    The first levels are opened one level per step and spread again, so one repository with most
    of the files is listed by many tasks; the folders below are walked in the tasks. Unlike a
    built-in file scan this also sees names that begin with an underscore.
    """
    ensure_checkpoint_dir(spark)
    base = root.rstrip("/") or "/"
    dirs = spark.createDataFrame([(base,)], "path string")
    found = []
    for level in range(split_levels + 1):
        last = level == split_levels
        entries = dirs.repartition("path").mapInPandas(_lister(recursive=last), _ENTRY)
        entries = entries if last else entries.checkpoint()
        found.append(entries.filter(~F.col("is_dir")).drop("is_dir"))
        dirs = entries.filter("is_dir").select("path")
    return reduce(DataFrame.unionByName, found)


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The visible files directly in a folder (`path, length, modified`), listed by a task: no name passes the driver."""
    base = folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder
    entries = spark.createDataFrame([(base.rstrip("/") or "/",)], "path string").mapInPandas(_lister(recursive=False), _ENTRY)
    return entries.filter(~F.col("is_dir")).drop("is_dir")


def _read_bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs as pafs

    rows, held = [], 0
    for frame in frames:
        columns = [*frame.columns, "content"]
        for row in frame.itertuples(index=False):
            for attempt in range(READ_TRIES):
                try:
                    system, inner = pafs.FileSystem.from_uri(row.path)
                    with system.open_input_stream(inner) as stream:
                        content = stream.read()
                    break
                except FileNotFoundError:  # deleted since it was listed
                    content = None
                    break
                except OSError:  # throttled or dropped: after some tries the task fails, nothing goes missing unseen
                    if attempt + 1 == READ_TRIES:
                        raise
                    time.sleep(2**attempt)
            if content is None:
                continue
            if rows and held + len(content) > READ_BYTES:  # a larger file goes alone
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
            rows.append((*row, content))
            held += len(content)
        if rows:
            yield pd.DataFrame(rows, columns=columns)
            rows, held = [], 0


def _relative(path: Column, root: str) -> Column:
    bare = F.regexp_replace(path, r"\A[a-z0-9+.-]+:(?://[^/]*)?", "")
    base = root if "://" not in root and not root.startswith("file:") else root.split(":", 1)[1].lstrip("/")
    return F.substr(bare, F.lit(len("/" + base.strip("/")) + 2))


def decode_text(content: Column) -> Column:
    """UTF-8 text with unified line ends; null for undecodable bytes."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "\r\n?", "\n")


def scan_corpus(
    spark: SparkSession,
    root: str,
    code_ext: Sequence[str] = CODE_SUFFIXES,
    doc_ext: Sequence[str] = DOC_SUFFIXES,
    repo_id: str | None = None,
    keep=None,
    engine: str = "tree",
) -> DataFrame:
    """A1: text files of the repositories below `root` (`repo_id, doc_ord, file_path, text`).

    Without `repo_id` each folder directly below `root` is a repository. `keep` filters the
    listing (path rules) before any file is opened. `engine="binaryFile"` uses the built-in
    source instead, which prunes on names but never sees names that begin with an underscore.
    """
    bound_batches(spark)
    suffixes = [e[1:] for e in (*code_ext, *doc_ext)]
    if engine == "binaryFile":
        listing = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
            .load(root)
        )
        if keep is not None:
            listing = keep(_with_repo(listing, root, repo_id))
        files = _with_repo(listing, root, repo_id).filter(~F.col("file_path").rlike(r"(^|/)\."))
        files = files.withColumn("doc_ord", F.xxhash64("file_path"))
    else:
        listing = _with_repo(list_files(spark, root), root, repo_id)
        listing = listing.filter(F.regexp_extract("file_path", r"\.([^./]+)\z", 1).isin(*suffixes))
        if keep is not None:
            listing = keep(listing)
        rank = F.array_position(F.array(*[F.lit(s) for s in suffixes]), F.regexp_extract("file_path", r"\.([^./]+)\z", 1))
        ordered = sorted_index(listing.withColumn("rank", rank), ["repo_id"], ["rank", "file_path"], "doc_ord")
        schema = "path string, repo_id string, file_path string, doc_ord bigint, content binary"
        files = (
            ordered.select("path", "repo_id", "file_path", "doc_ord")
            .repartition(F.xxhash64("path"))
            .mapInPandas(_read_bytes, schema)
        )
    return files.select(
        "repo_id", "doc_ord", "file_path", decode_text(F.col("content")).alias("text")
    ).filter("text IS NOT NULL")


def _with_repo(files: DataFrame, root: str, repo_id: str | None) -> DataFrame:
    relative = _relative(F.col("path"), root)
    if repo_id is not None:
        return files.withColumns({"repo_id": F.lit(repo_id), "file_path": relative})
    return files.withColumns(
        {
            "repo_id": F.substring_index(relative, "/", 1),
            "file_path": F.regexp_replace(relative, r"\A[^/]*/", ""),
        }
    )


def _listed(files: DataFrame) -> DataFrame:
    segments = F.split("file_path", "/")
    folders = F.slice(segments, 1, F.size(segments) - 1)
    name = F.element_at(segments, -1)
    hidden = F.exists(folders, lambda s: s.startswith(".") | s.isin(*TREE_SKIPPED_DIRS))
    return files.filter(~hidden & ~name.startswith(".") & ~name.isin(*TREE_SKIPPED_FILES))


def sorted_paths(files: DataFrame) -> DataFrame:
    """`repo_id, line_no, file_path` in path order."""
    return sorted_index(files.select("repo_id", "file_path"), ["repo_id"], ["file_path"], "line_no")


def file_tree(files: DataFrame) -> DataFrame:
    """A2: sorted visible paths, one per line (`repo_id, file_tree`)."""
    return ordered_text(sorted_paths(_listed(files)), ["repo_id"], "line_no", "file_path", "file_tree", "\n")


def pick_readme(files: DataFrame) -> DataFrame:
    """A3: text of the shallowest README per repository, first by path; empty if there is none."""
    path = F.col("file_path")
    found = F.lower(F.substring_index(path, "/", -1)) == "readme.md"
    place = F.struct(F.size(F.split(path, "/")).alias("depth"), path.alias("path"))
    return _listed(files).groupBy("repo_id").agg(
        F.coalesce(F.min_by(F.when(found, F.col("text")), F.when(found, place)), F.lit("")).alias("readme")
    )


def tree_from_listing(listing: DataFrame) -> DataFrame:
    """A4: file paths of paged remote listings in listing order (`repo_id, file_tree`).

    A payload is a JSON array of entries, or an object that holds one under `tree` or `values`.
    """
    payload = F.col("payload")
    rows = F.coalesce(F.get_json_object(payload, "$.tree"), F.get_json_object(payload, "$.values"), payload)
    entries = listing.select(
        "repo_id", "page_no",
        F.posexplode(F.from_json(rows, "array<struct<type: string, path: string>>")).alias("pos", "entry"),
    )
    files = entries.filter(F.col("entry.type").isin("blob", "commit_file")).select(
        "repo_id", "page_no", "pos", F.col("entry.path").alias("path")
    )
    ordered = dense_index(files, ["repo_id"], ["page_no", "pos"], "line_no", span=64)
    return ordered_text(ordered, ["repo_id"], "line_no", "path", "file_tree", "\n")


def decode_contents(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """A5: text of a contents-API answer, or the error it stands for."""
    body = F.from_json(
        F.col(payload), "message string, documentation_url string, content string, encoding string"
    )
    fail = lambda *c: F.concat(F.lit("Failed to get file content: "), *c)
    refused = body["message"].isNotNull() & body["documentation_url"].isNotNull()
    present = body["content"].isNotNull() & body["encoding"].isNotNull()
    raw = F.try_to_binary(replace_all(body["content"], "\n", ""), F.lit("base64"))
    text = F.try_validate_utf8(raw.cast("string"))
    usable = present & (body["encoding"] == "base64") & ~refused
    error = (
        F.when(F.get_json_object(payload, "$").isNull(), fail(F.lit("Invalid response from GitHub API")))
        .when(refused, fail(F.lit("GitHub API error: "), body["message"]))
        .when(~present, fail(F.lit("File content not found in GitHub API response")))
        .when(body["encoding"] != "base64", fail(F.lit("Unexpected encoding: "), body["encoding"]))
        .when(text.isNull(), fail(F.lit("content is not UTF-8 text")))
    )
    return payloads.withColumns({"text": F.when(usable, text), "error": error})


def detect_error_payload(df: DataFrame, content: str = "content") -> DataFrame:
    """A JSON error answer in place of raw file content."""
    c = F.col(content)
    message = F.when(
        c.startswith("{") & c.contains('"message":'), F.get_json_object(c, "$.message")
    )
    return df.withColumns(
        {
            "text": F.when(message.isNull(), c),
            "error": F.concat(F.lit("Failed to get file content: GitLab API error: "), message),
        }
    )
