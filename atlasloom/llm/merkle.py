"""Operator 9: Merkle fingerprints over paragraphs and sections.

A section ends after an empty line, a paragraph after a line end, and a leaf is a run of `LEAF` code points of a paragraph,
hashed with its place there. A node hashes its children; the root is the fingerprint. Equal roots mean equal texts;
differing branches show where texts differ, and likeness is the share of equal leaves. Everything is column expressions.

Null text: empty; the tree of an empty text has no leaves, and two such texts are alike (1.0). Null ids come first in the
order of documents, equal ids are ordered by text. Empty table: no rows. One row only: it is its own next document. Other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import prepare, text_of

LEAF = 8
BUCKET_BYTES = 8_000_000
SPLITS = 64


def sections(text: Column, leaf: int = LEAF) -> Column:
    """Sections -> paragraphs -> leaf hashes. Splitting keeps every character."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{leaf}}}"), 0), lambda x, i: F.xxhash64(x, i))
    return F.transform(F.split(text, "(?<=\n\n)"), lambda s: F.transform(F.split(s, "(?<=\n)"), leaves))


def root(tree: Column) -> Column:
    nodes = F.transform(tree, lambda s: F.hex(F.xxhash64(F.transform(s, lambda p: F.xxhash64(p)))))
    return F.sha2(F.array_join(nodes, "."), 256)


def leaf_set(tree: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(tree)))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """1 for equal roots, otherwise twice the common leaves among all leaves of both."""
    both = F.size(leaves_a) + F.size(leaves_b)
    common = F.size(F.array_intersect(leaves_a, leaves_b))
    return F.when((root_a == root_b) | (both == 0), 1.0).otherwise(2.0 * common / both)


def differing(tree_a: Column, tree_b: Column) -> Column:
    """Section and paragraph numbers where the trees differ: only differing sections are gone into."""
    pairs = F.zip_with(tree_a, tree_b, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    found = F.transform(pairs, lambda s, i: F.when(
        s["a"].eqNullSafe(s["b"]), F.array().cast("array<struct<section:int,paragraph:int>>")
    ).otherwise(F.filter(
        F.transform(
            F.zip_with(s["a"], s["b"], lambda p, q: ~p.eqNullSafe(q)),
            lambda d, j: F.when(d, F.struct(i.alias("section"), j.alias("paragraph"))),
        ),
        lambda x: x.isNotNull(),
    )))
    return F.flatten(found)


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, splits: int = SPLITS) -> DataFrame:
    """(`doc_id`, `text`, `next_text`): the text of the next document in ascending doc_id, after the last the first.

    Documents are cut into ranges of ids of about `bucket_bytes` each: `splits` quantiles, each cut evenly. The first
    document of each range also visits the range before, so one shuffle of the texts is enough and no task sees all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    at = [i / splits for i in range(1, splits)]
    size, lowest, highest, cuts = rows.agg(
        F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)), F.min("doc_id"), F.max("doc_id"),
        F.percentile_approx("doc_id", at, 10_000),
    ).first()
    cuts = sorted({lowest, *(cuts or [])}) if lowest is not None else []
    fine = max(1, -(-size // (bucket_bytes * max(1, len(cuts)))))
    if cuts:
        known = F.array(*[F.lit(c).cast("long") for c in cuts])
        coarse = F.size(F.filter(known, lambda c: c <= F.col("doc_id")))  # 1 for the lowest range
        low = F.get(known, F.col("coarse") - 1).cast("double")
        high = F.coalesce(F.get(known, F.col("coarse")).cast("double"), F.lit(highest + 1.0))
        share = F.try_divide(F.col("doc_id").cast("double") - low, high - low)
        part = F.floor(F.coalesce(share, F.lit(0.0)) * fine)
    else:
        coarse, part = F.lit(0), F.lit(0)
    rows = rows.withColumn("coarse", F.when(F.col("doc_id").isNull(), 0).otherwise(coarse)).withColumn(
        "fine", F.when(F.col("doc_id").isNull(), 0).otherwise(F.least(part, F.lit(fine - 1))).cast("long")
    )
    order = F.struct("doc_id", "text")  # nulls first
    firsts = rows.groupBy("coarse", "fine").agg(F.min(order).alias("first")).checkpoint()
    # the range before each range: inside its quantile, or the last range of the quantile before
    inside = Window.partitionBy("coarse").orderBy("fine")
    ranges = firsts.select("coarse", "fine", F.lag("fine").over(inside).alias("before"))
    ends = ranges.groupBy("coarse").agg(F.max("fine").alias("end"))  # at most `splits` + 1 rows
    whole = Window.orderBy("coarse")
    ends = ends.select("coarse", F.lag("coarse").over(whole).alias("c"), F.lag("end").over(whole).alias("f"))
    last = ranges.agg(F.max(F.struct("coarse", "fine"))).first()[0] or (0, 0)
    visits = (
        ranges.join(F.broadcast(ends), "coarse").select(
            F.col("coarse").alias("from_c"), F.col("fine").alias("from_f"),
            F.when(F.col("before").isNotNull(), F.col("coarse")).otherwise(F.coalesce("c", F.lit(last[0]))).alias("coarse"),
            F.coalesce("before", "f", F.lit(last[1])).alias("fine"),
        )
    )
    guests = visits.join(
        firsts.withColumnsRenamed({"coarse": "from_c", "fine": "from_f"}), ["from_c", "from_f"]
    ).select(F.col("first.doc_id").alias("doc_id"), F.col("first.text").alias("text"), "coarse", "fine", F.lit(1).alias("guest"))
    own = Window.partitionBy("coarse", "fine").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return (
        rows.withColumn("guest", F.lit(0)).unionByName(guests)
        .withColumn("next_text", F.lead("text").over(own)).filter("guest = 0").select("doc_id", "text", "next_text")
    )


def edited_fingerprints(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Fingerprints of each text and of its edited text (last half replaced by the start of the next document)."""
    prepare(docs.sparkSession)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    )
    names = {"text": "own", "edited": "edit", "next_text": "next"}
    for column, name in names.items():
        rows = rows.withColumn(f"{name}_tree", sections(F.col(column), leaf))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        *[root(F.col(f"{n}_tree")).alias(f"{n}_root") for n in names.values()],
        *[leaf_set(F.col(f"{n}_tree")).alias(f"{n}_leaves") for n in names.values()],
    )
    near = lambda n: likeness(F.col("own_root"), F.col("own_leaves"), F.col(f"{n}_root"), F.col(f"{n}_leaves"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.col("own_root").alias("fingerprint"),
        F.col("edit_root").alias("edited_fingerprint"), near("edit").alias("near_edited"), near("next").alias("near_next"),
    )
