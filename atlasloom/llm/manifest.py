"""Operator 13: a Merkle manifest of a dataset, kept in a persistent path-copying tree.

Every row is a leaf: the SHA-256 over its fields. The leaves of a group (`lang`), in ascending order of `doc_id`, are
the bottom of a binary tree; the roots of the groups, in order of their keys, are the bottom of one more. Trees are
built in aligned blocks of 2 ** `BITS` nodes, one task each, so a group of any size is many blocks, and the block roots are
the nodes of the next round: a few rounds reach the root.

A tampered leaf makes a version of its block's tree: its ancestors are copied, every other node is shared with the
version before it. Above the block a version goes on along the block's path, whose siblings are shared as well, so all
versions of a dataset are computed in the tasks of the blocks and none holds more than a block and its paths.

Null fields are hashed as `-`; a null group is a group of its own, the first; null ids come first in their group and are
not tampered with. Repeated rows are leaves of their own, ordered by id, then by hash. One row: leaf, group root and
root are equal and its proof is the hash of nothing. Empty table: no rows. Very long texts are hashed by Spark and do
not travel. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scale import bounded_side, sorted_index
from .common import prepare

BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_hash(*values: Column) -> Column:
    """SHA-256 over fields, each with its length in bytes in front."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class VersionedTree:
    """A binary tree of fixed height over leaves; versions share all nodes but the copied path.

    Nodes are rows of three lists; `right` is -1 for a node with one child. Node ids never change.
    """

    def __init__(self, leaves: Sequence[str], height: int):
        self.height, self.digests = height, list(leaves)
        self.left, self.right = [-1] * len(leaves), [-1] * len(leaves)
        level = list(range(len(leaves)))
        for _ in range(height):
            level = [self._node(level[i], level[i + 1] if i + 1 < len(level) else -1) for i in range(0, len(level), 2)]
        (self.root,) = level

    def _node(self, left: int, right: int) -> int:
        both = [self.digests[left]] if right < 0 else [self.digests[left], self.digests[right]]
        return self._add(digest(*both), left, right)

    def _add(self, own: str, left: int = -1, right: int = -1) -> int:
        self.digests.append(own)
        self.left.append(left)
        self.right.append(right)
        return len(self.digests) - 1

    def _way(self, at: int, root: int) -> list[tuple[int, int]]:
        """(node, side taken) from the root down to the leaf's parent."""
        way = []
        for h in range(self.height - 1, -1, -1):
            side = at >> h & 1
            way.append((root, side))
            root = self.right[root] if side else self.left[root]
        return way

    def version(self, at: int, leaf: str, root: int | None = None) -> int:
        """Root of the version of `root` in which leaf number `at` is `leaf`."""
        way = self._way(at, self.root if root is None else root)
        node = self._add(leaf)
        for parent, side in reversed(way):
            node = self._node(self.left[parent], node) if side else self._node(node, self.right[parent])
        return node

    def path(self, at: int, root: int | None = None) -> list[str]:
        """Siblings from the leaf up: `L` or `R` and the sibling's hash, `-` where there is none."""
        out = []
        for parent, side in self._way(at, self.root if root is None else root):
            if side:
                out.append("L" + self.digests[self.left[parent]])
            else:
                out.append("R" + self.digests[self.right[parent]] if self.right[parent] >= 0 else "-")
        return out[::-1]


def climb(own: str, path: Sequence[str]) -> list[str]:
    """Hashes of the ancestors along a path, the root last."""
    out = []
    for step in path:
        own = digest(step[1:], own) if step[0] == "L" else digest(own, step[1:])
        out.append(own)
    return out


def _tree(table: pa.Table, bits: int, column: str = "digest") -> tuple[pa.Table, VersionedTree]:
    table = table.sort_by("pos")
    height = min(bits, (table.column("n")[0].as_py() - 1).bit_length())
    return table, VersionedTree(table.column(column).to_pylist(), height)


def _block_roots(nodes: DataFrame, bits: int) -> DataFrame:
    """Nodes (`key`, `pos`, `n` in the group, `digest`) -> the nodes above each block."""

    def build(table: pa.Table) -> pa.Table:
        table, tree = _tree(table, bits)
        n = table.column("n")[0].as_py()
        row = {"key": table.column("key")[0], "pos": table.column("pos")[0].as_py() >> bits, "n": -(-n >> bits), "digest": tree.digests[tree.root]}
        return pa.table({k: [v.as_py() if isinstance(v, pa.Scalar) else v] for k, v in row.items()})

    rows = nodes.select("key", "pos", "n", "digest", F.shiftright("pos", bits).alias("block"))
    return rows.groupBy("key", "block").applyInArrow(build, "key string, pos long, n long, digest string")


def _paths_below(nodes: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """Paths of nodes, from the paths of the blocks that they are in -> (`key`, `pos`, `path`, `root`)."""

    def extend(table: pa.Table, over: pa.Table) -> pa.Table:
        table, tree = _tree(table, bits)
        upper = over.column("path")[0].as_py()
        paths = [tree.path(i) + upper for i in range(len(table))]
        return pa.table({
            "key": table.column("key"), "pos": table.column("pos"), "path": pa.array(paths, pa.list_(pa.string())),
            "root": pa.array([over.column("root")[0].as_py()] * len(table)),
        })

    rows = nodes.select("key", "pos", "n", "digest", F.shiftright("pos", bits).alias("block"))
    blocks = above.select("key", F.col("pos").alias("block"), "path", "root")
    return rows.groupBy("key", "block").cogroup(blocks.groupBy("key", "block")).applyInArrow(
        extend, "key string, pos long, path array<string>, root string"
    )


def block_paths(nodes: DataFrame, largest: int, bits: int = BITS) -> DataFrame:
    """For each block of nodes its path to the root of its group and that root -> (`key`, `pos`, `path`, `root`).

    `largest` is the largest `n`. Each round is a table of block roots, smaller by 2 ** `bits`.
    """
    rounds = [_block_roots(nodes, bits).checkpoint()]
    largest = -(-largest >> bits)
    while largest > 1:
        rounds.append(_block_roots(rounds[-1], bits).checkpoint())
        largest = -(-largest >> bits)
    paths = rounds.pop().select("key", "pos", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))
    while rounds:
        paths = _paths_below(rounds.pop(), paths, bits)
    return paths.checkpoint()


def _placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Rows with their place `pos` in their group and the size `n` of the group; the size of the largest."""
    placed = sorted_index(rows, ["key"], order, "pos")
    sizes = bounded_side(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    return placed.join(sizes, "key"), sizes.agg(F.max("n")).first()[0] or 0


def _leaves(docs: DataFrame, tampered: Column | None, changed: dict[str, Column], group: str) -> DataFrame:
    value = lambda f: changed.get(f, F.col(f))
    other = F.when(tampered, leaf_hash(*[value(f) for f in FIELDS])) if tampered is not None else F.lit(None).cast("string")
    key = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), leaf_hash(*[F.col(f) for f in FIELDS]).alias("digest"), other.alias("version"))


def _prepared(docs: DataFrame, tampered: Column | None, changed: dict[str, Column] | None, group: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """Placed leaves, and for each block of leaves: path to the root of all, root of the group, root of all."""
    prepare(docs.sparkSession)
    leaves, largest = _placed(_leaves(docs, tampered, changed or {}, group).checkpoint(), ["doc_id", "digest"])
    leaves = leaves.checkpoint()
    inner = block_paths(leaves, largest, bits)
    groups = inner.filter("pos = 0").select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("root").alias("digest")).checkpoint()
    placed, many = _placed(groups, ["of"])
    placed = placed.checkpoint()
    outer = _paths_below(placed, block_paths(placed, many, bits), bits)
    outer = placed.select("of", "pos").join(outer.select("pos", F.col("path").alias("outer"), F.col("root").alias("top")), "pos")
    paths = inner.join(outer.select(F.col("of").alias("key"), "outer", "top"), "key").select(
        "key", F.col("pos").alias("block"), F.concat("path", "outer").alias("path"), F.col("root").alias("subroot"), F.col("top").alias("root")
    )
    return leaves.withColumn("block", F.shiftright("pos", bits)), paths


def manifest(
    docs: DataFrame, tampered: Column | None = None, changed: dict[str, Column] | None = None, group: str = "lang", bits: int = BITS
) -> DataFrame:
    """One row per row of `docs`: leaf, roots, proof and the root that its version has.

    Where `tampered` holds, the row's version has the fields in `changed` replaced; a version is one changed leaf.
    -> (`doc_id`, `leaf`, `subroot`, `root`, `proof_sha256`, `folded_root`, `verified`)
    """
    leaves, paths = _prepared(docs, tampered, changed, group, bits)

    def finish(table: pa.Table, over: pa.Table) -> pa.Table:
        table, tree = _tree(table, bits)
        subroot, root, upper = (over.column(c)[0].as_py() for c in ("subroot", "root", "path"))
        base = (climb(tree.digests[tree.root], upper) or [tree.digests[tree.root]])[-1]
        above = "".join(step[1:] for step in upper)
        proofs, folded = [], []
        for i, new in enumerate(table.column("version").to_pylist()):
            proofs.append(digest("".join(step[1:] for step in tree.path(i)), above))
            if new is None:
                folded.append(base)
            else:
                own = tree.digests[tree.version(i, new)]
                folded.append((climb(own, upper) or [own])[-1])
        n = len(table)
        return pa.table({
            "doc_id": table.column("doc_id"), "leaf": table.column("digest"), "subroot": pa.array([subroot] * n), "root": pa.array([root] * n),
            "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([f == root for f in folded]),
        })

    return leaves.groupBy("key", "block").cogroup(paths.groupBy("key", "block")).applyInArrow(
        finish, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


def version_nodes(
    docs: DataFrame, tampered: Column, changed: dict[str, Column], group: str = "lang", bits: int = BITS
) -> DataFrame:
    """The nodes that each version copies, leaf first: (`doc_id`, `height`, `digest`, `shared`).

    `shared` is the hash of the untouched node beside the copied one, null at the root and beside lone nodes. Any node of
    a version is in this table or in the base tree.
    """
    leaves, paths = _prepared(docs, tampered, changed, group, bits)

    def copied(table: pa.Table, over: pa.Table) -> pa.Table:
        table, tree = _tree(table, bits)
        upper = over.column("path")[0].as_py()
        rows = []
        for i, (doc, new) in enumerate(zip(table.column("doc_id").to_pylist(), table.column("version").to_pylist())):
            if new is not None:
                root = tree.version(i, new)
                way = [*reversed(tree._way(i, root)), (root, 0)]
                own = [new, *[tree.digests[node] for node, _ in way[:-1]]]
                steps = tree.path(i, root) + upper
                rows += [(doc, h, d, s[1:] or None if s else None) for h, (d, s) in enumerate(zip(own + climb(own[-1], upper), [*steps, None]))]
        names = ["doc_id", "height", "digest", "shared"]
        types = [pa.int64(), pa.int32(), pa.string(), pa.string()]
        return pa.table([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)

    return leaves.groupBy("key", "block").cogroup(paths.groupBy("key", "block")).applyInArrow(
        copied, "doc_id long, height int, digest string, shared string"
    )
