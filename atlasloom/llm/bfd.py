"""Operator 2: best-fit-decreasing packing with a segment tree over capacities.

Each task gathers the pieces of about `BLOCK_IDS` ids, longest first, and puts each into the window with the least
room that still holds it. A segment tree over room sizes finds that window in logarithmic time. Overlong documents
are cut into full windows without loss. A row is one window: the padded id row of the matrix, the cumulative segment
lengths and the positions, which restart at every segment.

Null text: empty (the end id only). Empty table: no rows. Null or repeated ids: every row is a document of its own.
Other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import prepare, text_of
from .tokens import encoded

WINDOW = 4096
END_ID = 2
BLOCK_IDS = 8_000_000

WINDOWS = (
    "sequence_id long, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>, "
    "doc_tokens array<long>"
)


class RoomTree:
    """Counts of windows by room, as a segment tree: smallest room of at least n."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += change
            i >>= 1

    def at_least(self, n: int) -> int | None:
        i = self.leaves + n
        if self.count[i]:
            return n
        while i > 1:  # up to the first ancestor with windows to its right
            if not i & 1 and self.count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Windows as lists of item numbers."""
    tree, rooms, windows = RoomTree(size), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room = tree.at_least(n)
        if room is None:
            room, at = size, len(windows)
            windows.append([])
        else:
            at = rooms[room].pop()
            tree.add(room, -1)
        windows[at].append(i)
        if room > n:
            rooms.setdefault(room - n, []).append(at)
            tree.add(room - n, 1)
    return windows


def pack_best_fit(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int | None = END_ID, pad_id: int = 0,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Pack whole documents (`doc_id`, `text`) -> one row per window of `window` ids."""
    prepare(docs.sparkSession)

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([
            ("sequence_id", pa.int64()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
            ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
            ("doc_tokens", pa.list_(pa.int64())),
        ])
        sequence = TaskContext.get().partitionId() << 40

        def packed(pieces):
            nonlocal sequence
            rows = []
            for items in best_fit_decreasing([len(p[3]) // 4 for p in pieces], window):
                own = [pieces[i] for i in items]
                lengths = [len(p[3]) // 4 for p in own]
                ids = np.full(window, pad_id, "<u4")
                used = np.frombuffer(b"".join(p[3] for p in own), "<u4")
                ids[: len(used)] = used
                positions = np.concatenate([np.arange(n, dtype="<i4") for n in [*lengths, window - len(used)]])
                rows.append((
                    sequence, ids.tobytes(), [0, *np.cumsum(lengths).tolist()], positions.tobytes(),
                    [p[0] for p in own], [p[1] for p in own], [p[2] for p in own],
                ))
                sequence += 1
                if len(rows) == 256:
                    yield arrow(rows)
                    rows = []
            if rows:
                yield arrow(rows)

        def arrow(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        pieces, held = [], 0
        for batch in batches:
            for doc, ids in encoded(batch, tokenizer_path, end_id):
                total = len(ids) // 4
                pieces += [(doc, s, total, ids[4 * s : 4 * (s + window)]) for s in range(0, total, window)]
                held += total
                if held >= block_ids:
                    yield from packed(pieces)
                    pieces, held = [], 0
        yield from packed(pieces)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(pack, WINDOWS)


def window_pieces(windows: DataFrame) -> DataFrame:
    """One row per segment of the windows, with its ids cut out of the matrix row."""
    at = F.posexplode(F.arrays_zip("doc_ids", "starts", "doc_tokens")).alias("piece_no", "piece")
    return windows.select("sequence_id", "ids", "cu_seqlens", at).select(
        F.col("piece.doc_ids").alias("doc_id"), F.col("piece.starts").alias("start"),
        (F.get("cu_seqlens", F.col("piece_no") + 1) - F.get("cu_seqlens", F.col("piece_no"))).cast("long").alias("length"),
        F.col("piece.doc_tokens").alias("doc_tokens"), "sequence_id",
        F.get("cu_seqlens", F.col("piece_no")).cast("long").alias("offset"), "ids",
    ).withColumn("ids", F.expr("substring(ids, CAST(4 * `offset` + 1 AS INT), CAST(4 * length AS INT))"))


def write_windows(windows: DataFrame, path: str) -> None:
    """The id matrix, segment lengths and positions as Parquet, one row per window."""
    windows.write.mode("overwrite").parquet(path)
