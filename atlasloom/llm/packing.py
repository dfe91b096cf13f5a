"""Operator 10: sum-of-squares online packing of token ids into windows.

Each task packs the documents it reads, in their order. A level array counts the open windows of every fill level.
A document is put into the level that makes the sum of the squared counts smallest; a full window is emitted.
At the end of a task (or when `MAX_OPEN` windows are open) the open windows are closed by cutting pieces: the fullest
windows are filled from the emptiest. The last one is cut into windows whose lengths are powers of two, so nothing is padded.

Null text: empty (the end id only). Empty table: no rows. Null or repeated ids: every row is packed as a document of its
own. Very long documents: cut into full windows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import opened, prepare, text_of
from .tokens import encoded

WINDOW = 4096
END_ID = 2
MAX_OPEN = 4096

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, `offset` long, ids binary"


class SumOfSquares:
    """Open windows by fill level. A piece is (doc_id, start, doc_tokens, id bytes)."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # the level array
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)

    def level_for(self, n: int) -> int:
        """The fill level (0: a new window) where `n` ids make the sum of squares smallest; the fullest of equals."""
        count, top = self.count, self.size - n
        if top == 0:
            return 0
        after = 2 * count[n + 1 : self.size + 1] + 1
        after[-1] = 0  # a full window is no longer counted
        change = np.where(count[1 : top + 1] > 0, after - 2 * count[1 : top + 1] + 1, np.iinfo(np.int64).max)
        best = top - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * count[n] + 1 else 0

    def add(self, piece: tuple) -> list[tuple] | None:
        """Put one piece of at most a window; a window that is full now."""
        n = len(piece[3]) // 4
        level = self.level_for(n)
        window = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        window.append(piece)
        if level + n == self.size:
            return window
        self.open[level + n].append(window)
        self.count[level + n] += 1
        return None

    def close(self):
        """All open windows: the fullest filled with cuts of the emptiest, the last in powers of two."""
        windows = [w for level in sorted(self.open) for w in self.open[level]]
        self.open.clear()
        self.count[:] = 0
        while len(windows) > 1:
            window = windows.pop()
            gap = self.size - sum(len(p[3]) for p in window) // 4
            while gap and windows:
                piece = windows[0].pop()
                n = min(gap, len(piece[3]) // 4)
                kept, moved = cut(piece, len(piece[3]) // 4 - n)
                if kept:
                    windows[0].append(kept)
                if not windows[0]:
                    windows.pop(0)
                window.append(moved)
                gap -= n
            if gap:
                windows.append(window)
                break
            yield window
        for window in windows:
            left = sum(len(p[3]) for p in window) // 4
            while left:
                part, need = [], min(1 << (left.bit_length() - 1), self.size)
                left -= need
                while need:
                    piece = window.pop()
                    kept, moved = cut(piece, max(0, len(piece[3]) // 4 - need))
                    if kept:
                        window.append(kept)
                    part.append(moved)
                    need -= len(moved[3]) // 4
                yield part


def cut(piece: tuple, at: int) -> tuple[tuple | None, tuple]:
    """The first `at` ids of a piece (None: no ids) and the rest."""
    doc, start, total, ids = piece
    if not at:
        return None, piece
    return (doc, start, total, ids[: 4 * at]), (doc, start + at, total, ids[4 * at :])


def pack_online(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int | None = END_ID, max_open: int = MAX_OPEN
) -> DataFrame:
    """Pack whole documents (`doc_id`, `text`) -> one row per piece, with its ids as little-endian 32-bit bytes."""
    prepare(docs.sparkSession)

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([
            ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
        ])
        opened("packing", lambda: True)  # what earlier jobs have left goes before the memo of words grows
        levels, sequence, rows, held = SumOfSquares(window), TaskContext.get().partitionId() << 40, [], 0

        def lay(full):
            nonlocal sequence, held
            offset = 0
            for doc, start, total, ids in full:
                n = len(ids) // 4
                rows.append((doc, start, n, total, sequence, offset, ids))
                offset += n
            held += 4 * offset
            sequence += 1

        def flush():
            nonlocal rows, held
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, held = [], 0
            return out

        for batch in batches:
            for doc, ids in encoded(batch, tokenizer_path, end_id):
                total = len(ids) // 4
                for start in range(0, total, window):
                    full = levels.add((doc, start, total, ids[4 * start : 4 * (start + window)]))
                    if full:
                        lay(full)
                if levels.count.sum() > max_open:
                    for full in levels.close():
                        lay(full)
                if held > 8_000_000:
                    yield flush()
        for full in levels.close():
            lay(full)
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(pack, PIECES)
