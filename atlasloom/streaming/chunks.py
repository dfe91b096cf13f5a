"""Raw response chunks to lines (I1): bytes arrive cut anywhere, inside a line or inside a character.

Lines end at a line feed. What follows the last line feed of a response is unfinished and is not a line.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scale import RANGE, running_total

IDLE_MS = 600_000
RUN_BYTES = 4 * 1024 * 1024
LINE = "req_id string, seq bigint, line string"


def _latin(data: Column) -> Column:
    """Bytes as characters, one each, so that text functions are exact on them."""
    return F.decode(data, "ISO-8859-1")


def lines_from_chunks(chunks: DataFrame, span: int = RANGE) -> DataFrame:
    """I1 on a table of `req_id, seq, chunk` (binary): the finished lines of each request (`req_id, seq, line`).

    The number of line feeds before a chunk says which lines its pieces belong to; pieces of a line are then joined
    in the order of their chunks. Counts are summed over ranges of chunks, so a request with a third of all chunks is
    many tasks, and one line is all that is ever gathered. A chunk that came twice counts once; null chunks are empty.
    """
    once = chunks.dropDuplicates(["req_id", "seq"]).select(
        "req_id", "seq", F.coalesce(_latin(F.col("chunk")), F.lit("")).alias("bytes")
    )
    feeds = F.length("bytes") - F.length(F.replace("bytes", F.lit("\n")))
    placed = running_total(once.withColumn("feeds", feeds.cast("bigint")), ["req_id"], "seq", "feeds", "before", span)
    pieces = placed.select("req_id", "seq", "before", "feeds", F.posexplode(F.split("bytes", "\n")).alias("at", "piece")).select(
        "req_id", "seq", (F.col("before") + F.col("at")).alias("line_no"), "piece", (F.col("at") < F.col("feeds")).alias("ended")
    )
    lines = pieces.groupBy("req_id", "line_no").agg(
        F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY seq)").alias("bytes"), F.bool_or("ended").alias("ended")
    )
    text = F.make_valid_utf8(F.encode("bytes", "ISO-8859-1").cast("string"))
    return lines.filter("ended").select("req_id", F.col("line_no").alias("seq"), text.alias("line"))


def line_assembler(**options) -> StatefulProcessor:
    """The processor behind `assemble_lines`; its class is made here so that it travels with the query."""

    class LineAssembler(StatefulProcessor):
        """Carries the bytes of an unfinished line from chunk to chunk.

        State per request: the number of the next chunk and of the next line, the pieces of the unfinished line (a list
        that is only added to until the line ends), and chunks that came early. These are stored by runs of consecutive
        chunks, up to `RUN_BYTES` each: the bytes of a run are one entry, the places where runs start and end stand with the
        numbers. When a request falls silent with early chunks behind a gap, the line around the gap is given up and its
        number is left out; reading goes on behind it.
        """

        def __init__(self, first_seq: int = 0, idle_ms: int | None = IDLE_MS):
            self.first_seq, self.idle_ms = first_seq, idle_ms

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.progress = handle.getValueState("progress", "next_seq bigint, next_line bigint, broken boolean, starts array<bigint>, ends array<bigint>")
            self.carry = handle.getListState("carry", "piece binary")
            self.early = handle.getMapState("early", "seq bigint", "chunk binary")

        def _read(self, data: bytes, line_no: int, broken: bool) -> tuple[list[str], int, bool]:
            """Finished lines of what was carried and `data`; the number of the next line."""
            if b"\n" not in data:
                if data:
                    self.carry.appendValue((data,))
                return [], line_no, broken
            first, *rest = data.split(b"\n")
            whole = [b"".join([*(bytes(p[0]) for p in self.carry.get()), first]), *rest[:-1]]
            self.carry.clear()
            if rest[-1]:
                self.carry.appendValue((rest[-1],))
            lines = [line.decode("utf-8", "replace") for line in whole]
            return ([None, *lines[1:]] if broken else lines), line_no + len(lines), False

        def _frame(self, key, lines: list, first: int) -> Iterator[pd.DataFrame]:
            kept = [(key[0], first + i, line) for i, line in enumerate(lines) if line is not None]
            if kept:
                yield pd.DataFrame(kept, columns=["req_id", "seq", "line"])

        def _timer(self, timer_values) -> None:
            if self.idle_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)

        def _load(self) -> tuple[int, int, bool, dict[int, int]]:
            """Next chunk, next line, whether the line is broken, and the end of each early run by its start."""
            held = self.progress.get()
            if held is None:
                return self.first_seq, 0, False, {}
            next_seq, line_no, broken, starts, ends = held
            return next_seq, line_no, broken, dict(zip(starts, ends))

        def _store(self, next_seq: int, line_no: int, broken: bool, waiting: dict[int, int]) -> None:
            starts = sorted(waiting)
            self.progress.update((next_seq, line_no, broken, starts, [waiting[s] for s in starts]))

        def _new_runs(self, rows: Iterator[pd.DataFrame], next_seq: int, waiting: dict[int, int]) -> dict[int, tuple[int, bytes]]:
            """What was neither read nor stored before, by its first chunk: the chunk after the last, and the bytes."""
            packs = []
            for frame in rows:
                sizes = frame["sizes"].tolist() if "sizes" in frame else [None] * len(frame)
                packs += zip(frame["seq"].tolist(), frame["chunk"].tolist(), sizes)
            packs.sort(key=lambda pack: pack[0])
            starts, new, done = sorted(waiting), {}, next_seq
            for seq, data, sizes in packs:
                data = bytes(data or b"")
                ends = [0, len(data)] if sizes is None else np.append(0, np.cumsum(np.frombuffer(sizes, np.int32))).tolist()
                after, lo = seq + len(ends) - 1, max(seq, done)
                while lo < after:
                    i = bisect_right(starts, lo)
                    if i and waiting[starts[i - 1]] > lo:  # stored
                        lo = waiting[starts[i - 1]]
                        continue
                    hi = min(after, starts[i]) if i < len(starts) else after
                    new[lo] = (hi, data[ends[lo - seq] : ends[hi - seq]])
                    lo = hi
                done = max(done, after)
            return new

        @staticmethod
        def _joined(new: dict[int, tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
            """Neighbours put together up to about `RUN_BYTES`: first chunk, the one after the last, bytes."""
            held, size, first, last = [], 0, None, None
            for start, (end, data) in new.items():
                if held and (start != last or size >= RUN_BYTES):
                    yield first, last, b"".join(held)
                    held, size = [], 0
                first, last = (start if not held else first), end
                held.append(data)
                size += len(data)
            if held:
                yield first, last, b"".join(held)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            next_seq, line_no, broken, waiting = self._load()
            new = self._new_runs(rows, next_seq, waiting)
            run = []
            while next_seq in new or next_seq in waiting:
                if next_seq in new:
                    next_seq, data = new.pop(next_seq)
                    run.append(data)
                else:
                    run.append(bytes(self.early.getValue((next_seq,))[0]))
                    self.early.removeKey((next_seq,))
                    next_seq = waiting.pop(next_seq)
            for start, end, data in self._joined(new):
                self.early.updateValue((start,), (data,))
                waiting[start] = end
            lines, after, broken = self._read(b"".join(run), line_no, broken)
            yield from self._frame(key, lines, line_no)
            self._store(next_seq, after, broken, waiting)
            self._timer(timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            next_seq, line_no, broken, waiting = self._load()
            if not waiting:  # silent and nothing to go on with
                self.progress.clear()
                self.carry.clear()
                return
            for start in sorted(waiting):
                if start != next_seq:  # bytes are lost here: so is the line around them
                    self.carry.clear()
                    broken = True
                lines, after, broken = self._read(bytes(self.early.getValue((start,))[0]), line_no, broken)
                yield from self._frame(key, lines, line_no)
                next_seq, line_no = waiting[start], after
            self.early.clear()
            self._store(next_seq, line_no, broken, {})
            self._timer(timerValues)

        def close(self) -> None:
            pass

    return LineAssembler(**options)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive chunks of a request as one row each: the first number, the bytes, and the sizes as 32-bit numbers."""
    for batch in batches:
        codes = batch.column("req_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        seq = batch.column("seq").to_numpy(zero_copy_only=False)
        order = np.lexsort((seq, codes))
        codes, seq = codes[order], seq[order]
        first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (seq[1:] != seq[:-1] + 1))[: len(seq)])
        data = batch.column("chunk").fill_null(b"").cast(pa.binary()).take(pa.array(order))
        ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(seq) + 1] if len(seq) else np.zeros(1, np.int32)
        sizes = np.diff(ends).astype(np.int32)

        def cut(at: np.ndarray, values) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.astype(np.int32).tobytes()), values])

        bounds = np.append(first, len(seq))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("req_id").take(pa.array(order[first])), pa.array(seq[first], pa.int64()),
                cut(ends[bounds], data.buffers()[2] or pa.py_buffer(b"")), cut(bounds * 4, pa.py_buffer(sizes.tobytes())),
            ],
            ["req_id", "seq", "chunk", "sizes"],
        )


def assemble_lines(chunks: DataFrame, idle_ms: int | None = IDLE_MS, **options) -> DataFrame:
    """I1 on a stream of `req_id, seq, chunk`: finished lines (`req_id, seq, line`) for `parse_sse` and `accumulate_stream`.

    Runs of chunks that a task reads together are one row each before they are shuffled to their state.
    Needs the RocksDB state store provider. Without `idle_ms` there are no timers, as a one-off run over the available files needs.
    """
    packs = chunks.select("req_id", "seq", "chunk").mapInArrow(_packed, f"req_id {chunks.schema['req_id'].dataType.simpleString()}, seq bigint, chunk binary, sizes binary")
    return packs.groupBy("req_id").transformWithStateInPandas(
        statefulProcessor=line_assembler(idle_ms=idle_ms, **options), outputStructType=LINE, outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
