"""Raw chunks to lines: cut at every byte, out of order, with lost and repeated chunks."""

import random

import pytest

from atlasloom.streaming import chunks

TEXT = ": ping\r\ndata: {\"choices\":[{\"text\":\"é€😀\"}]}\n\n  x\n\ndata: [DONE]\nunfinished é"
LINES = TEXT.split("\n")[:-1]


def cuts():
    data = TEXT.encode()
    rows = []
    for k in range(len(data) + 1):  # one cut at every byte
        rows += [(f"cut{k:03}", 0, data[:k]), (f"cut{k:03}", 1, data[k:])]
    rows += [("bytes", i, data[i : i + 1]) for i in range(len(data))]
    rows += [("whole", 0, data), ("nothing", 0, b""), ("none", 0, None), ("open", 0, b"abc"), ("open", 1, b"def")]
    return rows


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.req_id, {})[r.seq] = r.line
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}, out


@pytest.mark.parametrize("span", [1, 3, 10_000])
def test_table_cut_at_every_byte(spark, span):
    rows = cuts()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows + rows[:40], "req_id string, seq bigint, chunk binary")
    got, places = found(chunks.lines_from_chunks(df, span=span))
    want = {r[0] for r in rows} - {"nothing", "none", "open"}
    assert set(got) == want and all(v == LINES for v in got.values())
    assert all(sorted(v) == list(range(len(LINES))) for v in places.values())


def test_table_broken_bytes_and_empty(spark):
    df = spark.createDataFrame([("a", 0, b"\xff\xe2\x82"), ("a", 1, b"\xac\n")], "req_id string, seq bigint, chunk binary")
    assert found(chunks.lines_from_chunks(df))[0] == {"a": ["�€"]}
    assert chunks.lines_from_chunks(df.limit(0)).collect() == []


def run_stream(spark, tmp_path, batches, **options):
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "req_id string, seq bigint, chunk binary").coalesce(1).write.mode("append").parquet(str(folder))
    files = sorted(folder.glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == len(batches)
    stream = spark.readStream.schema("req_id string, seq bigint, chunk binary").option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = chunks.assemble_lines(stream, idle_ms=None, **options).writeStream.format("memory").queryName("assembled").option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return found(spark.table("assembled"))[0]


def test_stream_cut_at_every_byte_out_of_order(spark, tmp_path):
    rows = [r for r in cuts() if r[0] in ("bytes", "whole", "open", "none") or r[0].startswith("cut") and int(r[0][3:]) % 3 == 0]
    random.Random(2).shuffle(rows)
    third = len(rows) // 3
    got = run_stream(spark, tmp_path, [rows[:third], rows[third : 2 * third], rows[2 * third :] + rows[:5]])
    assert set(got) == {r[0] for r in rows} - {"none", "open"} and all(v == LINES for v in got.values())


class Store:
    """State of one key, in memory."""

    def __init__(self):
        self.value, self.items, self.map, self.timers = None, [], {}, []

    def getValueState(self, name, schema):
        store = self

        class Value:
            exists = lambda self: store.value is not None
            get = lambda self: store.value

            def update(self, v):
                store.value = v

            def clear(self):
                store.value = None

        return Value()

    def getListState(self, name, schema):
        store = self

        class Items:
            get = lambda self: iter(list(store.items))
            appendValue = lambda self, v: store.items.append(v)
            clear = lambda self: store.items.clear()

        return Items()

    def getMapState(self, name, key, value):
        store = self

        class Map:
            containsKey = lambda self, k: k in store.map
            getValue = lambda self, k: store.map[k]
            removeKey = lambda self, k: store.map.pop(k)
            iterator = lambda self: iter(list(store.map.items()))
            clear = lambda self: store.map.clear()

            def updateValue(self, k, v):
                store.map[k] = v

        return Map()

    listTimers = lambda self: iter(list(self.timers))
    deleteTimer = lambda self, t: self.timers.remove(t)
    registerTimer = lambda self, t: self.timers.append(t)
    getCurrentProcessingTimeInMs = lambda self: 1_000


def test_silent_request_gives_up_the_line_around_a_gap():
    import pandas as pd

    store = Store()
    machine = chunks.line_assembler(idle_ms=50)
    machine.init(store)
    feed = lambda rows: [tuple(r) for f in machine.handleInputRows(("q",), iter([pd.DataFrame(rows, columns=["seq", "chunk"])]), store) for r in f.itertuples(index=False)]
    assert feed([(0, b"one\ntw"), (2, b"lost\nthree\nfo"), (3, b"ur\nfi")]) == [("q", 0, "one")]
    assert store.timers == [1_050]
    late = [tuple(r) for f in machine.handleExpiredTimer(("q",), store, None) for r in f.itertuples(index=False)]
    assert late == [("q", 2, "three"), ("q", 3, "four")]
    assert feed([(1, b"too late"), (4, b"ve\n")]) == [("q", 4, "five")]
    assert list(machine.handleExpiredTimer(("q",), store, None)) == [] and store.value is None and not store.items


def test_early_chunks_are_stored_by_runs():
    """A thousand chunks behind a gap are a few entries of state, also when some come twice in another batch."""
    import pandas as pd

    store = Store()
    machine = chunks.line_assembler(idle_ms=None)
    machine.init(store)
    feed = lambda rows: [tuple(r) for f in machine.handleInputRows(("q",), iter([pd.DataFrame(rows, columns=["seq", "chunk"])]), store) for r in f.itertuples(index=False)]
    rows = [(i, f"{i}\n".encode()) for i in range(1_000)]
    early = rows[500:700] + rows[300:400]
    random.Random(3).shuffle(early)
    assert feed(early) == [] and len(store.map) == 2
    assert feed(rows[350:550] + rows[650:]) == [] and len(store.map) == 4
    assert feed(rows[:320]) == [("q", i, str(i)) for i in range(1_000)] and not store.map


def test_long_runs_are_stored_in_parts(monkeypatch):
    monkeypatch.setattr(chunks, "RUN_BYTES", 10)
    new = {7: (9, b"abcd"), 9: (10, b"efghijk"), 10: (12, b"l"), 13: (14, b"m")}
    assert list(chunks.line_assembler()._joined(new)) == [(7, 10, b"abcdefghijk"), (10, 12, b"l"), (13, 14, b"m")]


def test_chunks_are_packed_before_their_state():
    import numpy as np
    import pyarrow as pa

    rows = [("a", 2, b"cc"), (None, 0, b"n"), ("b", 5, b""), ("a", 1, None), ("a", 0, b"a"), ("b", 7, b"x"), ("a", 1, b"")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["req_id", "seq", "chunk"])
    (found,) = chunks._packed(iter([batch]))
    got = {(r["req_id"], r["seq"], r["chunk"], tuple(np.frombuffer(r["sizes"], np.int32).tolist())) for r in found.to_pylist()}
    assert got == {("a", 0, b"a", (1, 0)), ("a", 1, b"cc", (0, 2)), (None, 0, b"n", (1,)), ("b", 5, b"", (0,)), ("b", 7, b"x", (1,))}
    (empty,) = chunks._packed(iter([batch.slice(0, 0)]))
    assert empty.num_rows == 0
