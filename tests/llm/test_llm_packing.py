"""Operators 1, 2 and 10: sharding and packing."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasloom.llm import bfd, packing, queries, sharding
from atlasloom.llm.tokens import WordTokenizer

TOKENS = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
DOCS = "doc_id long, text string, key string, ids string, offset int, shard string"
R = random.Random(5)
WORDS = ["the", "Alpha,", "beta.", "it's", "x1y2", "é😀", "naïve", "\n", "don't.", "A.B.", "!!", "Straße", " q"]


def rows(n=60):
    made = [(i, " ".join(R.choice(WORDS) for _ in range(R.randint(0, 80))), "k", "i", 1, "s") for i in range(n)]
    return made + [
        (100, None, "k", "i", 1, "s"), (101, "", None, None, None, None), (None, "no id", "k", "i", 1, "s"), (7, made[7][1], "k", "i", 1, "s"),
        (102, "long words " * 700, "k", "i", 1, "s"), (103, "<|endoftext|> a\x01b <|startoftext|>", "k", "i", 1, "s"),
    ]


def ids_of(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENS)
    return [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_memo_gives_the_ids_of_whole_texts():
    texts = [t for _, t, *_ in rows(300) if t] + ["a\x1cb", "KK İ ΑΣ. σ", "é. É,", "x" * 5000, "\x01"]
    encoder = WordTokenizer(TOKENS)
    for _ in range(2):  # once without and once with the memo
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == ids_of(texts)


def check_pieces(docs, pieces, window):
    """Each id in one piece, sequences without gaps and of at most a window."""
    want = sorted((str(d), tuple([*i, 2])) for (d, *_), i in zip(docs, ids_of([t for _, t, *_ in docs])))
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(str(p.doc_id), []).append(p)
        assert p.length == len(p.ids) // 4 and p.length > 0
    whole = []
    for doc, own in by_doc.items():
        own.sort(key=lambda p: (p.start, p.sequence_id, p.offset))
        if doc != "7":
            assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
            whole.append((doc, tuple(np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist())))
    assert sorted(whole) == [w for w in want if w[0] != "7"]
    assert sum(p.length for p in pieces) == sum(len(w[1]) for w in want)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
    return [sum(n for _, n in own) for own in sequences.values()]


def test_online_packing_pads_nothing(spark):
    docs = rows()
    pieces = packing.pack_online(spark.createDataFrame(docs, DOCS).repartition(3), TOKENS, window=64).collect()
    assert all(n == 64 or n & (n - 1) == 0 for n in check_pieces(docs, pieces, 64))


def test_many_open_windows_are_closed(spark):
    docs = rows()
    pieces = packing.pack_online(spark.createDataFrame(docs, DOCS).coalesce(1), TOKENS, window=64, max_open=3).collect()
    check_pieces(docs, pieces, 64)


def test_sum_of_squares_takes_the_best_level():
    """Against trying every level and adding the squares up."""
    levels = packing.SumOfSquares(12)
    for step in range(400):
        n = R.randint(1, 12)

        def squares(level):
            count = levels.count.copy()
            if level:
                count[level] -= 1
            if level + n < 12:
                count[level + n] += 1
            return int((count[1:12] ** 2).sum())

        options = [h for h in range(12 - n + 1) if h == 0 or levels.count[h]]
        chosen = 0 if n == 12 else levels.level_for(n)
        assert squares(chosen) == min(map(squares, options))
        levels.add((step, 0, n, b"\0\0\0\0" * n))


def test_best_fit_decreasing(spark):
    docs = rows()
    windows = bfd.pack_best_fit(spark.createDataFrame(docs, DOCS).coalesce(1), TOKENS, window=64)
    for w in windows.collect():
        positions = np.frombuffer(w.positions, "<i4")
        assert len(w.ids) == 256 and len(positions) == 64
        assert all(positions[a:b].tolist() == list(range(b - a)) for a, b in zip(w.cu_seqlens, w.cu_seqlens[1:]))
    check_pieces(docs, bfd.window_pieces(windows).collect(), 64)


def test_segment_tree_against_a_scan():
    lengths = [R.randint(1, 50) for _ in range(500)]
    room, got = [], bfd.best_fit_decreasing(lengths, 50)
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(50 - n)
    assert sorted(room) == sorted(50 - sum(lengths[i] for i in w) for w in got)
    assert sorted(i for w in got for i in w) == list(range(500))


def test_shards(spark):
    docs = rows()
    df = spark.createDataFrame(docs, DOCS)
    got = sharding.shuffle_shards(df, shards=3, bucket_bytes=1_000).collect()
    assert sorted(map(str, (tuple(r.row) for r in got))) == sorted(map(str, docs))
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.bucket for r in got}) > 1
    assert all(r.grown_shard in (r.shard, 3) for r in got)
    grown = sharding.shuffle_shards(df, shards=4, bucket_bytes=1_000).collect()
    assert sorted((str(r.row), r.grown_shard) for r in got) == sorted((str(r.row), r.shard) for r in grown)
    again = sharding.shuffle_shards(df.repartition(5), shards=3, bucket_bytes=1_000).collect()
    assert sorted((str(r.row), r.shard, r.slot) for r in got) == sorted((str(r.row), r.shard, r.slot) for r in again)


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = spark.createDataFrame(rows(), DOCS)
    sharding.write_shards(sharding.shuffle_shards(df, shards=3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack_online(empty, TOKENS).count() == 0
    assert bfd.pack_best_fit(empty, TOKENS).count() == 0
    assert sharding.shuffle_shards(empty).count() == 0


def test_digest_columns(spark):
    df = spark.createDataFrame(rows(), DOCS)
    got = queries.packed_digest(df).filter("doc_id = 0").orderBy("start").collect()
    ids = np.array([*ids_of([df.filter("doc_id = 0").first().text])[0], 2], "<u4")
    assert got[0].ids_crc32 == zlib.crc32(ids[: got[0].length].tobytes())
    assert df.select(F.count("*")).first()[0] == 66


def test_stops_and_marks_of_texts():
    """The patterns find what their plain forms find: stops behind a letter that end a word, and texts that are encoded whole."""
    import random
    import re

    from atlasloom.llm import common, tokens

    assert tokens._STOPS.pattern.startswith("[.,]") and tokens._WHOLE.pattern.startswith("[")  # searched by their first characters
    rng = random.Random(5)
    for _ in range(3_000):
        text = "".join(rng.choice("ab1.,.. \n<|\xa0") for _ in range(rng.randrange(30)))
        assert tokens._STOPS.sub(r" \g<0>", text) == re.sub(r"(?<=[a-z])([.,]+)(?=\s|$)", r" \1", text)
        assert bool(tokens.MARK in text or tokens._WHOLE.search(text)) == ("<|" in text or "\xa0" in text)
    common._MODELS["earlier"] = object()
    common.opened("packing", lambda: True)
    assert "earlier" not in common._MODELS
