"""Embedding and retrieval against brute force, with one repository holding a third of the chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasloom.operators import bloom, context, embed, inverted, retrieval

DIM = 16


def corpus(n=1500, copies=30):
    rng = np.random.default_rng(11)
    vectors = rng.standard_normal((n, DIM)).astype(np.float32)
    vectors[5 : 5 + 3 * copies : 3] = vectors[3]  # equal vectors: ties
    repos = ["hot" if i % 3 == 0 else f"r{i % 7}" for i in range(n)]
    rows = []
    for i in range(n):
        v = vectors[i].tolist()
        if i % 11 == 0:
            v = v[:8]
        if i % 50 == 1:
            v = [] if i % 100 == 1 else None
        rows.append((repos[i], i, f"c{i:05d}", f"f{i % 40}.py" if i % 9 else None, f"text {i}", v))
    return rows


SCHEMA = "repo_id string, doc_ord bigint, chunk_id string, file_path string, text string, vector array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(6)


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(2)
    rows = [(r, f"q{r}{i}", rng.standard_normal(DIM).astype(np.float32).tolist()) for r in ("hot", "r1", "r2") for i in range(9)]
    rows.append(("hot", "qdup", corpus()[3][5]))
    rows.append(("hot", "qshort", [1.0] * 8))
    rows.append(("hot", "qzero", [0.0] * DIM))
    return spark.createDataFrame(rows, "repo_id string, query_id string, vector array<float>")


def brute(chunks, queries, k):
    by, out = {}, set()
    for r in chunks.collect():
        if r.vector and len(r.vector) == DIM:
            by.setdefault(r.repo_id, []).append((r.chunk_id, np.array(r.vector, dtype=np.float64)))
    for q in queries.collect():
        if len(q.vector) != DIM:
            continue
        v = np.array(q.vector, dtype=np.float64)
        n = np.linalg.norm(v) or 1.0
        scored = [(round(float(v @ c / n / np.linalg.norm(c)), 6) + 0.0, i) for i, c in by[q.repo_id]]
        scored.sort(key=lambda x: (-x[0], x[1]))
        out |= {(q.repo_id, q.query_id, i, rank + 1) for rank, (s, i) in enumerate(scored[:k])}
    return out


def as_set(hits):
    return {(r.repo_id, r.query_id, r.chunk_id, r["rank"]) for r in hits.collect()}


def test_modal_dimension(spark, chunks):
    kept = retrieval.filter_modal_dim(chunks)
    assert kept.count() == sum(1 for r in corpus() if r[5] and len(r[5]) == DIM)
    tie = spark.createDataFrame(
        [("r", 0, [1.0]), ("r", 1, [1.0, 2.0]), ("r", 2, [1.0, 2.0]), ("r", 3, [3.0]), ("r", 4, []), ("e", 5, None)],
        "repo_id string, doc_ord bigint, vector array<float>",
    )
    assert {r.doc_ord for r in retrieval.filter_modal_dim(tie).collect()} == {0, 3}
    first = embed.filter_first_dim(tie)
    assert {r.doc_ord for r in first.collect()} == {0, 3}


def test_retrieval_equals_brute_force(chunks, queries):
    for k in (1, 20, 700):
        assert as_set(retrieval.retrieve(queries, chunks, k, columns=())) == brute(chunks, queries, k)


def test_retrieval_without_broadcast_and_with_small_blocks(spark, chunks, queries, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    monkeypatch.setattr(retrieval, "HELD_ROWS", 40)
    monkeypatch.setattr(retrieval, "_known_queries", lambda queries, max_bytes: None)
    monkeypatch.setattr(retrieval, "bounded_side", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert as_set(retrieval.retrieve(queries, chunks, 20, columns=())) == brute(chunks, queries, 20)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranking_keeps_only_k_rows_per_task_before_the_shuffle(chunks, queries):
    scored = retrieval.score_pairs(queries, chunks, 20)
    plan = retrieval.top_k(scored, 20)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert scored.rdd.getNumPartitions() >= 1


def test_inverted_file_equals_brute_force(spark, chunks, queries, tmp_path, monkeypatch):
    for k in (1, 20, 700):
        assert as_set(inverted.retrieve_ann(queries, chunks, k)) == brute(chunks, queries, k)
    index = inverted.build_lists(chunks, portion_bytes=64)  # repositories in portions
    index.save(str(tmp_path / "lists"))
    index = inverted.InvertedFile.load(spark, str(tmp_path / "lists"))
    assert as_set(inverted.retrieve_lists(queries, index, 20, portion_bytes=64)) == brute(chunks, queries, 20)
    monkeypatch.setattr(retrieval, "_known_queries", lambda queries, max_bytes: None)
    assert as_set(inverted.retrieve_lists(queries, index, 20)) == brute(chunks, queries, 20)


def test_inverted_file_leaves_lists_out_and_none_that_matter(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 6000)] + 0.05 * rng.normal(size=(6000, 16))
    rows = [("big" if i % 3 else "small", i, f"c{i}", v) for i, v in enumerate(x.astype(np.float32).tolist())]
    rows += [("big", 9000, "zero", [0.0] * 16), ("big", 9001, "short", [1.0]), ("big", 9002, "none", None), ("big", 9003, "empty", [])]
    chunks = spark.createDataFrame(rows, "repo_id string, doc_ord long, chunk_id string, vector array<float>")
    asked = [(r, f"q{i}", v) for i, v in enumerate((centres + 0.02 * rng.normal(size=centres.shape)).astype(np.float32).tolist()) for r in ("big", "small", "unknown")]
    asked.append(("big", "zero", [0.0] * 16))
    queries = spark.createDataFrame(asked, "repo_id string, query_id string, vector array<float>")
    index = inverted.build_lists(chunks)
    assert {r.id for r in index.members.collect()} == {r[2] for r in rows[:-3]}
    assert as_set(inverted.retrieve_lists(queries, index)) == as_set(retrieval.retrieve(queries, chunks, columns=()))
    visited = inverted._visits(queries.withColumnRenamed("query_id", "id"), list(index.directory.toLocalIterator()), 20, 2, 0.0)
    reach = visited.filter("NOT first AND id <> 'zero'")
    assert reach.filter("bound >= 0.98").count() < 0.5 * reach.count()  # 0.98 is about the score of the 20th best


def test_inverted_file_of_nothing(spark):
    chunks = spark.createDataFrame([], "repo_id string, doc_ord long, chunk_id string, vector array<float>")
    queries = spark.createDataFrame([("a", "q", [1.0])], "repo_id string, query_id string, vector array<float>")
    assert inverted.retrieve_ann(queries, chunks).collect() == []


def test_lookup_past_the_broadcast_bound_filters_the_scan(spark, tmp_path):
    spark.range(20_000).selectExpr(
        "concat('r', id % 3) AS repo_id", "concat('c', id) AS chunk_id", "concat('f', id) AS file_path", "repeat('text ', 20) AS text"
    ).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    hits = spark.range(0, 20_000, 100).selectExpr("concat('r', id % 3) AS repo_id", "'q' AS query_id", "concat('c', id) AS chunk_id", "1.0D AS score", "1 AS rank")
    hits = hits.unionByName(hits.limit(1).selectExpr("repo_id", "'p' AS query_id", "chunk_id", "score", "rank"))
    small = retrieval.lookup_hits(hits, chunks)
    large = retrieval.lookup_hits(hits, chunks, max_rows=0)
    assert sorted(map(repr, large.collect())) == sorted(map(repr, small.select(large.columns).collect())) and large.count() == 201
    known = bloom.key_filter(hits.select("repo_id", "chunk_id"), ["repo_id", "chunk_id"])
    passed = chunks.filter(known("repo_id", "chunk_id")).count()
    assert 200 <= passed <= 400  # of 20,000: what is shuffled with its text
    tight = bloom.key_filter(hits, ["repo_id", "chunk_id"], max_bytes=8)
    assert chunks.filter(tight("repo_id", "chunk_id")).join(hits, ["repo_id", "chunk_id"]).count() == 201
    none = bloom.key_filter(hits.limit(0), ["repo_id", "chunk_id"])
    assert chunks.filter(none("repo_id", "chunk_id")).isEmpty()


def test_context_text(chunks, queries):
    hits = retrieval.retrieve(queries, chunks, 20)
    want = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        want.setdefault(r.query_id, {}).setdefault(r.file_path or "unknown", []).append(r.text)
    want = {
        q: "\n\n" + "-" * 10 + "\n\n".join(f"## File Path: {f}\n\n" + "\n\n".join(t) for f, t in files.items())
        for q, files in want.items()
    }
    assert {r.query_id: r.context for r in context.group_context(hits).collect()} == want


def texts(spark):
    rows = [("a", i, f"word{i % 5} common {i}", i % 4) for i in range(40)] + [("a", 40, "  ", 0), ("b", 41, None, 0)]
    return spark.createDataFrame(rows, "repo_id string, doc_ord bigint, text string, batch_no int").repartition(3)


def test_hashing_vectors(spark):
    got = {r.doc_ord: r for r in embed.embed_chunks(texts(spark), dim=8, batch=7).collect()}
    one = embed.hashing_embedder(8)
    for i in (0, 13, 39):
        want = one([got[i].text])[0]
        assert np.allclose(got[i].vector, want, atol=1e-6) and got[i].embed_error is None
        assert abs(np.linalg.norm(want) - 1) < 1e-9
    blank = got[40]
    assert blank.vector in ([0.0] * 8, []) and len(got) == 42


def test_failing_batches_are_reported(spark):
    def broken():
        def run(batch):
            if any("17" in t for t in batch):
                raise RuntimeError("refused")
            if any("23" in t for t in batch):
                return [[1.0, 2.0]]
            return [[1.0, 2.0] for _ in batch]

        return run

    df = texts(spark).coalesce(1).orderBy("doc_ord")
    got = {r.doc_ord: r for r in embed.embed_chunks(df, broken, batch=5).collect()}
    assert [got[i].vector for i in range(15, 20)] == [[]] * 5 and got[15].embed_error == "RuntimeError: refused"
    assert got[20].vector == [] and "1 vectors for 5 texts" in got[20].embed_error
    assert got[0].vector == [1.0, 2.0]
    stats = embed.batch_stats(embed.embed_chunks(df, broken, batch=5)).collect()
    assert {(r.repo_id, r.valid, r.empty, r.failed_rows, r.total) for r in stats} == {
        ("a", 30, 11, 11, 41), ("b", 0, 1, 1, 1)
    }


def test_cache_embeds_each_text_once(spark):
    embed.register_embedder("counted", lambda: lambda batch: [[float(len(t))] for t in batch])
    df = spark.createDataFrame([("r", i, f"t{i % 3}") for i in range(30)], "repo_id string, doc_ord int, text string")
    empty = spark.createDataFrame([], "model string, text_hash string, vector array<float>")
    first, cache = embed.embed_with_cache(df, empty, "counted")
    assert first.count() == 30 and cache.count() == 3
    again, cache2 = embed.embed_with_cache(df.unionByName(spark.createDataFrame([("r", 99, "new!")], df.schema)), cache, "counted")
    assert {(r.doc_ord, r.vector[0]) for r in again.collect()} >= {(99, 4.0), (0, 2.0)}
    assert cache2.count() == 4


def test_stats(spark, chunks):
    got = {r.repo_id: (r.total, r.non_empty, r.empty, r.sample_dims) for r in embed.embedding_stats(chunks).collect()}
    want = {}
    for r in corpus():
        want.setdefault(r[0], []).append(len(r[5] or []))
    assert got == {
        k: (len(v), sum(x > 0 for x in v), sum(x == 0 for x in v), sorted({x for x in v if x})[:3]) for k, v in want.items()
    }


def test_payloads(spark):
    payloads = [
        '{"embedding": [1, 2.5]}', '{"embeddings": [[1.0], [], [2.0]]}', '{"embeddings": [{"embedding": [3]}, {"embedding": []}, {"x": 1}]}',
        '{"embeddings": {"float": [[4.0, 5.0]]}}', '{"embedding": []}', '{"other": 1}', "broken",
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, payload string")
    got = sorted((r.id, r["index"], r.vector) for r in embed.normalise_payload(df).collect())
    assert got == [(0, 0, [1.0, 2.5]), (1, 0, [1.0]), (1, 1, [2.0]), (2, 0, [3.0]), (3, 0, [4.0, 5.0])]


def test_words_of_a_batch_are_held_in_parts():
    """A batch of long texts: the words held at a time do not grow with it, and vectors are those of the texts alone."""
    import tracemalloc

    import numpy as np

    from atlasloom.operators.embed import hashing_embedder

    texts = [" ".join(f"w{(i * 7 + j) % 5_000}" for j in range(6_000)) for i in range(100)] + ["", " ", "x"]
    embed = hashing_embedder(16)
    tracemalloc.start()
    found = embed(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000
    assert np.array_equal(found, np.concatenate([embed([t]) for t in texts])) and embed([]).shape == (0, 16)
