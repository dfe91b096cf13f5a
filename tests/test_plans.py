"""Shapes of physical plans that matter at scale."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from atlasloom.functions.urls import repo_name
from atlasloom.operators import chat, docs, filters, publish, scale
from workload.inputs import load, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_narrow_jobs_do_not_shuffle(spark):
    files = load(spark, SF, "files")
    narrow = docs.chunk_words(docs.drop_oversized(docs.derive_doc_columns(filters.filter_paths(files))))
    assert "Exchange" not in plan(narrow)


def test_columns_are_pruned(spark):
    counted = plan(docs.count_by_repo(docs.all_documents(load(spark, SF, "files"))))
    scan = counted[counted.index("ReadSchema"):]
    assert "text" not in scan.split("\n")[0]
    names = table(spark, SF, "pages").select(repo_name(F.col("url"), F.lit("web")).alias("n"))
    assert "ReadSchema: struct<url:string>" in plan(names)


def test_one_shuffle_per_grouping(spark):
    messages = load(spark, SF, "messages")
    assert plan(chat.pair_turns(messages)).count("Exchange") == 1
    assert plan(chat.conversation_state(messages)).count("Exchange") == 1
    # ranges of turns, then the few range texts of each conversation
    assert plan(chat.fold_history(chat.pair_turns(messages))).count("Exchange") == 3


def test_rankings_are_limited_before_the_shuffle(spark):
    newest = plan(scale.latest_wins(table(spark, SF, "events"), ["user_id"], "ts"))
    assert newest.count("WindowGroupLimit") == 2 and newest.count("Exchange") == 1


def test_no_plan_pairs_everything(spark):
    pages, generated = load(spark, SF, "wiki_pages"), load(spark, SF, "generated")
    for df in (
        publish.export_markdown(pages, load(spark, SF, "wikis"), "S"),
        publish.pack_context(pages, generated, load(spark, SF, "wikis")),
    ):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_chunks_are_not_shuffled_for_scoring(spark, monkeypatch):
    from atlasloom.operators import retrieval
    from workload.retrieval import centroids

    vectors = load(spark, SF, "vectors")
    scored = plan(retrieval.score_pairs(centroids(vectors), vectors))
    assert "MapInArrow" in scored and "Join" not in scored and "Exchange" not in scored  # every task holds the queries
    monkeypatch.setattr(retrieval, "_known_queries", lambda queries, max_bytes: None)
    scored = plan(retrieval.score_pairs(centroids(vectors), vectors))
    assert "BroadcastHashJoin" in scored and "Exchange hashpartitioning" not in scored
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in scored


def test_broadcast_only_within_measured_bounds(spark):
    small = spark.range(100).withColumn("text", F.repeat(F.lit("x"), 1000))
    hinted = lambda **k: "ResolvedHint" in scale.bounded_side(small, **k)._jdf.queryExecution().analyzed().toString()
    assert hinted() and not hinted(max_rows=99) and not hinted(max_bytes=50_000)
