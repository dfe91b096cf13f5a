"""Registered queries and the pipeline on the smallest driver tables."""

from pathlib import Path

import pytest

import corpus_pipeline
from atlasloom.llm import decontaminate, pii, simhash, toxicity
from atlasloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op11_multiprobe", "op12_bloom_neighbours"}))
def test_query_runs_over_all_documents(spark, name):
    rows = QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in rows.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    import duckdb

    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.execute(ORACLES[name])
        names = [c[0] for c in want.description]
        rows = want.fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, SF).select(*names).collect()]
    assert sorted(got) == sorted(rows)


def test_search_query_answers_every_twentieth_vector(spark):
    rows = QUERIES["op11_multiprobe"](spark, SF).collect()
    ids = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    assert {r.query_id for r in rows} == {i for i in ids if i % 20 == 0} and len(rows) == 20 * len({r.query_id for r in rows})


def ids_of_components(rows):
    """Brute force over all pairs: the smallest id of each component of texts within two bits or of Jaccard similarity 0.8."""
    words = [(r.text or "").encode().lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    prints = [simhash.simhash(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 2 or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r.doc_id, least.get(find(i), r.doc_id))
    return set(least.values())


def test_pipeline_stages(spark):
    """Each stage on what the one before kept; each decision against the operator's own answer on that input."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["toxicity"](spark, docs, SF).checkpoint()
    assert ids(kept) == ids(toxicity.toxicity(docs, labels).filter("predicted = 0"))
    single = stage["near_duplicates"](spark, kept, SF).checkpoint()
    assert ids(single) == ids_of_components(kept.collect())
    clean = stage["decontamination"](spark, single, SF).checkpoint()
    assert ids(clean) == ids(decontaminate.digest(decontaminate.benchmark_hits(single, bench)).filter("NOT contaminated"))
    private = stage["personal_data"](spark, clean, SF).checkpoint()
    assert ids(private) == ids(clean) and private.columns == docs.columns
    left = pii.digest(pii.found_spans(private)).selectExpr("sum(n_email + n_ip + n_card + n_phone)").first()[0]
    assert left == 0 and private.filter("n_chars <> length(text)").isEmpty()
    assert ids(stage["packing"](spark, private, SF)) == ids(private)


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.length > 0 for r in rows)
