"""Queries that once made a row for each pair of a query and a document, and must not again."""

import os

import pytest
from oracle import connection, rows
from pyspark.sql import functions as F

from ranklake.operators import graph, lexical
from ranklake.plans.core import CORE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.mark.parametrize("name", ["candidate_union", "hybrid_top", "ablation_stages", "appearance_top", "side_by_side", "vector_word_top", "weight_sensitivity"])
def test_no_pairs_of_words(spark, monkeypatch, name):
    """Every word a query shares with a document must not become a row."""

    def pairs(*_):
        raise AssertionError("pairs of queries and documents")

    monkeypatch.setattr(lexical, "bm25", pairs)
    assert CORE.plans[name](spark, SF).columns


@pytest.mark.parametrize("most", [lexical.MOST_WORDS, 1])
def test_only_words_asked_for_become_rows(spark, monkeypatch, most):
    """Words are dropped before they are counted, whether they are looked for or joined; lengths and repeated ids still count."""
    kept = []
    monkeypatch.setattr(lexical, "MOST_WORDS", most)
    stored = lexical.stored
    monkeypatch.setattr(lexical, "stored", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    texts = [(1, "A b c b"), (2, "b x"), (3, "x y z"), (4, ""), (5, None), (2, "b y"), (6, "a"), (6, "a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b b"), (2, "b q"), (3, None)], "query_id long, query_text string")
    got = lexical.bm25_top(docs, F.col("doc_id"), F.col("text"), queries, 10)
    want = lexical.bm25(docs, F.col("doc_id"), F.col("text"), queries).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))
    assert sorted(map(tuple, got.drop("rank").collect())) == sorted(map(tuple, want.collect()))
    if most > 1:
        assert sorted(r.doc_id for r in kept[0].where("term IS NULL").collect()) == [3, 4, 5]
        assert kept[0].agg(F.sum("own")).first()[0] == len(texts)


@pytest.mark.parametrize("name", ["graph_rerank", "profile_rerank", "graph_neighbours", "condition_credit"])
def test_no_pairs_of_features(spark, monkeypatch, name):
    """Only the best of each kind of query are wanted, so candidates must not become rows."""

    def pairs(*_):
        raise AssertionError("pairs of queries and documents")

    monkeypatch.setattr(graph, "candidates", pairs)
    assert CORE.plans[name](spark, SF).columns


def test_candidates_are_not_shuffled(spark):
    """All candidates are wanted, so they are made by joins with small sides; the rows are those of the plain join."""
    asked = spark.createDataFrame([(q, f"age:{q % 3}") for q in range(9)] + [(1, "sex:m"), (1, "sex:m")], "query_id long, feature string")
    web = spark.createDataFrame([(d, f"age:{d % 5}") for d in range(20)] + [(d, "sex:m") for d in range(4)], "doc_id long, feature string")
    got = graph.candidates(asked, web)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    prior = asked.distinct().join(web, "feature").withColumn("w", graph.feature_weight(F.col("feature"))).groupBy("query_id", "doc_id")
    want = {(r.query_id, r.doc_id): round(r.w, 6) for r in prior.agg(F.sum("w").alias("w")).collect()}
    assert {(r.query_id, r.doc_id): round(r.prior, 6) for r in got.collect()} == want
    assert all(0 < r.match <= 1 for r in got.collect())


def test_vectors_are_rounded_before_the_cut(spark, tmp_path):
    """More vectors than the 50 wanted are equally near when rounded, the higher ids a little nearer: the lower ids win."""
    profiles = [(50, "a", "any", "any")]
    spark.createDataFrame(profiles, "profile_id long, preferred_region string, preferred_size string, preferred_age string").write.parquet(
        f"{tmp_path}/appearance_profiles.parquet"
    )
    spark.createDataFrame([(1, "개 산책"), (2, "접종")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    near = [(i, [1.0, (200 - i) * 1e-6]) for i in range(1, 200) if i != 50] + [(50, [1.0, 0.0])]
    spark.createDataFrame(near, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = CORE.plans["vector_word_top"](spark, str(tmp_path)).toPandas(), connection(str(tmp_path)).execute(CORE.sql["vector_word_top"]).df()
    assert len(got) == 10 and rows(got) == rows(want)
