"""Characters, pairs of characters and words of whole texts."""

from math import log

import pytest

from ranklake.plans import extras
from ranklake.plans.core import CORE


def test_every_character_counts(spark, tmp_path):
    spark.createDataFrame([("가1 !\u1100\u1161\u3000😀",), ("1",), (None,)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.ch: r.n for r in CORE.plans["char_frequency"](spark, str(tmp_path)).collect()}
    assert got == {"가": 1, "1": 2, "!": 1, "\u1100": 1, "\u1161": 1, "😀": 1}


def test_descriptions_give_pairs(spark, tmp_path):
    rows = [("가 나다", "믹스"), (None, "믹스"), ("a", None)]
    spark.createDataFrame(rows, "desc_full string, breed string").write.parquet(f"{tmp_path}/notice_items.parquet")
    got = {r.gram: r.n for r in CORE.plans["char_bigram_frequency"](spark, str(tmp_path)).collect()}
    assert got == {"가나": 1, "나다": 1, "믹스": 2}


@pytest.mark.parametrize("small", [True, False])
def test_lists_of_words_are_not_broadcast(spark, tmp_path, monkeypatch, small):
    """The lists look as small as the file of texts, but a broadcast of them fills the driver; rows of one id are one document."""
    texts = [(1, "개 산책 a"), (1, "개 b"), (2, "개 개"), (3, "개 A"), (4, "a b"), (5, None), (6, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    if not small:
        monkeypatch.setattr(extras, "small_side", lambda df: df)
    found = CORE.plans["tfidf_terms"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) == small
    got = {(r.doc_id, r.term): r.weight for r in found.collect()}
    idf = log((1 + 7) / (1 + 3)) + 1
    want = {(1, "개"): 2, (2, "개"): 2, (3, "개"): 1, (1, "a"): 1, (3, "a"): 1, (4, "a"): 1}
    assert got == {k: pytest.approx((1 + log(tf)) * idf, abs=1e-6) for k, tf in want.items()}
