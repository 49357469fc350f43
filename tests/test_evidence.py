"""A negation near a match counts in the registered query."""

from ranklake.plans.core import CORE


def test_negated_phrases_give_no_label(spark, tmp_path):
    rows = [(1, "온순합니다"), (2, "온순하지 않음"), (3, "예민함"), (4, "차")]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.label for r in CORE.plans["evidence_labels_negated"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: -1, 3: -1, 4: 0}
