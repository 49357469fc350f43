"""Synchronisation by each provider's own calendar, and batches against all earlier ones."""

from ranklake.plans.core import CORE


def test_each_provider_has_its_own_dates(spark, tmp_path):
    rows = [
        ("a", "20250101", 1, "1", "s", "e"), ("a", "20250101", 1, "2", "s", "e"),
        ("a", "20250103", 1, "2", "old", "e"), ("a", "20250103", 2, "2", "t", "e"), ("a", "20250103", 2, "3", None, "e"),
        ("b", "20250102", 1, "1", "s", "e"), ("b", "20250109", 1, "1", "s", "f"), ("b", "20250116", 1, "9", "s", "f"),
    ]
    schema = "provider_id string, snapshot_date string, delivery_no int, notice_id string, source_status string, notice_end string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/notice_snapshots.parquet")
    run = lambda name: {tuple(r) for r in CORE.plans[name](spark, str(tmp_path)).collect()}
    assert run("sync_actions") == {
        ("a", "20250103", "1", "stale"), ("a", "20250103", "2", "changed_text"), ("a", "20250103", "3", "new"),
        ("b", "20250109", "1", "changed_picture"), ("b", "20250116", "1", "stale"), ("b", "20250116", "9", "new"),
    }
    assert ("b", "20250116", "new", 1) in run("sync_counts")
    assert run("safety_gates") == {
        ("a", "20250103", 2, 0.5, True), ("b", "20250109", 1, 0.0, True), ("b", "20250116", 1, 1.0, False)
    }


def test_each_batch_is_judged(spark, tmp_path):
    rows = [(1, 0, "x"), (2, 1, "x"), (3, 1, "y"), (4, 2, "y"), (5, 2, None), (6, 10, "z"), (7, 10, "z")]
    items = spark.createDataFrame(rows, "item_id int, batch_no int, notice_id string")
    items.write.parquet(f"{tmp_path}/notice_items.parquet")
    got = CORE.plans["incremental_append"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(1, 3), (2, 5), (10, 6), (10, 7)}
