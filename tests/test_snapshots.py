from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ranklake.functions.text import notice_number
from ranklake.operators.snapshots import snapshot_changes
from ranklake.plans.records import plain_status

SCHEMA = (
    "provider_id string, snapshot_date string, delivery_no int, retrieved_at timestamp, notice_id string, "
    "source_status string, change_kind string, owner string, content string"
)


def rows(*items):
    """(provider, date, delivery, hour, id, status), with columns whose names the operator uses itself."""
    return [(p, d, n, h and datetime(2026, 1, h), i, s, "x", "y", None) for p, d, n, h, i, s in items]


def changes(spark, items):
    df = spark.createDataFrame(rows(*items), SCHEMA)
    out = snapshot_changes(
        df, owner=F.col("provider_id"), date=F.col("snapshot_date"), delivery=F.col("delivery_no"),
        seen_at=F.col("retrieved_at"), key=notice_number(F.col("notice_id")), content=[plain_status(F.col("source_status"))],
    )
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_changes(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = changes(
        spark,
        [
            ("a", "1", 1, 1, "AB12-2026-00000001", "보호중"),
            ("a", "1", 1, 2, "AB12-2026-00000002", "active"),
            ("a", "1", 1, 2, "AB12-2026-00000004", None),
            ("a", "3", 1, 2, "AB12-2026-00000009", "outdated delivery"),
            ("a", "3", 2, 1, "ab12 2026 2", "stale row"),
            ("a", "3", 2, 3, "ab12 2026 2", " ＡＣＴＩＶＥ "),
            ("a", "3", 2, 3, "AB12_2026_OO000003", "x"),
            ("a", "3", 2, 3, "AB12_2026_OO000003", "x"),
            ("a", "3", 2, 3, "AB12-2026-00000004", "N/A"),
            ("a", "3", 2, 3, None, "x"),
            ("a", "3", 2, 3, " - ", "x"),
            ("b", "3", 1, 3, "AB12-2026-00000002", "first date of b"),
        ],
    )
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == [("a", "3", "AB12-2026-00000001", "removed"), ("a", "3", "AB12-2026-00000003", "added")]


def test_status_null_owner_and_ids_without_shape(spark):
    got = changes(
        spark,
        [
            (None, "1", None, None, "weird id", "a"),
            (None, "2", None, None, "WEIRD-ID", "b"),
            (None, None, 1, 1, "WEIRD-ID", "no date"),
        ],
    )
    assert got == [(None, "2", "WEIRD-ID", "changed")]


def test_date_without_usable_rows_still_counts(spark):
    got = changes(
        spark, [("a", "1", 1, 1, "AB12-2026-1", "s"), ("a", "2", 1, 1, None, "s"), ("a", "3", 1, 1, "AB12-2026-1", "s")]
    )
    assert got == [("a", "2", "AB12-2026-00000001", "removed"), ("a", "3", "AB12-2026-00000001", "added")]


def test_empty(spark):
    assert changes(spark, []) == []
