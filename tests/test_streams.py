from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ranklake.streaming import streams as T

T0 = datetime(2026, 1, 1)
SCHEMA = "k string, t timestamp, v int"


def folder(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        data = [(k, T0 + timedelta(minutes=m), v) for k, m, v in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return T.file_stream(spark, f"{tmp_path}/in", SCHEMA)


def test_rows_once(spark, tmp_path):
    stream = folder(spark, tmp_path, [[("a", 0, 1), ("b", 1, 1)], [("a", 5, 2), ("c", 6, 1)]])
    got = T.run_once(T.rows_once(stream, ["k"], "t"), "once", "append", f"{tmp_path}/c").collect()
    assert sorted(r.k for r in got) == ["a", "b", "c"]


def test_windows(spark, tmp_path):
    stream = folder(spark, tmp_path, [[("a", 0, 1), ("a", 59, 2)], [("a", 300, 5)]])
    out = T.outcome_windows(stream, "t", ["k"], F.col("v"), "1 hour", "1 hour")
    got = T.run_once(out, "windows", "complete", f"{tmp_path}/c").collect()
    assert sorted((r.start, r.n, r.total) for r in got) == [(T0, 2, 3), (T0 + timedelta(hours=5), 1, 5)]


def test_upserts(spark, tmp_path):
    stream = folder(spark, tmp_path, [[("a", 0, 1), ("b", 1, 1)], [("a", 5, 2)]])
    T.upserts(stream, ["k"], "t", f"{tmp_path}/log", f"{tmp_path}/view", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3
    assert {r.k: r.v for r in T.latest_view(spark, f"{tmp_path}/view").collect()} == {"a": 2, "b": 1}


def test_time_to_live(spark, tmp_path):
    stream = folder(spark, tmp_path, [[("a", 0, 1), ("a", 5, 2), ("b", 6, 3), ("a", 20, 4)]])
    out = T.with_time_to_live(stream, "k", "t", "v", 10)
    got = T.run_once(out, "ttl", "append", f"{tmp_path}/c").collect()
    assert sorted((r.key, r.value, r.hit) for r in got) == [("a", 1, 0), ("a", 1, 1), ("a", 4, 0), ("b", 3, 0)]
