"""Streams over the tables' files, run over what is there; their results equal the batch ones given as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ranklake.plans.registry import Registry, table
from ranklake.session import shared_folder
from ranklake.streaming import streams as T

STREAMS = Registry()


def _written(stream, mode="append"):
    """The stream's output as a table in the shared folder; complete results come from their last batch."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _file(spark, sf, name):
    """A stream of the table's own file, or of its folder's files."""
    whole = table(spark, sf, name)
    reader = spark.readStream.schema(whole.schema)
    if all(f.rsplit("/", 1)[-1] == f"{name}.parquet" for f in whole.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return reader.parquet(f"{sf}/{name}.parquet")


@STREAMS.add("stream_latest_ratings", "SELECT rater, pair_id, max(updated)::VARCHAR AS updated FROM rating_log GROUP BY ALL")
def stream_latest_ratings(spark, sf):
    log = _file(spark, sf, "rating_log").withColumn("updated", F.col("updated").cast("timestamp"))
    latest = T.latest_values(log, ["rater", "pair_id"], "updated", ["id", "score"])
    out = _written(latest, "complete")
    return out.select("rater", "pair_id", F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@STREAMS.add(
    "stream_rows_once",
    "SELECT count(DISTINCT (system_id, query_id, notice_id)) AS n FROM ranking_run",
)
def stream_rows_once(spark, sf):
    run = _file(spark, sf, "ranking_run").dropDuplicates(["system_id", "query_id", "notice_id"])
    return _written(run.select("system_id", "query_id", "notice_id")).agg(F.count(F.lit(1)).alias("n"))


@STREAMS.add(
    "stream_outcome_windows",
    """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n,
    round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def stream_outcome_windows(spark, sf):
    events = _file(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = T.outcome_windows(events, "ts", ["event_type"], F.col("value"), "1 day", "2 days")
    out = _written(days, "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@STREAMS.add("stream_time_to_live")
def stream_time_to_live(spark, sf):
    events = _file(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cached = T.with_time_to_live(events.select("user_id", "ts", "value"), "user_id", "ts", "value", 60)
    return _written(cached).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))



