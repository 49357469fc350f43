"""Structured Streaming: rows once, latest values, windows of outcomes, values with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rows_once(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; the state of a key is dropped once rows ``late`` behind cannot come any more."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def outcome_windows(stream: DataFrame, time: str, by: list[str], value: Column, length: str, late: str) -> DataFrame:
    """Number and sum in tumbling windows; rows later than the watermark are left out, windows come out when closed."""
    w = F.window(time, length)
    out = stream.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def latest_values(stream: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """The row in force of each key, the latest by time; for output mode update or complete."""
    return stream.groupBy(*keys).agg(F.max(F.struct(time, *columns)).alias("r")).select(*keys, "r.*")


#: Parts of the view of latest values; a batch writes only those parts that it touches.
VIEW_PARTS = 16
_PART, _BATCH = "view_part_no", "view_batch_no"


def upserts(stream: DataFrame, keys: list[str], time: str, log_path: str, view_path: str, checkpoint: str):
    """Each micro-batch is appended to a log and merged into a view of latest values, which ``latest_view`` reads.

    The view is kept in VIEW_PARTS parts by hash of the key, each with the number of the batch that wrote it. A batch reads
    and writes the parts of its own keys only, never the log. Batches are numbered, and a batch that is run again starts
    from the parts of the batches before it and replaces what it wrote, so the log has every row once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/{_BATCH}={number}")
        part = F.pmod(F.xxhash64(*keys), F.lit(VIEW_PARTS)).cast("int")
        rows = batch.withColumn(_PART, part)
        names = [c for c in batch.columns if c not in (*keys, time)]
        if number:
            before = latest_view(batch.sparkSession, view_path, number)
            touched = rows.select(_PART).distinct()
            rows = rows.unionByName(before.join(F.broadcast(touched), _PART, "left_semi").select(*rows.columns))
        latest = rows.groupBy(*keys, _PART).agg(F.max(F.struct(time, *names)).alias("r")).select(*keys, "r.*", _PART)
        latest.write.mode("overwrite").partitionBy(_PART).parquet(f"{view_path}/{_BATCH}={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_view(spark, view_path: str, before: int | None = None) -> DataFrame:
    """The view that ``upserts`` keeps: of each part what the last batch wrote, before batch ``before`` if given."""
    view = spark.read.parquet(view_path)
    if before is not None:
        view = view.where(F.col(_BATCH) < before)
    newest = view.groupBy(_PART).agg(F.max(_BATCH).alias(_BATCH))
    return view.join(F.broadcast(newest), [_PART, _BATCH], "left_semi").drop(_BATCH)


def with_time_to_live(stream: DataFrame, key: str, time: str, value: str, minutes: int) -> DataFrame:
    """``key, value, hits``: rows answered from a value stored within ``minutes`` before; an older one is stored anew.

    The state of a key is dropped when event time has passed its end of life.
    """
    kind = dict(stream.dtypes)

    def answer(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, until = state.get if state.exists else (None, -1)
        rows = pd.concat(list(parts)).sort_values(time)
        out = []
        for t, v in zip(rows[time], rows[value], strict=True):
            now = int(pd.Timestamp(t).timestamp() * 1000)
            hit = now < until
            if not hit:
                kept, until = v, now + minutes * 60_000
            out.append((k[0], kept, int(hit)))
        state.update((kept, until))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(until, mark + 1))
        yield pd.DataFrame(out, columns=["key", "value", "hit"])

    return (
        stream.withWatermark(time, "1 minute")
        .groupBy(key)
        .applyInPandasWithState(
            answer, f"key {kind[key]}, value {kind[value]}, hit int", f"value {kind[value]}, until long", "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there into a table in memory (small results only) and return it."""
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


