"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.functions.text import canonical_hash
from ranklake.session import small_side


#: Stands for a null owner among the keys.
_NO_OWNER = "\x00"


def snapshot_changes(
    df: DataFrame,
    *,
    owner: Column,
    date: Column,
    delivery: Column,
    seen_at: Column,
    key: Column,
    content: list[Column],
) -> DataFrame:
    """Records added, removed or changed between each snapshot of an owner and the one before it.

    Returns ``owner, snapshot_date, record_key, change_kind``. Of a date only the highest delivery counts; in it, of
    several rows of one key, the one seen last, ties going to the greater row hash. The first snapshot of an owner gives
    nothing. Rows without key are ignored, but their date still counts as a snapshot; rows without date are ignored; a
    null owner is an owner, a null delivery is below every other, a null ``seen_at`` before every other. An empty table
    gives no rows. Repeated rows change nothing.

    The snapshots' dates are an aggregate of owners x dates; that table is broadcast only when counted small. The rows
    meet in a full outer join on owner, date and key, so no hot owner or date gathers in one task, and only 64-bit
    hashes of the content are shuffled.
    """
    rows = df.select(
        F.coalesce(owner.cast("string"), F.lit(_NO_OWNER)).alias("owner"),
        date.alias("date"),
        F.coalesce(delivery.cast("long"), F.lit(-(2**62))).alias("delivery"),
        seen_at.alias("seen_at"),
        key.alias("key"),
        canonical_hash(*content).alias("content"),
    ).where("date IS NOT NULL")
    in_order = Window.partitionBy("owner").orderBy("date")
    dates = (
        rows.groupBy("owner", "date")
        .agg(F.max("delivery").alias("delivery"))
        .withColumn("before", F.lag("date").over(in_order))
        .withColumn("after", F.lead("date").over(in_order))
    )
    dates = small_side(dates.select(*(F.col(c).alias(f"d_{c}") for c in dates.columns)))
    same = [F.col("owner") == F.col("d_owner"), F.col("date") == F.col("d_date")]
    valid = rows.where("key IS NOT NULL").join(
        dates, reduce(Column.__and__, [*same, F.col("delivery") == F.col("d_delivery")])
    )
    latest = valid.groupBy("owner", "date", "key").agg(
        F.max(F.struct("d_before", "d_after")).alias("d"),
        F.max(F.struct(F.coalesce(F.unix_micros(F.col("seen_at").cast("timestamp")), F.lit(-(2**62))), "content"))[
            "content"
        ].alias("content")
    )
    # Both sides keep all rows until they have met, so that they are one and the same shuffle, made once.
    now = latest.select(*(F.col(c).alias(f"n_{c}") for c in ("owner", "date", "key", "content", "d")))
    was = latest.select(
        F.col("owner").alias("w_owner"),
        F.col("d.d_after").alias("w_date"),
        F.col("key").alias("w_key"),
        F.col("content").alias("w_content"),
    )
    met = now.join(
        was,
        (F.col("n_date") == F.col("w_date"))
        & (F.col("n_key") == F.col("w_key"))
        & (F.col("n_owner") == F.col("w_owner")),
        "full_outer",
    )
    kind = (
        F.when(F.col("w_key").isNull(), "added")
        .when(F.col("n_key").isNull(), "removed")
        .when(F.col("n_content") != F.col("w_content"), "changed")
    )
    gone = F.col("n_key").isNull()
    counts = F.when(gone, F.col("w_date").isNotNull()).otherwise(F.col("n_d.d_before").isNotNull())
    return met.where(counts).select(
        F.nullif(F.coalesce("n_owner", "w_owner"), F.lit(_NO_OWNER)).alias("owner"),
        F.coalesce("n_date", "w_date").alias("snapshot_date"),
        F.coalesce("n_key", "w_key").alias("record_key"),
        kind.alias("change_kind"),
    ).where("change_kind IS NOT NULL")
