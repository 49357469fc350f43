"""Deterministic splits, samples and groups by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.session import cut


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the SHA-256 of the parts joined by bars."""
    digest = F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)


def split_of(group: Column, seed: str, train: float = 0.70, validation: float = 0.15) -> Column:
    """train, validation or test, the same for all rows of a group."""
    u = hash_unit(F.lit(seed), group)
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def stratified_split(df: DataFrame, stratum: Column, key: Column, fraction: float, seed: str) -> DataFrame:
    """``stratum, key, part``: of n members ``round(n f)``, at least 1 and at most n - 1, for validation, in hash order.

    A single member is for training; halves round to the even number.
    """
    rows = df.select(stratum.alias("stratum"), key.cast("string").alias("key")).distinct()
    rows = rows.withColumn("h", F.sha2(F.concat_ws("|", F.lit(seed), "stratum", "key"), 256))
    ranked = hash_ranks(rows, "stratum", "h", "key")
    n = F.col("n")
    take = F.when(n == 1, 0).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(fraction)).cast("long"))))
    return ranked.select("stratum", "key", F.when(F.col("place") <= take, "validation").otherwise("train").alias("part"))


def hash_ranks(rows: DataFrame, group: str, h: str, key: str) -> DataFrame:
    """``rows`` with ``place`` by a hexadecimal hash (then key) within the group, and ``n``, the group's size.

    Places are counted in 256 parts by the first two digits, and the parts' sizes added, so no group is in one task.
    """
    rows = rows.withColumn("part_no", F.substring(h, 1, 2))
    counts = rows.groupBy(group, "part_no").agg(F.count(F.lit(1)).alias("m"))
    in_order = Window.partitionBy(group).orderBy("part_no")
    before = F.coalesce(F.sum("m").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(
        F.col(group).alias("c_group"), F.col("part_no").alias("c_part"), before.alias("before"),
        F.sum("m").over(Window.partitionBy(group)).alias("n"),
    )
    own = F.row_number().over(Window.partitionBy(group, "part_no").orderBy(h, key))
    met = rows.withColumn("own", own).join(
        counts, F.col(group).eqNullSafe(F.col("c_group")) & (F.col("part_no") == F.col("c_part"))
    )
    return met.withColumn("place", F.col("own") + F.col("before")).drop("own", "before", "c_group", "c_part", "part_no")


def stratified_sample(df: DataFrame, stratum: Column, key: Column, size: int, seed: str) -> DataFrame:
    """``stratum, key``: one of each stratum by hash, then by hash of all to ``size``; a limit is what the operator is for."""
    rows = df.select(stratum.alias("stratum"), key.cast("string").alias("key")).distinct()
    rows = rows.withColumn("h", F.sha2(F.concat_ws("|", F.lit(seed), "key"), 256))
    first = rows.groupBy("stratum").agg(F.min(F.struct("h", "key"))["key"].alias("first"))
    first = first.select(F.col("stratum").alias("f_stratum"), "first")
    ranked = rows.join(first, F.col("stratum").eqNullSafe(F.col("f_stratum")))
    ranked = ranked.withColumn("late", F.when(F.col("key") == F.col("first"), 0).otherwise(1))
    return ranked.orderBy("late", "h", "key").limit(size).select("stratum", "key")


def draw_per_identity(df: DataFrame, identity: Column, key: Column, seed: str) -> DataFrame:
    """``identity, key, role``: the member of least hash is the gallery's, all others are queries."""
    rows = df.select(identity.alias("identity"), key.cast("string").alias("key")).distinct()
    rows = rows.withColumn("h", F.sha2(F.concat_ws("|", F.lit(seed), "key"), 256))
    least = rows.groupBy("identity").agg(F.min(F.struct("h", "key"))["key"].alias("chosen"))
    return rows.join(least, "identity").select(
        "identity", "key", F.when(F.col("key") == F.col("chosen"), "gallery").otherwise("query").alias("role")
    )


def opaque_code(*parts: Column, length: int = 12) -> Column:
    return F.upper(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, length))


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the least node of every connected component, ``edges(a, b)``.

    Every round, each node takes the least label of its neighbours, then the label of its label, so that long chains
    shrink by halves; rounds end when nothing changes. Labels are cut to the shared folder every round.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    both = cut(both)
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("c").alias("c"))
        )
        new = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", "c").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = cut(
            new.join(jump, "component", "left").select(
                "node", "old", F.least("component", F.coalesce("root", "component")).alias("component")
            )
        )
        done = new.where("old <> component").isEmpty()
        labels = new.select("node", "component")
        if done:
            return labels
