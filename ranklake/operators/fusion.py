"""Scores brought together: conditions, fusion, reciprocal ranks, re-ranking by profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.functions.vocabulary import COMPATIBILITY_WEIGHT, FUSION_WEIGHTS, QUALITY_WEIGHT, RRF_K


def condition_parts(conditions: list[tuple[Column, Column]]) -> Column:
    """The mean credit of the conditions asked for: 1 met, 0.2 unknown, 0 missed; 0 if none is asked for.

    Each condition is ``(asked, met)``: whether it is asked for, and whether it is met, null if that is not known.
    """
    asked = sum((F.when(a, 1).otherwise(0) for a, _ in conditions), F.lit(0))
    points = sum(
        (F.when(a, F.when(m.isNull(), 0.2).when(m, 1.0).otherwise(0.0)).otherwise(0.0) for a, m in conditions), F.lit(0.0)
    )
    return F.coalesce(F.try_divide(points, asked), F.lit(0.0))


def compatibility(conditions: list[tuple[Column, Column]]) -> dict[str, Column]:
    """Mean over the applicable conditions of 1 met and 0 otherwise, and the share that is known.

    Unlike for the credit above an unknown counts 0 and stays in the denominator.
    """
    asked = sum((F.when(a, 1).otherwise(0) for a, _ in conditions), F.lit(0))
    met = sum((F.when(a & m, 1).otherwise(0) for a, m in conditions), F.lit(0))
    told = sum((F.when(a & m.isNotNull(), 1).otherwise(0) for a, m in conditions), F.lit(0))
    return {
        "compatibility": F.coalesce(F.try_divide(met, asked), F.lit(0.0)),
        "evidence_coverage": F.coalesce(F.try_divide(told, asked), F.lit(0.0)),
    }


def candidate_union(parts: dict[str, DataFrame]) -> DataFrame:
    """All candidates of several ``(query_id, doc_id, <name>)`` frames with each score, 0 where one has none.

    One shuffle for all: the parts are unioned and folded, not joined one after the other.
    """
    names = list(parts)
    rows = None
    for name, df in parts.items():
        cols = [F.col(name).alias(n) if n == name else F.lit(None).cast("double").alias(n) for n in names]
        part = df.select(F.struct("query_id", "doc_id").alias("key"), *cols)
        rows = part if rows is None else rows.unionByName(part)
    most = [F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names]
    return rows.groupBy("key").agg(*most).select("key.query_id", "key.doc_id", *names)


def fused(
    pool: DataFrame,
    weights: dict[str, float] | None = None,
    scaled: tuple[str, ...] = ("bm25", "prior"),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``query_id, doc_id, score`` and the columns to ``keep``: the weighted sum of the parts that ``pool`` has; the
    ``scaled`` parts are first divided by their greatest in the query."""
    weights = weights or FUSION_WEIGHTS
    most = pool.groupBy("query_id").agg(*(F.max(c).alias(f"most_{c}") for c in scaled if c in pool.columns))
    rows = pool.join(most, "query_id")
    total = F.lit(0.0)
    for name, w in weights.items():
        if name in pool.columns:
            part = F.col(name)
            if name in scaled:
                part = F.coalesce(F.try_divide(part, F.col(f"most_{name}")), F.lit(0.0))
            total = total + part * w
    return rows.select("query_id", "doc_id", total.alias("score"), *keep)


def reciprocal_ranks(runs: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """``query_id, doc_id, score``: the weighted sum of 1 / (k + rank) over systems, ``runs(system_id, query_id, doc_id, rank)``.

    An id that a system ranks twice counts once, at its better rank, and later ones move up.
    """
    runs = first_ranks(runs)
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(
            F.try_element_at(F.create_map(*(x for s, v in weights.items() for x in (F.lit(s), F.lit(v)))), F.col("system_id")),
            F.lit(0.0),
        )
    return runs.groupBy("query_id", "doc_id").agg(F.sum(w / (F.col("rank") + k)).alias("score"))


def first_ranks(runs: DataFrame) -> DataFrame:
    """A run with every id once per ranking, at its first place, and ranks counted anew."""
    once = runs.groupBy("system_id", "query_id", "doc_id").agg(F.min("rank").alias("place"))
    order = Window.partitionBy("system_id", "query_id").orderBy("place", "doc_id")
    return once.select("system_id", "query_id", "doc_id", F.row_number().over(order).alias("rank"))


def place_scores(scores: DataFrame, by: str, key: str, within: list[str]) -> DataFrame:
    """``scores`` with ``place_score``: (place - 1) / (n - 1) ascending, ties in order of the key."""
    order = Window.partitionBy(*within).orderBy(by, key)
    n = F.count(F.lit(1)).over(Window.partitionBy(*within))
    return scores.withColumn("place_score", (F.row_number().over(order) - 1) / F.greatest(F.lit(1), n - 1))


def profile_rerank(candidates: DataFrame) -> DataFrame:
    """``final = min(1, max(0, score)) + 0.25 compatibility + 0.05 quality``, a null quality adds nothing.

    Ordered by final, score and id, all descending, on unrounded values; ``rank`` from 1 within each profile.
    """
    base = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    final = base + F.col("compatibility") * COMPATIBILITY_WEIGHT + F.coalesce(F.col("quality"), F.lit(0.0)) * QUALITY_WEIGHT
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), F.desc("score"), F.desc("doc_id"))
    return candidates.withColumn("final", final).withColumn("rank", F.row_number().over(order))


def conservative(probability: Column, label: Column, desired: int = 1, band: float = 0.2) -> Column:
    """1 where the wanted label is explicit, 0 where its opposite is, else 0.5 and at most the band to either side."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), probability if desired == 1 else 1 - probability))
    return F.when(label == desired, 1.0).when(label == -desired, 0.0).otherwise(0.5 + band * (2 * p - 1))


def candidate_depth(k: Column, most: int = 50) -> Column:
    """How many candidates a re-ranking of k looks at: five times as many, at most ``most``."""
    return F.least(F.lit(most).cast("long"), F.greatest(k, 5 * k))
