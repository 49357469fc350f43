"""Vectors: norms, blends, exact nearest neighbours, scores by modality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.functions.vocabulary import MODALITY_WEIGHTS
from ranklake.session import cut

#: Most query vectors that one block holds; further queries go into further blocks.
BLOCK = 2_048


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; null if it is empty, zero or not finite."""
    n = norm(v)
    ok = (F.size(v) > 0) & (n > 1e-12) & (n < float("inf")) & ~F.isnan(n)
    return F.when(ok, F.transform(as_doubles(v), lambda x: x / n))


def blend(a: Column, b: Column, weight_b: float) -> Column:
    """``(1 - w) a + w b`` at length 1."""
    return unit(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * (1 - weight_b) + y * weight_b))


def nearest(
    queries: DataFrame, gallery: DataFrame, k: int, *, metric: str = "l2", exclude_self: bool = True, apart: str | None = None,
    decimals: int | None = None,
) -> DataFrame:
    """``query_id, doc_id, score, rank``: the exact k nearest gallery vectors of each query.

    ``queries(query_id, vector)``, ``gallery(doc_id, vector)``. The metric l2 scores ``1 / (1 + d^2)``, ip the dot
    product. Each gallery partition multiplies its vectors with blocks of about BLOCK queries and keeps the k best of
    every query, so what is shuffled is k rows a query and partition; the queries are shipped block by block, so their
    number has no bound but that of one block in memory. Ties go to the lower id. Null vectors take no part. With a column
    ``apart`` in both, a query meets no vector of the same value in it, such as one of the same session. With ``decimals``
    scores are rounded before they are ranked, so those that are equal then are ties.
    """
    group = F.lit(None).cast("string") if apart is None else F.col(apart).cast("string")
    asked = queries.where("vector IS NOT NULL").select("query_id", as_doubles(F.col("vector")).alias("vector"), group.alias("apart"))
    n_blocks = max(1, -(-5 * asked.count() // (4 * BLOCK)))
    blocks = (
        asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block"))
        .agg(F.collect_list(F.struct("query_id", "vector", "apart")).alias("q"))
    )
    pairs = gallery.where("vector IS NOT NULL").select("doc_id", as_doubles(F.col("vector")).alias("vector"), group.alias("apart"))
    shape = f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(gallery.dtypes)['doc_id']}, score double"
    out = None
    for row in blocks.toLocalIterator():
        ids = np.array([x.query_id for x in row.q])
        mat = np.array([x.vector for x in row.q], dtype=np.float64)
        own = np.array([x.apart for x in row.q], dtype=object)

        def best(batches: Iterator[pd.DataFrame], ids=ids, mat=mat, own=own) -> Iterator[pd.DataFrame]:
            keep: pd.DataFrame | None = None
            for g in batches:
                v = np.array(g.vector.tolist(), dtype=np.float64)
                s = mat @ v.T
                if metric == "l2":
                    s = 1 / (1 + np.maximum(0, (mat * mat).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * s))
                if decimals is not None:
                    s = np.floor(s * 10**decimals + 0.5) / 10**decimals
                doc = g.doc_id.to_numpy()
                if exclude_self:
                    s = np.where(ids[:, None] == doc[None, :], -np.inf, s)
                if apart is not None:
                    s = np.where(own[:, None] == g.apart.to_numpy(dtype=object)[None, :], -np.inf, s)
                n = min(k, s.shape[1])
                order = np.lexsort((np.broadcast_to(doc, s.shape), -s), axis=1)[:, :n]
                found = pd.DataFrame(
                    {"query_id": np.repeat(ids, n), "doc_id": doc[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()}
                )
                found = found[np.isfinite(found.score)]
                keep = found if keep is None else pd.concat([keep, found])
                keep = keep.sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if keep is not None:
                yield keep

        part = pairs.mapInPandas(best, shape)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = queries.sparkSession.createDataFrame([], shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rounded(x: np.ndarray, decimals: int) -> np.ndarray:
    """Rounded to whole units, halves up, whatever the order in which a sum was taken."""
    return np.floor(x * 10**decimals + 0.5 + 1e-9)


def target_ranks(queries: DataFrame, gallery: DataFrame, decimals: int) -> DataFrame:
    """``query_id, target_id, position, strict_rank, index_rank``: where a known target stands among all gallery vectors.

    ``queries(query_id, vector, target_id)``, ``gallery(doc_id, vector)``; scores are dot products rounded to ``decimals``,
    so ties occur; a query's own vector takes no part. ``strict_rank`` is one more than the number of greater scores,
    ``index_rank`` puts equal scores in order of the id, ``position`` puts the target after all equal ones. Every gallery
    partition counts for a block of queries at a time; only counts travel.
    """
    asked = queries.where("vector IS NOT NULL AND target_id IS NOT NULL")
    pairs = asked.join(gallery.select(F.col("doc_id").alias("target_id"), F.col("vector").alias("t_vector")), "target_id")
    scored = cut(pairs.select("query_id", "target_id", as_doubles(F.col("vector")).alias("vector"), as_doubles(F.col("t_vector")).alias("t_vector")))
    n_blocks = max(1, -(-5 * scored.count() // (4 * BLOCK)))
    blocks = scored.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block")).agg(
        F.collect_list(F.struct("query_id", "target_id", "vector", "t_vector")).alias("q")
    )
    rows = gallery.where("vector IS NOT NULL").select("doc_id", as_doubles(F.col("vector")).alias("vector"))
    shape = f"query_id {dict(queries.dtypes)['query_id']}, greater long, equal long, before long"
    out = queries.sparkSession.createDataFrame([], shape)
    for row in blocks.toLocalIterator():
        ids, targets = np.array([x.query_id for x in row.q]), np.array([x.target_id for x in row.q])
        mat, to = (np.array([x[c] for x in row.q], dtype=np.float64) for c in ("vector", "t_vector"))
        score = _rounded((mat * to).sum(axis=1), decimals)

        def count(batches: Iterator[pd.DataFrame], ids=ids, targets=targets, mat=mat, score=score) -> Iterator[pd.DataFrame]:
            for g in batches:
                s = _rounded(mat @ np.array(g.vector.tolist(), dtype=np.float64).T, decimals)
                doc = g.doc_id.to_numpy()
                other = (ids[:, None] != doc[None, :]) & (targets[:, None] != doc[None, :])
                equal = other & (s == score[:, None])
                yield pd.DataFrame(
                    {
                        "query_id": ids, "greater": (other & (s > score[:, None])).sum(1), "equal": equal.sum(1),
                        "before": (equal & (doc[None, :] < targets[:, None])).sum(1),
                    }
                )

        out = out.unionByName(rows.mapInPandas(count, shape))
    sums = out.groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("greater", "equal", "before")))
    ranks = scored.select("query_id", "target_id").join(sums, "query_id")
    one = F.col("greater") + 1
    return ranks.select(
        "query_id", "target_id", (one + F.col("equal")).alias("position"), one.alias("strict_rank"), (one + F.col("before")).alias("index_rank")
    )


def weighted_mean(vectors: dict[str, tuple[Column, float]]) -> Column:
    """The weighted mean of the vectors that are there, weights brought to a sum of one; not brought to length 1."""
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in vectors.values()), F.lit(0.0))
    times = lambda v, w: F.transform(as_doubles(v), lambda x: x * w)
    out = None
    for v, w in vectors.values():
        part = times(v, w)
        out = part if out is None else F.when(out.isNull(), part).when(part.isNull(), out).otherwise(F.zip_with(out, part, lambda a, b: a + b))
    return F.transform(out, lambda x: x / total)


def best_by_modality(hits: DataFrame) -> DataFrame:
    """``query_id, doc_id, modality, score, n_hits`` from ``hits(query_id, doc_id, modality, score)``."""
    return hits.groupBy("query_id", "doc_id", "modality").agg(
        F.max("score").alias("score"), F.count(F.lit(1)).alias("n_hits")
    )


def available_mean(best: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The weighted mean over the modalities a document has, and those it lacks.

    A modality without weight adds nothing, its document stays with score 0.
    """
    weights = weights or MODALITY_WEIGHTS
    w = F.create_map(*(x for m, v in weights.items() for x in (F.lit(m), F.lit(v))))
    w = F.coalesce(F.try_element_at(w, F.col("modality")), F.lit(0.0))
    all_modalities = F.array(*(F.lit(m) for m in weights))
    return best.groupBy("query_id", "doc_id").agg(
        F.coalesce(F.try_divide(F.sum(w * F.col("score")), F.sum(w)), F.lit(0.0)).alias("score"),
        F.array_except(all_modalities, F.collect_set("modality")).alias("missing"),
    )
