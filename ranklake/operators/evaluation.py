"""Measures of rankings against judgments, of their stability, and of agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.functions.vocabulary import RBO_DEPTH, RBO_PERSISTENCE
from ranklake.operators.statistics import in_parts


def exact_mean(c: Column) -> Column:
    """The mean of values of six decimals, summed exactly, so it does not depend on the order; rounded to six."""
    return F.round(F.avg(c.cast("decimal(20,6)")), 6).cast("double")


def judged(run: DataFrame, qrels: DataFrame, least_grade: float = 1.0) -> DataFrame:
    """``system_id, query_id, doc_id, rank, grade, hit``: a run with grades, 0 where there is none.

    ``run(system_id, query_id, doc_id, rank)`` with every id once, ``qrels(query_id, doc_id, grade)`` unique.
    """
    grades = qrels.select("query_id", "doc_id", "grade")
    rows = run.join(grades, ["query_id", "doc_id"], "left").na.fill(0.0, ["grade"])
    return rows.withColumn("hit", (F.col("grade") >= least_grade).cast("int"))


def _ideal(qrels: DataFrame, k: int, gain: Column) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    placed = qrels.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return placed.groupBy("query_id").agg(F.sum(gain / F.log2(F.col("place") + 1)).alias("ideal"))


def ranking_metrics(run: DataFrame, qrels: DataFrame, least_grade: float = 1.0) -> DataFrame:
    """Precision@5 (by 5 also of shorter rankings), recall@5, recall@10, nDCG@5, reciprocal rank over the whole ranking
    and hit@5 of every system and query, with binary relevance and the ideal over all relevant documents."""
    rows = judged(run, qrels, least_grade)
    relevant = qrels.where(F.col("grade") >= least_grade)
    totals = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    ideal = _ideal(relevant, 5, F.lit(1.0))
    top = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    each = rows.groupBy("system_id", "query_id").agg(
        top(5).alias("hits5"),
        top(10).alias("hits10"),
        F.sum(F.when(F.col("rank") <= 5, F.col("hit") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    each = each.join(totals, "query_id", "left").join(ideal, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return each.select(
        "system_id",
        "query_id",
        zero(F.col("hits5") / 5.0).alias("precision_5"),
        zero(F.try_divide("hits5", "n_relevant")).alias("recall_5"),
        zero(F.try_divide("hits10", "n_relevant")).alias("recall_10"),
        zero(F.try_divide("dcg", "ideal")).alias("ndcg_5"),
        zero(F.lit(1.0) / F.col("first")).alias("reciprocal_rank"),
        (F.col("hits5") > 0).cast("int").alias("hit_5"),
    )


def graded_ndcg(run: DataFrame, qrels: DataFrame, k: int, exponential: bool) -> DataFrame:
    """nDCG@k with gain ``grade`` or ``2^grade - 1``; null where the ideal is 0."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1 if exponential else F.col("grade")
    rows = judged(run, qrels).where(F.col("rank") <= k)
    got = rows.groupBy("system_id", "query_id").agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"))
    out = got.join(_ideal(qrels, k, gain), "query_id", "left")
    return out.select(
        "system_id", "query_id", F.round(F.try_divide("dcg", F.nullif("ideal", F.lit(0.0))), 6).alias("ndcg")
    )


def average_precision(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Precision at each hit up to k, summed and divided by the lesser of k and the relevant; null without relevant."""
    rows = judged(run, qrels)
    so_far = Window.partitionBy("system_id", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("precision", F.sum("hit").over(so_far) / F.col("rank")).where(F.col("rank") <= k)
    relevant = qrels.where("grade >= 1").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    out = rows.groupBy("system_id", "query_id").agg(F.sum(F.col("hit") * F.col("precision")).alias("s"))
    share = F.try_divide("s", F.least(F.lit(k), F.col("n")))
    return out.join(relevant, "query_id", "left").select("system_id", "query_id", F.round(share, 6).alias("ap"))


def truncated_metrics(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Precision by the lesser of k and the length of the ranking, nDCG@k of gain 2^grade - 1 against all judgments, and the
    reciprocal rank of the first relevant document within k."""
    rows = judged(run, qrels)
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    top = F.col("rank") <= k
    each = rows.groupBy("system_id", "query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(top, F.col("hit")).otherwise(0)).alias("hits"),
        F.sum(F.when(top, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(top & (F.col("hit") == 1), F.col("rank"))).alias("first"),
    )
    each = each.join(_ideal(qrels, k, gain), "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return each.select(
        "system_id", "query_id", zero(F.col("hits") / F.least(F.lit(k), F.col("n"))).alias("precision"),
        zero(F.try_divide("dcg", F.nullif("ideal", F.lit(0.0)))).alias("ndcg"), zero(F.lit(1.0) / F.col("first")).alias("rr"),
    )


def roc_auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Area under the curve, ties count half: ``scored(..., label, score)``; null without both classes.

    Rows are counted by score, then the scores in ranges between approximate quantiles, so no group is in one task.
    """
    each = scored.groupBy(*by, "score").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    each = in_parts(each.withColumn("q", F.col("n") - F.col("p")), by, "score")
    sizes = each.groupBy(*by, "part").agg(F.sum("q").alias("k"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("k").over(earlier), F.lit(0))).drop("k")
    lower = Window.partitionBy(*by, "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("own", F.coalesce(F.sum("q").over(lower), F.lit(0))).join(sizes, [*by, "part"])
    won = F.sum(F.col("p") * (F.col("own") + F.col("before") + F.col("q") / 2))
    return each.groupBy(*by).agg(F.round(F.try_divide(won, F.sum("p") * F.sum("q")), 6).alias("auc"))


def _two(run: DataFrame, left: str, right: str, how: str) -> DataFrame:
    side = lambda s, c: run.where(F.col("system_id") == s).select("query_id", "doc_id", F.col("rank").alias(c))
    return side(left, "l").join(side(right, "r"), ["query_id", "doc_id"], how)


def rank_biased_overlap(
    run: DataFrame, left: str, right: str, depth: int = RBO_DEPTH, persistence: float = RBO_PERSISTENCE
) -> DataFrame:
    """Extrapolated rank-biased overlap of two systems over their common depth, per query; 0 where one has nothing."""
    met = _two(run, left, right, "full_outer")
    sizes = met.groupBy("query_id").agg(F.max("l").alias("nl"), F.max("r").alias("nr"))
    n = F.least(F.lit(depth), F.coalesce("nl", F.lit(0)), F.coalesce("nr", F.lit(0)))
    sizes = sizes.select("query_id", n.alias("n"))
    enter = met.where("l IS NOT NULL AND r IS NOT NULL").select("query_id", F.greatest("l", "r").alias("d"))
    joined = sizes.join(enter.groupBy("query_id").agg(F.collect_list("d").alias("ds")), "query_id", "left")
    ds = F.coalesce(F.col("ds"), F.array().cast("array<int>"))
    share = lambda k: F.size(F.filter(ds, lambda d: d <= k)) / k
    p = F.lit(persistence)
    terms = F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: (1 - p) * share(k) * F.pow(p, k - 1))
    value = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) + share(F.col("n")) * F.pow(p, F.col("n"))
    return joined.select("query_id", F.round(F.when(F.col("n") > 0, value).otherwise(0.0), 6).alias("rbo"))


def top_jaccard(run: DataFrame, left: str, right: str, k: int) -> DataFrame:
    """Overlap of two systems' top k by query, and whether they are the same in order; 1 for two empty lists."""
    met = _two(run.where(F.col("rank") <= k), left, right, "full_outer")
    both = F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1))
    return met.groupBy("query_id").agg(
        F.round(both / F.count(F.lit(1)), 6).alias("jaccard"), F.min(F.coalesce(F.col("l") == F.col("r"), F.lit(False))).alias("same_order")
    )


def rank_changes(run: DataFrame, left: str, right: str) -> DataFrame:
    """Mean and greatest shift of the documents both systems rank, and whether the first changed, by query."""
    met = _two(run, left, right, "inner").withColumn("shift", F.abs(F.col("l") - F.col("r")))
    return met.groupBy("query_id").agg(
        F.round(F.avg("shift"), 6).alias("mean_shift"),
        F.max("shift").alias("greatest_shift"),
        (F.max(F.when((F.col("l") == 1) & (F.col("r") == 1), 1).otherwise(0)) == 0).alias("first_changed"),
    )


def wins_and_ties(run: DataFrame, qrels: DataFrame, left: str, right: str) -> DataFrame:
    """How often the first relevant document of one system stands before the other's; none counts as last of all."""
    first = judged(run, qrels).where("hit = 1").groupBy("query_id", "system_id").agg(F.min("rank").alias("first"))
    side = lambda s, c: first.where(F.col("system_id") == s).select("query_id", F.col("first").alias(c))
    both = run.select("query_id").distinct().join(side(left, "l"), "query_id", "left").join(side(right, "r"), "query_id", "left")
    l, r = F.coalesce("l", F.lit(10**9)), F.coalesce("r", F.lit(10**9))
    return both.agg(
        F.count(F.when(l < r, 1)).alias("wins"), F.count(F.when(l == r, 1)).alias("ties"), F.count(F.when(l > r, 1)).alias("losses")
    )


def latest_ratings(log: DataFrame) -> DataFrame:
    """The rating in force of each rater and pair: the one updated last, of equal times the greater id."""
    return (
        log.groupBy("rater", "pair_id")
        .agg(F.max(F.struct("updated", "id", "score", "skipped")).alias("r"))
        .select("rater", "pair_id", "r.score", "r.skipped", "r.updated", "r.id")
    )


def ordinal_alpha(ratings: DataFrame) -> DataFrame:
    """Krippendorff's alpha with ordinal distances between grades, ``ratings(unit, grade)``: ``alpha``, one row.

    Units with fewer than two grades do not count. Only the grades' coincidence matrix leaves the units.
    """
    n = ratings.where("grade IS NOT NULL").groupBy("unit", "grade").agg(F.count(F.lit(1)).alias("c"))
    sizes = n.groupBy("unit").agg(F.sum("c").alias("m")).where("m >= 2")
    n = n.join(sizes, "unit")
    other = n.select("unit", F.col("grade").alias("grade2"), F.col("c").alias("c2"))
    pairs = n.join(other, "unit")
    cell = F.col("c") * (F.col("c2") - F.when(F.col("grade") == F.col("grade2"), 1).otherwise(0)) / (F.col("m") - 1)
    observed = pairs.groupBy("grade", "grade2").agg(F.sum(cell).alias("o"))
    counts = observed.groupBy("grade").agg(F.sum("o").alias("n"))
    order = Window.orderBy("grade")
    counts = counts.withColumn("mid", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2)
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    second = counts.select(F.col("grade").alias("grade2"), F.col("n").alias("n2"), F.col("mid").alias("mid2"))
    # As many rows as there are pairs of grades, not of units.
    grid = counts.join(second, F.lit(True)).join(observed, ["grade", "grade2"], "left").na.fill(0.0, ["o"])
    delta = F.pow(F.col("mid") - F.col("mid2"), F.lit(2))
    same = F.when(F.col("grade") == F.col("grade2"), 1).otherwise(0)
    sums = grid.agg(
        F.sum(F.col("o") * delta).alias("observed"),
        F.sum(F.col("n") * (F.col("n2") - same) / (F.col("total") - 1) * delta).alias("expected"),
    )
    return sums.select(F.round(1 - F.try_divide("observed", "expected"), 6).alias("alpha"))
