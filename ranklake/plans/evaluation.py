"""Queries of evaluation and statistics over ranking_run, qrels, rating_log and events."""

from __future__ import annotations


from pyspark.sql import functions as F

from ranklake.operators import evaluation as E
from ranklake.operators import statistics as S
from ranklake.plans.registry import Registry, table
from ranklake.plans.retrieval import _RUN_SQL, runs

EVALUATION = Registry()


def qrels(spark, sf):
    return table(spark, sf, "qrels").select("query_id", F.col("notice_id").alias("doc_id"), "grade")


_QRELS = "(SELECT query_id, notice_id AS doc_id, grade FROM qrels)"
_JUDGED = f"""SELECT r.system_id, r.query_id, r.doc_id, r.rank, coalesce(q.grade, 0) AS grade,
  (coalesce(q.grade, 0) >= 1)::INT AS hit FROM ({_RUN_SQL}) r LEFT JOIN {_QRELS} q USING (query_id, doc_id)"""
_METRICS = f"""SELECT system_id, query_id, round(h5 / 5.0, 6) AS precision_5, round(coalesce(h5 / n, 0), 6) AS recall_5,
  round(coalesce(h10 / n, 0), 6) AS recall_10, round(coalesce(dcg / ideal, 0), 6) AS ndcg_5,
  round(coalesce(1.0 / fst, 0), 6) AS reciprocal_rank, (h5 > 0)::INT AS hit_5 FROM (
  SELECT system_id, query_id, sum(hit) FILTER (WHERE rank <= 5) AS h5, sum(hit) FILTER (WHERE rank <= 10) AS h10,
    coalesce(sum(hit / log2(rank + 1)) FILTER (WHERE rank <= 5), 0) AS dcg, min(rank) FILTER (WHERE hit = 1) AS fst
    FROM ({_JUDGED}) GROUP BY ALL) LEFT JOIN (
  SELECT query_id, count(*) AS n, sum(1 / log2(p + 1)) FILTER (WHERE p <= 5) AS ideal FROM (SELECT query_id,
    row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS p FROM {_QRELS} WHERE grade >= 1)
    GROUP BY query_id) USING (query_id)"""


def _exact(c: str) -> str:
    """The mean of values of six decimals, as a whole number of millionths so that no order of summation matters."""
    total = f"sum(round({c} * 1000000)::HUGEINT)"
    return f"((({total} * 2 + count({c})) // (2 * count({c})))::DOUBLE / 1000000)"


@EVALUATION.add("ranking_metrics", _METRICS)
def ranking_metrics(spark, sf):
    return E.ranking_metrics(runs(spark, sf), qrels(spark, sf))


@EVALUATION.add(
    "system_metrics",
    f"""SELECT system_id, {_exact("precision_5")} AS precision_5, {_exact("recall_10")} AS recall_10,
    {_exact("ndcg_5")} AS ndcg_5, {_exact("reciprocal_rank")} AS mrr, count(*) AS n_queries
    FROM ({_METRICS}) GROUP BY system_id""",
)
def system_metrics(spark, sf):
    mean = lambda c, name: E.exact_mean(F.col(c)).alias(name)
    return ranking_metrics(spark, sf).groupBy("system_id").agg(
        mean("precision_5", "precision_5"), mean("recall_10", "recall_10"), mean("ndcg_5", "ndcg_5"),
        mean("reciprocal_rank", "mrr"), F.count(F.lit(1)).alias("n_queries"),
    )


@EVALUATION.add(
    "latency_summary",
    """SELECT system_id, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS p50_ms,
    round(quantile_cont(ms, 0.95), 6) AS p95_ms, max(ms) AS greatest_ms FROM (SELECT system_id, query_id,
    max(latency_ms) AS ms FROM ranking_run GROUP BY ALL) GROUP BY system_id""",
)
def latency_summary(spark, sf):
    each = table(spark, sf, "ranking_run").groupBy("system_id", "query_id").agg(F.max("latency_ms").alias("ms"))
    q = S.quantiles(each, ["system_id"], "ms", [0.5, 0.95]).groupBy("system_id")
    at = lambda s: F.round(F.max(F.when(F.col("share") == s, F.col("quantile"))), 6)
    mean = each.groupBy("system_id").agg(F.round(F.avg("ms"), 6).alias("mean_ms"), F.max("ms").alias("greatest_ms"))
    return mean.join(q.agg(at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms")), "system_id")


def _sql_ndcg(gain: str, k: int) -> str:
    return f"""SELECT system_id, query_id, round(dcg / nullif(ideal, 0), 6) AS ndcg FROM (SELECT system_id, query_id,
      sum(({gain}) / log2(rank + 1)) AS dcg FROM ({_JUDGED}) WHERE rank <= {k} GROUP BY ALL) LEFT JOIN (SELECT query_id,
      sum(({gain}) / log2(p + 1)) AS ideal FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id
      ORDER BY grade DESC, doc_id) AS p FROM {_QRELS}) WHERE p <= {k} GROUP BY query_id) USING (query_id)"""


@EVALUATION.add("ndcg_linear", _sql_ndcg("grade", 10))
def ndcg_linear(spark, sf):
    return E.graded_ndcg(runs(spark, sf), qrels(spark, sf), 10, False)


@EVALUATION.add("ndcg_exponential", _sql_ndcg("pow(2, grade) - 1", 10))
def ndcg_exponential(spark, sf):
    return E.graded_ndcg(runs(spark, sf), qrels(spark, sf), 10, True)


@EVALUATION.add(
    "average_precision",
    f"""SELECT system_id, query_id, round(s / least(10, n), 6) AS ap FROM (SELECT system_id, query_id, sum(hit * p) AS s FROM (
    SELECT *, sum(hit) OVER (PARTITION BY system_id, query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) / rank AS p
    FROM ({_JUDGED})) WHERE rank <= 10 GROUP BY ALL) LEFT JOIN (SELECT query_id, count(*) AS n FROM qrels WHERE grade >= 1
    GROUP BY query_id) USING (query_id)""",
)
def average_precision(spark, sf):
    return E.average_precision(runs(spark, sf), qrels(spark, sf), 10)


@EVALUATION.add(
    "roc_auc",
    f"""SELECT system_id, round((s - p * (p + 1) / 2) / nullif(p * (n - p), 0), 6) AS auc FROM (SELECT system_id,
    sum(hit) AS p, count(*) AS n, sum(hit * mr) AS s FROM (SELECT system_id, hit, rank() OVER (PARTITION BY system_id
    ORDER BY -rank) + (count(*) OVER (PARTITION BY system_id, rank) - 1) / 2 AS mr FROM ({_JUDGED})) GROUP BY system_id)""",
)
def roc_auc(spark, sf):
    rows = E.judged(runs(spark, sf), qrels(spark, sf))
    return E.roc_auc(rows.select("system_id", F.col("hit").alias("label"), (-F.col("rank")).alias("score")), ["system_id"])


_L, _R = "bm25", "hybrid_graph"
_TWO = f"""SELECT coalesce(a.query_id, b.query_id) AS query_id, a.rank AS l, b.rank AS r FROM
  (SELECT * FROM ({_RUN_SQL}) WHERE system_id = '{_L}') a {{how}} JOIN (SELECT * FROM ({_RUN_SQL}) WHERE system_id = '{_R}') b
  ON a.query_id = b.query_id AND a.doc_id = b.doc_id"""


@EVALUATION.add(
    "rank_biased_overlap",
    f"""WITH t AS ({_TWO.format(how="FULL")}), n AS (SELECT query_id, least(10, coalesce(max(l), 0), coalesce(max(r), 0)) AS n
      FROM t GROUP BY query_id), k AS (SELECT query_id, n, unnest(range(1, n + 1)) AS k FROM n),
    a AS (SELECT k.query_id, k.n, k.k, count(t.l) / k.k AS share FROM k LEFT JOIN t ON t.query_id = k.query_id AND t.l IS NOT NULL
      AND t.r IS NOT NULL AND greatest(t.l, t.r) <= k.k GROUP BY k.query_id, k.n, k.k)
    SELECT query_id, round(coalesce(s, 0), 6) AS rbo FROM n LEFT JOIN (SELECT query_id, sum(0.1 * share * pow(0.9, k - 1)) +
      max(CASE WHEN k = n THEN share * pow(0.9, n) END) AS s FROM a GROUP BY query_id) USING (query_id)""",
)
def rank_biased_overlap(spark, sf):
    return E.rank_biased_overlap(runs(spark, sf), _L, _R)


@EVALUATION.add(
    "top_jaccard",
    f"""SELECT query_id, round(count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) / count(*), 6) AS jaccard,
    bool_and(coalesce(l = r, false)) AS same_order FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.rank AS l,
    b.rank AS r FROM (SELECT * FROM ({_RUN_SQL}) WHERE system_id = '{_L}' AND rank <= 5) a FULL JOIN (SELECT * FROM ({_RUN_SQL})
    WHERE system_id = '{_R}' AND rank <= 5) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id) GROUP BY query_id""",
)
def top_jaccard(spark, sf):
    return E.top_jaccard(runs(spark, sf), _L, _R, 5)


@EVALUATION.add(
    "rank_changes",
    f"""SELECT query_id, round(avg(abs(l - r)), 6) AS mean_shift, max(abs(l - r)) AS greatest_shift,
    max((l = 1 AND r = 1)::INT) = 0 AS first_changed FROM ({_TWO.format(how="")}) GROUP BY query_id""",
)
def rank_changes(spark, sf):
    return E.rank_changes(runs(spark, sf), _L, _R)


@EVALUATION.add(
    "wins_and_ties",
    f"""WITH f AS (SELECT query_id, system_id, min(rank) AS f FROM ({_JUDGED}) WHERE hit = 1 GROUP BY ALL),
    b AS (SELECT q.query_id, coalesce(l.f, 1000000000) AS l, coalesce(r.f, 1000000000) AS r FROM (SELECT DISTINCT query_id
    FROM ranking_run) q LEFT JOIN f l ON l.query_id = q.query_id AND l.system_id = '{_L}' LEFT JOIN f r ON
    r.query_id = q.query_id AND r.system_id = '{_R}') SELECT count(*) FILTER (WHERE l < r) AS wins,
    count(*) FILTER (WHERE l = r) AS ties, count(*) FILTER (WHERE l > r) AS losses FROM b""",
)
def wins_and_ties(spark, sf):
    return E.wins_and_ties(runs(spark, sf), qrels(spark, sf), _L, _R)


@EVALUATION.add(
    "metric_deltas",
    f"""SELECT a.query_id, round(b.ndcg_5 - a.ndcg_5, 6) AS delta, CASE WHEN b.ndcg_5 > a.ndcg_5 THEN 'better'
    WHEN b.ndcg_5 < a.ndcg_5 THEN 'worse' ELSE 'tied' END AS outcome FROM ({_METRICS}) a JOIN ({_METRICS}) b
    ON a.query_id = b.query_id WHERE a.system_id = '{_L}' AND b.system_id = '{_R}'""",
)
def metric_deltas(spark, sf):
    m = ranking_metrics(spark, sf)
    wide = m.groupBy("query_id").pivot("system_id", [_L, _R]).agg(F.first("ndcg_5")).dropna()
    a, b = F.col(_L), F.col(_R)
    outcome = F.when(b > a, "better").when(b < a, "worse").otherwise("tied")
    return wide.select("query_id", F.round(b - a, 6).alias("delta"), outcome.alias("outcome"))


@EVALUATION.add(
    "pooled_candidates",
    f"""SELECT query_id, doc_id, count(*) AS n_systems, min(rank) AS best_rank,
    upper(substr(sha256('pool|' || query_id || '|' || doc_id), 1, 12)) AS code FROM ({_RUN_SQL}) WHERE rank <= 5 GROUP BY ALL""",
)
def pooled_candidates(spark, sf):
    pool = runs(spark, sf).where("rank <= 5").groupBy("query_id", "doc_id")
    code = F.upper(F.substring(F.sha2(F.concat_ws("|", F.lit("pool"), "query_id", "doc_id"), 256), 1, 12))
    return pool.agg(F.count(F.lit(1)).alias("n_systems"), F.min("rank").alias("best_rank")).withColumn("code", code)


@EVALUATION.add(
    "judged_share",
    f"""SELECT system_id, round(count(q.grade) / count(*), 6) AS share_judged, count(*) AS n FROM ({_RUN_SQL}) r
    LEFT JOIN {_QRELS} q USING (query_id, doc_id) GROUP BY system_id""",
)
def judged_share(spark, sf):
    rows = runs(spark, sf).join(qrels(spark, sf), ["query_id", "doc_id"], "left").groupBy("system_id")
    return rows.agg(F.round(F.count("grade") / F.count(F.lit(1)), 6).alias("share_judged"), F.count(F.lit(1)).alias("n"))


# Ratings.

_LATEST = """SELECT rater, pair_id, score, skipped, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated, id FROM (SELECT *,
  row_number() OVER (PARTITION BY rater, pair_id ORDER BY updated DESC, id DESC) AS k FROM rating_log) WHERE k = 1"""


@EVALUATION.add("latest_ratings", _LATEST)
def latest_ratings(spark, sf):
    latest = E.latest_ratings(table(spark, sf, "rating_log"))
    return latest.withColumn("updated", F.date_format("updated", "yyyy-MM-dd HH:mm:ss"))


@EVALUATION.add(
    "judgment_consensus",
    f"""SELECT pair_id, count(score) AS n_raters, round(avg(score), 6) AS mean_grade, max(score) - min(score) AS spread
    FROM ({_LATEST}) WHERE NOT skipped GROUP BY pair_id""",
)
def judgment_consensus(spark, sf):
    rows = latest_ratings(spark, sf).where("NOT skipped").groupBy("pair_id")
    return rows.agg(
        F.count("score").alias("n_raters"), F.round(F.avg("score"), 6).alias("mean_grade"), (F.max("score") - F.min("score")).alias("spread")
    )


_UNITS = f"(SELECT pair_id AS unit, score AS grade FROM ({_LATEST}) WHERE NOT skipped AND score IS NOT NULL)"


@EVALUATION.add(
    "ordinal_alpha",
    f"""WITH n AS (SELECT *, sum(c) OVER (PARTITION BY unit) AS m FROM (SELECT unit, grade, count(*) AS c FROM {_UNITS} GROUP BY ALL)),
    o AS (SELECT a.grade AS g, b.grade AS h, sum(a.c * (b.c - (a.grade = b.grade)::INT) / (a.m - 1)) AS v FROM n a JOIN n b
      ON a.unit = b.unit WHERE a.m >= 2 GROUP BY a.grade, b.grade), k AS (SELECT g, sum(v) AS n FROM o GROUP BY g),
    d AS (SELECT g, n, sum(n) OVER (ORDER BY g) - n / 2 AS mid, sum(n) OVER () AS t FROM k)
    SELECT round(1 - sum(coalesce(o.v, 0) * pow(a.mid - b.mid, 2)) / sum(a.n * (b.n - (a.g = b.g)::INT) / (a.t - 1) *
      pow(a.mid - b.mid, 2)), 6) AS alpha FROM d a CROSS JOIN d b LEFT JOIN o ON o.g = a.g AND o.h = b.g""",
)
def ordinal_alpha(spark, sf):
    rows = latest_ratings(spark, sf).where("NOT skipped")
    return E.ordinal_alpha(rows.select(F.col("pair_id").alias("unit"), F.col("score").alias("grade")))


@EVALUATION.add(
    "complete_blocks",
    f"""WITH l AS (SELECT * FROM ({_LATEST}) WHERE NOT skipped), p AS (SELECT rater FROM l GROUP BY rater ORDER BY count(*) DESC, rater LIMIT 3)
    SELECT pair_id, round(avg(score), 6) AS mean_grade FROM l WHERE rater IN (SELECT rater FROM p) GROUP BY pair_id
    HAVING count(DISTINCT rater) = (SELECT count(*) FROM p)""",
)
def complete_blocks(spark, sf):
    """Pairs that all of a panel rated; the panel is the three raters who rated most, ties by name."""
    rows = latest_ratings(spark, sf).where("NOT skipped")
    panel = rows.groupBy("rater").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "rater").limit(3).select("rater")
    size = panel.agg(F.count(F.lit(1)).alias("m"))
    out = rows.join(F.broadcast(panel), "rater").groupBy("pair_id")
    out = out.agg(F.round(F.avg("score"), 6).alias("mean_grade"), F.countDistinct("rater").alias("n"))
    return out.join(F.broadcast(size), F.col("n") == F.col("m")).select("pair_id", "mean_grade")


@EVALUATION.add(
    "rater_agreement",
    f"""SELECT a.rater AS rater_a, b.rater AS rater_b, count(*) AS n, round(avg((a.score = b.score)::INT), 6) AS exact
    FROM ({_LATEST}) a JOIN ({_LATEST}) b ON a.pair_id = b.pair_id AND a.rater < b.rater
    WHERE a.score IS NOT NULL AND b.score IS NOT NULL GROUP BY ALL""",
)
def rater_agreement(spark, sf):
    rows = latest_ratings(spark, sf).where("score IS NOT NULL").select("pair_id", "rater", "score")
    other = rows.select("pair_id", F.col("rater").alias("rater_b"), F.col("score").alias("score_b"))
    met = rows.join(other, "pair_id").where("rater < rater_b").groupBy(F.col("rater").alias("rater_a"), "rater_b")
    return met.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("score") == F.col("score_b")).cast("int")), 6).alias("exact"))


# Statistics.


@EVALUATION.add(
    "numeric_summary",
    """SELECT event_type, count(value) AS n, min(value) AS least, round(quantile_cont(value, 0.25), 6) AS p25,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS greatest
    FROM events GROUP BY event_type""",
)
def numeric_summary(spark, sf):
    return S.numeric_summary(table(spark, sf, "events"), ["event_type"], F.col("value"))


@EVALUATION.add(
    "seeds_summary",
    """SELECT user_id, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS deviation,
    round(min(value), 6) AS least, round(max(value), 6) AS greatest FROM events GROUP BY user_id""",
)
def seeds_summary(spark, sf):
    return S.seeds_summary(table(spark, sf, "events"), ["user_id"], F.col("value"))


_P = "SELECT event_type, user_id AS name, round(1 / (1 + count(*) * avg(value)), 8) AS p FROM events GROUP BY ALL"


@EVALUATION.add(
    "holm_adjusted",
    f"""SELECT event_type, name, p, round(max(s) OVER (PARTITION BY event_type ORDER BY p, name ROWS UNBOUNDED PRECEDING), 8)
    AS adjusted FROM (SELECT *, least(1, (count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type
    ORDER BY p, name) + 1) * p) AS s FROM ({_P}))""",
)
def holm_adjusted(spark, sf):
    p = F.round(1 / (1 + F.count(F.lit(1)) * F.avg("value")), 8).alias("p")
    each = table(spark, sf, "events").groupBy("event_type", F.col("user_id").alias("name")).agg(p)
    return S.holm(each, ["event_type"]).withColumn("adjusted", F.round("adjusted", 8))


@EVALUATION.add(
    "sign_counts",
    f"""SELECT count(*) FILTER (WHERE d > 1e-12) AS wins, count(*) FILTER (WHERE d < -1e-12) AS losses,
    count(*) FILTER (WHERE abs(d) <= 1e-12) AS ties FROM (SELECT b.ndcg_5 - a.ndcg_5 AS d FROM ({_METRICS}) a JOIN ({_METRICS}) b
    ON a.query_id = b.query_id WHERE a.system_id = '{_L}' AND b.system_id = '{_R}')""",
)
def sign_counts(spark, sf):
    return S.sign_test(metric_deltas(spark, sf), F.col("delta")).drop("p")


@EVALUATION.add("sign_test")
def sign_test(spark, sf):
    return S.sign_test(metric_deltas(spark, sf), F.col("delta"))


@EVALUATION.add(
    "cluster_sums",
    "SELECT user_id AS cluster, round(sum(value), 6) AS total, count(value) AS n FROM events GROUP BY user_id",
)
def cluster_sums(spark, sf):
    return S.cluster_sums(table(spark, sf, "events"), "user_id", F.col("value")).withColumn("total", F.round("total", 6))


_U = "('0x' || substr(md5('bootstrap|' || cluster || '|' || sample), 1, 8))::BIGINT / 4294967296.0"


@EVALUATION.add(
    "bootstrap_interval",
    f"""WITH s AS (SELECT event_type, user_id AS cluster, sum(value) AS total, count(value) AS n FROM events GROUP BY ALL),
    d AS (SELECT *, {_U} AS u FROM s, (SELECT unnest(range(1, 1001)) AS sample)),
    w AS (SELECT *, {" + ".join(f"(u >= {t})::INT" for t in S._POISSON)} AS times FROM d),
    m AS (SELECT event_type, sum(times * total) / sum(times * n) AS mean FROM w WHERE times > 0 GROUP BY event_type, sample
      HAVING sum(times * n) > 0),
    t AS (SELECT event_type, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, count(*) AS b,
      least(count(*) FILTER (WHERE mean <= 0), count(*) FILTER (WHERE mean >= 0)) AS k FROM m GROUP BY event_type)
    SELECT event_type, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high,
      round(least(1, 2 * (k + 1) / (b + 1)), 6) AS p FROM t JOIN (SELECT event_type, sum(total) / sum(n) AS mean FROM s
      GROUP BY event_type) USING (event_type)""",
)
def bootstrap_interval(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type", F.col("user_id").alias("cluster"))
    return S.bootstrap_interval(rows.agg(F.sum("value").alias("total"), F.count("value").alias("n")), ["event_type"])


@EVALUATION.add(
    "permutation_p",
    f"""WITH d AS (SELECT query_id, round(b.ndcg_5 - a.ndcg_5, 6)::DECIMAL(18, 9) AS d FROM ({_METRICS}) a JOIN ({_METRICS}) b
      USING (query_id) WHERE a.system_id = '{_L}' AND b.system_id = '{_R}'),
    s AS (SELECT sample, sum(CASE WHEN substr(md5('flip|' || query_id || '|' || sample), 1, 1) < '8' THEN -d ELSE d END) AS s
      FROM d, (SELECT unnest(range(1, 100001)) AS sample) WHERE d <> 0 GROUP BY sample)
    SELECT '{_L}|{_R}' AS pair, CASE WHEN count(*) FILTER (WHERE d <> 0) = 0 THEN 1.0 ELSE round(((SELECT count(*) FROM s WHERE
      abs(s) >= (SELECT abs(sum(d)) FROM d)) + 1) / 100001.0, 6) END AS p FROM d HAVING count(*) > 0""",
)
def permutation_p(spark, sf):
    rows = metric_deltas(spark, sf).withColumn("pair", F.lit(f"{_L}|{_R}"))
    return S.permutation_p(rows, ["pair"], "query_id", "delta")


@EVALUATION.add(
    "random_precision",
    """SELECT query_id, round(CASE WHEN p > 0 THEN list_sum(list_transform(range(1, least(10, n) + 1),
    lambda r: p / n * (1 + (r - 1) * coalesce((p - 1) / nullif(n - 1, 0), 0)) / r)) / least(10, p) ELSE 0 END, 6) AS expected_ap
    FROM (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE grade >= 1) AS p FROM qrels GROUP BY query_id)""",
)
def random_precision(spark, sf):
    n = qrels(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("grade") >= 1, 1)).alias("p"))
    return n.select("query_id", F.round(S.random_precision(F.col("n"), F.col("p"), 10), 6).alias("expected_ap"))


@EVALUATION.add(
    "identity_means",
    """SELECT label, round(avg(a), 6) AS mean FROM (SELECT label, vec_id % 10 AS k, avg(embedding[1]::DOUBLE) AS a
    FROM embeddings GROUP BY ALL) GROUP BY label""",
)
def identity_means(spark, sf):
    first = F.get("embedding", F.lit(0)).cast("double")
    each = table(spark, sf, "embeddings").groupBy("label", (F.col("vec_id") % 10).alias("k")).agg(F.avg(first).alias("a"))
    return each.groupBy("label").agg(F.round(F.avg("a"), 6).alias("mean"))



