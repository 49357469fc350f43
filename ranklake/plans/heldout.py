"""Queries of held-out evaluation, retrieval by vectors in several ways, and checks of an index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ranklake.operators import evaluation as E
from ranklake.operators import fusion, lexical, vectors
from ranklake.operators import statistics as S
from ranklake.plans.evaluation import _JUDGED, _METRICS, _QRELS, _exact, qrels, ranking_metrics, system_metrics
from ranklake.plans.extras import EXTRAS
from ranklake.plans.registry import Registry, table
from ranklake.plans.retrieval import _L2, _RUN_SQL, RETRIEVAL, _gallery, _sql_near, _sql_top, _vector_queries, bm25_top, runs

HELDOUT = Registry()

# Where a target stands: the other vector of the lowest id with the query's label.

_TARGETS = """SELECT q.vec_id AS query_id, min(t.vec_id) AS target_id FROM embeddings q JOIN embeddings t ON t.label = q.label
  AND t.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id"""
_DOT2 = "round(list_inner_product(q.embedding::DOUBLE[], g.embedding::DOUBLE[]), 2)"
_RANKS = f"""SELECT query_id, target_id, 1 + count(*) FILTER (WHERE s > ts) + count(*) FILTER (WHERE s = ts) AS position,
  1 + count(*) FILTER (WHERE s > ts) AS strict_rank, 1 + count(*) FILTER (WHERE s > ts) +
  count(*) FILTER (WHERE s = ts AND doc_id < target_id) AS index_rank FROM (SELECT t.query_id, t.target_id, g.vec_id AS doc_id, {_DOT2} AS s,
  round(list_inner_product(q.embedding::DOUBLE[], x.embedding::DOUBLE[]), 2) AS ts FROM ({_TARGETS}) t JOIN embeddings q ON q.vec_id = t.query_id
  JOIN embeddings x ON x.vec_id = t.target_id JOIN embeddings g ON g.vec_id <> t.query_id) WHERE doc_id <> target_id GROUP BY ALL"""


def _target_ranks(spark, sf):
    e = table(spark, sf, "embeddings")
    # The two lowest ids of a label: one of them is not the query.
    two = Window.partitionBy("label").orderBy("vec_id")
    lowest = e.select("label", "vec_id", F.row_number().over(two).alias("n")).where("n <= 2").groupBy("label")
    lowest = lowest.agg(F.array_sort(F.collect_list("vec_id")).alias("low"))
    q = e.where("vec_id % 50 = 0").join(lowest, "label")
    target = F.get(F.filter("low", lambda x: x != F.col("vec_id")), F.lit(0))
    asked = q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), target.alias("target_id"))
    return vectors.target_ranks(asked, _gallery(spark, sf), 2)


@HELDOUT.add("target_ranks", _RANKS)
def target_ranks(spark, sf):
    return _target_ranks(spark, sf)


@HELDOUT.add(
    "heldout_metrics",
    f"""SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS attempted, count(*) AS evaluable,
    round(avg((position <= 1)::INT), 6) AS hit_1, round(avg((position <= 5)::INT), 6) AS hit_5, round(avg((position <= 10)::INT), 6) AS hit_10,
    round(avg(1 / position), 6) AS mrr, round(sum((position <= 10)::INT) / (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0), 6)
    AS attempted_hit_10, round(median(position), 3) AS median_rank, max(position) AS greatest_rank FROM ({_RANKS})""",
)
def heldout_metrics(spark, sf):
    """Means over what could be evaluated, and one over all that was attempted."""
    r = _target_ranks(spark, sf).withColumn("all", F.lit("all"))
    hit = lambda k: F.avg((F.col("position") <= k).cast("int"))
    tried = table(spark, sf, "embeddings").where("vec_id % 50 = 0").agg(F.count(F.lit(1)).alias("attempted"))
    out = r.agg(
        F.count(F.lit(1)).alias("evaluable"), *(F.round(hit(k), 6).alias(f"hit_{k}") for k in (1, 5, 10)),
        F.round(F.avg(1 / F.col("position")), 6).alias("mrr"), F.sum((F.col("position") <= 10).cast("int")).alias("h"),
        F.max("position").alias("greatest_rank"),
    )
    median = S.quantiles(r, ["all"], "position", [0.5]).agg(F.round(F.max("quantile"), 3).alias("median_rank"))
    one = out.join(F.broadcast(tried), F.lit(True)).join(F.broadcast(median), F.lit(True))
    return one.withColumn("attempted_hit_10", F.round(F.try_divide("h", "attempted"), 6)).drop("h")


_ELSEWHERE = """SELECT query_id, doc_id, rank, (b.label = a.label)::INT AS hit FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id AND b.vec_id % 7 <> a.vec_id % 7 WHERE a.vec_id % 50 = 0) JOIN embeddings a
  ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id WHERE rank <= 10"""


def _elsewhere(spark, sf):
    """The ten nearest of other sessions; the session is the id's remainder by 7."""
    session = lambda df, c: df.withColumn("session", (F.col(c) % 7).cast("string"))
    near = vectors.nearest(session(_vector_queries(spark, sf), "query_id"), session(_gallery(spark, sf), "doc_id"), 10, metric="ip", apart="session")
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    own = labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("own"))
    met = near.join(labels, "doc_id").join(own, "query_id")
    return met.select("query_id", "doc_id", "rank", (F.col("label") == F.col("own")).cast("int").alias("hit"))


@HELDOUT.add(
    "other_session_metrics",
    f"""SELECT query_id, max(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS hit_5, round(sum(CASE WHEN hit = 1 THEN h / rank ELSE 0 END) / greatest(1, sum(hit)), 6)
    AS ap, round(coalesce(1 / min(CASE WHEN hit = 1 THEN rank END), 0), 6) AS rr FROM (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank)
    AS h FROM ({_ELSEWHERE})) GROUP BY query_id""",
)
def other_session_metrics(spark, sf):
    so_far = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = _elsewhere(spark, sf).withColumn("h", so_far)
    return rows.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") <= 5, F.col("hit")).otherwise(0)).alias("hit_5"),
        F.round(F.sum(F.when(F.col("hit") == 1, F.col("h") / F.col("rank")).otherwise(0.0)) / F.greatest(F.lit(1), F.sum("hit")), 6).alias("ap"),
        F.round(F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("rr"),
    )


@HELDOUT.add(
    "attribute_ndcg",
    f"""SELECT query_id, round(CASE WHEN n > 0 THEN dcg / ideal END, 6) AS ndcg FROM (SELECT s.query_id, sum((b.label = a.label)::INT / log2(s.rank + 1))
    AS dcg, any_value(c.n - 1) AS n FROM ({_sql_near("list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", 10)}) s JOIN embeddings a
    ON a.vec_id = s.query_id JOIN embeddings b ON b.vec_id = s.doc_id JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c
    ON c.label = a.label GROUP BY s.query_id), (SELECT list_transform(range(0, 11), lambda k: list_sum(list_transform(range(1, k + 1),
    lambda r: 1 / log2(r + 1)))) AS i), LATERAL (SELECT i[1 + least(10, n)::INT] AS ideal)""",
)
def attribute_ndcg(spark, sf):
    """nDCG@10 of the nearest by equal label, the query's own vector left out; null if no other has its label."""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    n = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n"))
    own = labels.join(n, "label").select(F.col("doc_id").alias("query_id"), F.col("label").alias("own"), "n")
    near = vectors.nearest(_vector_queries(spark, sf), _gallery(spark, sf), 10, metric="ip").join(labels, "doc_id").join(own, "query_id")
    each = near.groupBy("query_id", "n").agg(F.sum((F.col("label") == F.col("own")).cast("int") / F.log2(F.col("rank") + 1)).alias("dcg"))
    terms = F.transform(F.sequence(F.lit(1), F.least(F.lit(10), F.greatest(F.lit(1), "n")).cast("int")), lambda r: 1 / F.log2(r + 1))
    ideal = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return each.select("query_id", F.round(F.when(F.col("n") > 0, F.col("dcg") / ideal), 6).alias("ndcg"))


@HELDOUT.add(
    "truncated_metrics",
    f"""SELECT j.system_id, j.query_id, round(h / least(5, n), 6) AS precision, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg,
    round(coalesce(1 / fst, 0), 6) AS rr FROM (SELECT system_id, query_id, count(*) AS n, coalesce(sum(hit) FILTER (WHERE rank <= 5), 0) AS h,
    coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (WHERE rank <= 5), 0) AS dcg, min(rank) FILTER (WHERE hit = 1 AND rank <= 5) AS fst
    FROM ({_JUDGED}) GROUP BY ALL) j LEFT JOIN (SELECT query_id, sum((pow(2, grade) - 1) / log2(p + 1)) AS ideal FROM (SELECT query_id, grade,
    row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS p FROM {_QRELS}) WHERE p <= 5 GROUP BY query_id) i
    ON i.query_id = j.query_id""",
)
def truncated_metrics(spark, sf):
    return E.truncated_metrics(runs(spark, sf), qrels(spark, sf), 5)


_BASE, _NEW = "bm25", "hybrid_graph"
_TOPS = f"""SELECT query_id, list(doc_id ORDER BY rank) FILTER (WHERE system_id = '{_BASE}') AS a,
  list(doc_id ORDER BY rank) FILTER (WHERE system_id = '{_NEW}') AS b FROM ({_RUN_SQL}) WHERE rank <= 10 GROUP BY query_id"""


@HELDOUT.add(
    "ranking_observations",
    f"""SELECT query_id, array_to_string(list_filter([CASE WHEN list_sort(a) <> list_sort(b) THEN 'membership' END, CASE WHEN list_sort(a) = list_sort(b)
    AND a <> b THEN 'order' END, CASE WHEN m.ndcg_5 < n.ndcg_5 THEN 'ndcg lower' END, CASE WHEN m.reciprocal_rank < n.reciprocal_rank THEN 'first later' END],
    lambda x: x IS NOT NULL), ',') AS tags FROM ({_TOPS}) t JOIN (SELECT * FROM ({_METRICS}) WHERE system_id = '{_NEW}') m USING (query_id)
    JOIN (SELECT * FROM ({_METRICS}) WHERE system_id = '{_BASE}') n USING (query_id) WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def ranking_observations(spark, sf):
    """What differs between a ranking and its baseline, as tags; the ten best of each are compared."""
    top = runs(spark, sf).where("rank <= 10")
    order = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("system_id") == s, F.struct("rank", "doc_id")))), lambda x: x["doc_id"])
    t = top.groupBy("query_id").agg(order(_BASE).alias("a"), order(_NEW).alias("b")).where("size(a) > 0 AND size(b) > 0")
    m = ranking_metrics(spark, sf)
    of = lambda s, p: m.where(F.col("system_id") == s).select("query_id", F.col("ndcg_5").alias(f"{p}_n"), F.col("reciprocal_rank").alias(f"{p}_r"))
    t = t.join(of(_NEW, "m"), "query_id").join(of(_BASE, "n"), "query_id")
    same = F.array_sort("a") == F.array_sort("b")
    tags = F.array(
        F.when(~same, "membership"), F.when(same & (F.col("a") != F.col("b")), "order"),
        F.when(F.col("m_n") < F.col("n_n"), "ndcg lower"), F.when(F.col("m_r") < F.col("n_r"), "first later"),
    )
    return t.select("query_id", F.array_join(F.filter(tags, lambda x: x.isNotNull()), ",").alias("tags"))


@HELDOUT.add(
    "chosen_system",
    f"""SELECT system_id, mrr, recall_10 FROM (SELECT *, max(recall_10) OVER () AS top FROM (SELECT system_id, {_exact("recall_10")} AS recall_10,
    {_exact("reciprocal_rank")} AS mrr FROM ({_METRICS}) GROUP BY system_id)) WHERE recall_10 >= top - 0.05 ORDER BY mrr DESC, recall_10 DESC, system_id LIMIT 1""",
)
def chosen_system(spark, sf):
    """The system of the best first hit among those that lose at most 0.05 of recall to the best; ties by recall, then name."""
    m = system_metrics(spark, sf).select("system_id", "mrr", "recall_10")
    ok = m.join(F.broadcast(m.agg(F.max("recall_10").alias("top"))), F.lit(True)).where("recall_10 >= top - 0.05")
    return ok.orderBy(F.desc("mrr"), F.desc("recall_10"), "system_id").limit(1).drop("top")


# Vectors in several ways.


@HELDOUT.add(
    "combined_vectors",
    """SELECT vec_id, list_transform(range(1, 65), lambda i: round(CASE WHEN im IS NOT NULL AND tx IS NOT NULL THEN 0.3 * e[i] + 0.1 * tx[i] + 0.6 * im[i]
    WHEN im IS NOT NULL THEN (0.3 * e[i] + 0.6 * im[i]) / 0.9 WHEN tx IS NOT NULL THEN 0.7 * e[i] + 0.3 * tx[i] ELSE e[i] END, 6)) AS combined FROM (
    SELECT a.vec_id, a.embedding::DOUBLE[] AS e, t.embedding::DOUBLE[] AS tx, i.embedding::DOUBLE[] AS im FROM embeddings a LEFT JOIN embeddings t
    ON t.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0 LEFT JOIN embeddings i ON i.vec_id = a.vec_id + 2 AND a.vec_id % 3 = 0)""",
)
def combined_vectors(spark, sf):
    """The mean of a survey's, a text's and a picture's vector; other weights where there is no picture."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    t = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("tx")).where("vec_id % 2 = 0")
    i = e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("e").alias("im")).where("vec_id % 3 = 0")
    rows = e.join(t, "vec_id", "left").join(i, "vec_id", "left")
    seen = vectors.weighted_mean({"survey": (F.col("e"), 0.3), "text": (F.col("tx"), 0.1), "picture": (F.col("im"), 0.6)})
    read = vectors.weighted_mean({"survey": (F.col("e"), 0.7), "text": (F.col("tx"), 0.3)})
    mean = F.when(F.col("im").isNotNull(), seen).otherwise(read)
    return rows.select("vec_id", F.transform(mean, lambda x: F.round(x, 6)).alias("combined"))


_I, _T = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "list_inner_product(c.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_IT = "list_inner_product(a.embedding::DOUBLE[], c.embedding::DOUBLE[])"


@HELDOUT.add(
    "composed_scores",
    f"""SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(im, 6) AS image, round(tx, 6) AS text, round(0.6 * im + 0.4 * tx, 6) AS late,
    round((im + tx) / sqrt(2 + 2 * it), 6) AS composed, round((im + 0.5 * tx) / sqrt(1.25 + it), 6) AS residual FROM (SELECT a, b, {_I} AS im, {_T} AS tx,
    {_IT} AS it FROM embeddings a JOIN embeddings c ON c.vec_id = a.vec_id + 1 JOIN ({_sql_near(f"1 / (1 + {_L2} * {_L2})", 10)}) n ON n.query_id = a.vec_id
    JOIN embeddings b ON b.vec_id = n.doc_id)""",
)
def composed_scores(spark, sf):
    """Five ways to score a picture and a text together, for the ten nearest of each query: picture, text, both scores
    mixed, the vectors added, and the picture with half of the text; unit vectors are taken for granted."""
    near = RETRIEVAL.plans["nearest_l2"](spark, sf).select("query_id", "doc_id")
    e = table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a"))
    c = e.select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("c"))
    b = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("b"))
    rows = near.join(a, "query_id").join(c, "query_id").join(b, "doc_id")
    rows = rows.select("query_id", "doc_id", *(vectors.dot(F.col(x), F.col(y)).alias(n) for n, x, y in (("im", "a", "b"), ("tx", "c", "b"), ("it", "a", "c"))))
    im, tx, it = F.col("im"), F.col("tx"), F.col("it")
    ways = {
        "image": im, "text": tx, "late": 0.6 * im + 0.4 * tx, "composed": (im + tx) / F.sqrt(2 + 2 * it),
        "residual": (im + 0.5 * tx) / F.sqrt(1.25 + it),
    }
    return rows.select("query_id", "doc_id", *(F.round(v, 6).alias(k) for k, v in ways.items()))


_LABELLED = EXTRAS.sql["evidence_labels"]
_CONSERVATIVE = f"""SELECT doc_id, CASE WHEN label = 1 THEN 1.0 WHEN label = -1 THEN 0.0 ELSE 0.5 + 0.2 * (2 * least(1, greatest(0, p)) - 1) END AS behavior
  FROM (SELECT l.doc_id, l.label, coalesce(nullif(n_chars, 0) % 100 / 100.0, 0) AS p FROM ({_LABELLED}) l JOIN documents USING (doc_id))"""


def _conservative(spark, sf):
    p = F.coalesce(F.nullif("n_chars", F.lit(0)) % 100 / 100.0, F.lit(0.0))
    docs = table(spark, sf, "documents").select("doc_id", p.alias("p"))
    rows = EXTRAS.plans["evidence_labels"](spark, sf).join(docs, "doc_id")
    return rows.select("doc_id", fusion.conservative(F.col("p"), F.col("label")).alias("behavior"))


@HELDOUT.add("conservative_scores", f"SELECT doc_id, round(behavior, 6) AS behavior FROM ({_CONSERVATIVE})")
def conservative_scores(spark, sf):
    return _conservative(spark, sf).withColumn("behavior", F.round("behavior", 6))


_SCAN = f"""SELECT query_id, doc_id % 200 AS doc_id, max(score) AS score FROM ({_sql_near("list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", 60)})
  GROUP BY ALL"""


@HELDOUT.add(
    "visual_behavior_fusion",
    _sql_top(
        f"""SELECT query_id, doc_id, round(0.7 * place + 0.3 * coalesce(behavior, 0.5), 6) AS score FROM (SELECT query_id, doc_id,
        (row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) - 1) / greatest(1, count(*) OVER (PARTITION BY query_id) - 1) AS place
        FROM ({_SCAN})) LEFT JOIN ({_CONSERVATIVE}) USING (doc_id)""", "score", 10,
    ),
)
def visual_behavior_fusion(spark, sf):
    """Inner products, the best hit of each notice, its place among all, and the behaviour blended in."""
    near = vectors.nearest(_vector_queries(spark, sf), _gallery(spark, sf), 60, metric="ip").withColumn("score", F.round("score", 6))
    best = near.groupBy("query_id", (F.col("doc_id") % 200).alias("doc_id")).agg(F.max("score").alias("score"))
    placed = fusion.place_scores(best, "score", "doc_id", ["query_id"]).join(_conservative(spark, sf), "doc_id", "left")
    score = F.round(0.7 * F.col("place_score") + 0.3 * F.coalesce("behavior", F.lit(0.5)), 6)
    return lexical.top_k(placed.select("query_id", "doc_id", score.alias("score")), "score", 10)


_NEAR10, _WORDS10 = RETRIEVAL.sql["nearest_l2"], RETRIEVAL.sql["bm25_top"]


@HELDOUT.add(
    "side_by_side",
    f"""SELECT query_id, doc_id, max(CASE WHEN s = 'image' THEN rank END) AS image_rank, max(CASE WHEN s = 'text' THEN rank END) AS text_rank,
    round(sum(1 / (60 + rank)), 8) AS score FROM (SELECT 'image' AS s, query_id, doc_id, rank FROM ({_NEAR10}) UNION ALL SELECT 'text', query_id, doc_id, rank
    FROM ({_WORDS10})) GROUP BY ALL""",
)
def side_by_side(spark, sf):
    """Rankings by picture and by words next to each other, with the sum of their reciprocal ranks."""
    one = RETRIEVAL.plans["nearest_l2"](spark, sf).select(F.lit("image").alias("s"), "query_id", "doc_id", "rank")
    both = one.unionByName(bm25_top(spark, sf).select(F.lit("text").alias("s"), "query_id", "doc_id", "rank"))
    at = lambda s: F.max(F.when(F.col("s") == s, F.col("rank")))
    return both.groupBy("query_id", "doc_id").agg(
        at("image").alias("image_rank"), at("text").alias("text_rank"), F.round(F.sum(1 / (60 + F.col("rank"))), 8).alias("score")
    )


@HELDOUT.add(
    "axis_means",
    """SELECT query_id, notice_id AS doc_id, count(DISTINCT system_id) AS n_axes, round(avg(s), 6) AS mean_score FROM (SELECT query_id, notice_id, system_id,
    max(score) FILTER (WHERE NOT isnan(score)) AS s FROM ranking_run GROUP BY ALL) WHERE s IS NOT NULL GROUP BY ALL""",
)
def axis_means(spark, sf):
    each = table(spark, sf, "ranking_run").where("score IS NOT NULL AND NOT isnan(score)").groupBy("query_id", "notice_id", "system_id").agg(F.max("score").alias("s"))
    return each.groupBy("query_id", F.col("notice_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_axes"), F.round(F.avg("s"), 6).alias("mean_score"))


# Records made by position, and the state of an index.

_REASON = "CASE WHEN t.vec_id IS NULL THEN 'no source row' WHEN d.doc_id % 10 = 0 THEN 'held out' WHEN d.lang IS NULL THEN 'no attribute' ELSE 'kept' END"


@HELDOUT.add(
    "record_exclusions",
    f"SELECT {_REASON} AS reason, count(*) AS n FROM documents d LEFT JOIN embeddings t ON t.vec_id = d.doc_id GROUP BY reason",
)
def record_exclusions(spark, sf):
    """Documents with the vector of the same position; every tenth is held out; why a record is left out is counted."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    rows = d.join(table(spark, sf, "embeddings").select("vec_id"), F.col("vec_id") == F.col("doc_id"), "left")
    reason = F.when(F.col("vec_id").isNull(), "no source row").when(F.col("doc_id") % 10 == 0, "held out").when(F.col("lang").isNull(), "no attribute").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_ROWS = """SELECT vec_id, vec_id % 100 AS notice, CASE vec_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'full_image' WHEN 2 THEN 'crop_image' ELSE 'other' END AS modality
  FROM embeddings"""


def _index_rows(spark, sf):
    k = F.col("vec_id") % 4
    modality = F.when(k == 0, "text").when(k == 1, "full_image").when(k == 2, "crop_image").otherwise("other")
    return table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 100).alias("notice"), modality.alias("modality"))


@HELDOUT.add("visual_rows", f"SELECT vec_id, notice, modality FROM ({_ROWS}) WHERE modality IN ('full_image', 'crop_image') ORDER BY vec_id LIMIT 60")
def visual_rows(spark, sf):
    """The first sixty rows of wanted modalities; the limit is the operator's."""
    return _index_rows(spark, sf).where(F.col("modality").isin("full_image", "crop_image")).orderBy("vec_id").limit(60)


@HELDOUT.add(
    "index_contract",
    f"""SELECT count(*) AS n_rows, count(DISTINCT notice) AS n_notices, count(*) FILTER (WHERE modality = 'text') AS n_text, count(*) FILTER (WHERE modality IN
    ('full_image', 'crop_image')) AS n_visual, count(*) FILTER (WHERE modality = 'other') AS n_unknown, (SELECT count(DISTINCT notice) FROM ({_ROWS}) WHERE notice
    NOT IN (SELECT notice FROM ({_ROWS}) WHERE modality = 'text')) AS n_without_text FROM ({_ROWS})""",
)
def index_contract(spark, sf):
    """Rows by kind, and the notices that have no text row."""
    rows = _index_rows(spark, sf)
    by = rows.groupBy("notice").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(c, 1)).alias(k) for k, c in {
        "text": F.col("modality") == "text", "visual": F.col("modality").isin("full_image", "crop_image"), "other": F.col("modality") == "other",
    }.items()))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by.agg(
        total("n").alias("n_rows"), F.count(F.lit(1)).alias("n_notices"), total("text").alias("n_text"), total("visual").alias("n_visual"),
        total("other").alias("n_unknown"), F.count(F.when(F.col("text") == 0, 1)).alias("n_without_text"),
    )
