"""Queries of pictures, attributes, re-ranking with the graph and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ranklake.functions.urls import safe_link
from ranklake.operators import encoders, fusion, graph, lexical, pictures
from ranklake.operators.classify import classified, fit_text_classifier
from ranklake.operators.evaluation import roc_auc
from ranklake.operators.notices import tokens
from ranklake.operators.query_policy import Lexicon, evidence_label, normalised_queries
from ranklake.operators.splits import split_of
from ranklake.plans.registry import Registry, table
from ranklake.plans.retrieval import (
    _FUSED_SQL, _MATCH_SQL, _RRF_SQL, RETRIEVAL, _asked, _edges, _pool, _sql_top, kind_neighbours, reciprocal_ranks,
)
from ranklake.session import cut, small_side, stored

EXTRAS = Registry()

# Cues of pictures: components of the vectors stand for what a detector measures.
_CUES_SQL = """SELECT vec_id, abs(embedding[1]::DOUBLE) * 4 AS quality, embedding[2] > 0 AS detected, abs(embedding[3]::DOUBLE) * 3
  AS area, CASE WHEN abs(embedding[4]) > 0.05 THEN embedding[4] > 0 END AS centered, abs(embedding[5]::DOUBLE) * 5 AS confidence
  FROM embeddings"""


def _cues(spark, sf):
    v = lambda i: F.get("embedding", F.lit(i))
    size = lambda i, by: F.abs(v(i).cast("double")) * by
    return table(spark, sf, "embeddings").select(
        "vec_id", size(0, 4).alias("quality"), (v(1) > 0).alias("detected"), size(2, 3).alias("area"),
        F.when(F.abs(v(3).cast("double")) > 0.05, v(3) > 0).alias("centered"), size(4, 5).alias("confidence"),
    )


_AREA = """least(1.0, greatest(0.0, CASE WHEN area <= 0 THEN 0 WHEN area < 0.08 THEN 0.45 * area / 0.08 WHEN area <= 0.45
  THEN least(1.0, area / 0.28) ELSE greatest(0.55, 1 - (area - 0.45) / 0.55 * 0.35) END))"""
_VISUAL_SQL = f"""SELECT vec_id, round((0.42 * least(1, quality) + 0.18 * detected::INT + 0.18 * {_AREA} + coalesce(0.12 *
  CASE WHEN centered THEN 1 WHEN NOT centered THEN 0.35 END, 0) + 0.05 * least(1, confidence)) / (0.83 + CASE WHEN centered IS NULL
  THEN 0 ELSE 0.12 END), 6) AS visual, quality, area, confidence FROM ({_CUES_SQL.replace("embedding[4]) > 0.05", "embedding[4]::DOUBLE) > 0.05")})"""


@EXTRAS.add("visual_scores", f"SELECT vec_id, visual FROM ({_VISUAL_SQL})")
def visual_scores(spark, sf):
    names = ("quality", "detected", "area", "centered", "confidence")
    return _cues(spark, sf).select("vec_id", F.round(pictures.visual_score({n: F.col(n) for n in names}), 6).alias("visual"))


@EXTRAS.add(
    "picture_audit",
    f"""SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN quality < 0.5 THEN 'low_quality' END,
    CASE WHEN area < 0.08 THEN 'too_small' END, CASE WHEN area > 0.75 THEN 'too_large' END,
    CASE WHEN confidence < 0.25 THEN 'unsure' END], lambda x: x IS NOT NULL)) AS flag FROM ({_CUES_SQL})) GROUP BY flag""",
)
def picture_audit(spark, sf):
    flags = pictures.audit_flags(F.col("quality"), F.col("area"), F.col("confidence"))
    return _cues(spark, sf).select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@EXTRAS.add(
    "quality_bands",
    f"""SELECT CASE WHEN quality >= 0.72 THEN 'high' WHEN quality >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n
    FROM ({_CUES_SQL}) GROUP BY band""",
)
def quality_bands(spark, sf):
    band = pictures.quality_band(F.col("quality")).alias("band")
    return _cues(spark, sf).groupBy(band).agg(F.count(F.lit(1)).alias("n"))


@EXTRAS.add(
    "box_areas",
    """SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, l_discount * 10) - least(1, l_tax * 5)) *
    greatest(0, least(1, l_quantity / 50) - least(1, l_tax * 2)), 6) AS area FROM lineitem""",
)
def box_areas(spark, sf):
    box = F.array(F.col("l_tax") * 5, F.col("l_tax") * 2, F.col("l_discount") * 10, F.col("l_quantity") / 50)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(pictures.box_area(box), 6).alias("area"))


@EXTRAS.add("read_attributes")
def read_attributes(spark, sf):
    answer = F.concat(
        F.lit('Here: {"coat_color": ["'), F.lower("color"), F.lit('", "Brown"], "dog_count": "'), F.col("item_id").cast("string"),
        F.lit('", "face_visible": "yes", "photo_quality_score": "1.5", "evidence_ko": "a } b"} end'),
    )
    items = table(spark, sf, "notice_items").select("item_id", pictures.json_object(answer).alias("json"))
    a = pictures.attributes(F.col("json"))
    return items.select("item_id", F.array_join(a["coat_color"], ",").alias("colors"), a["dog_count"].alias("dog_count"), a["face_visible"].alias("face"), a["photo_quality_score"].alias("quality"))


@EXTRAS.add(
    "projected_vectors",
    """SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6)) AS projected FROM (SELECT vec_id,
    [embedding[1]::DOUBLE + embedding[2], embedding[3]::DOUBLE - embedding[4]::DOUBLE, 0.5 * embedding[5]::DOUBLE] AS v FROM embeddings)""",
)
def projected_vectors(spark, sf):
    matrix = [[0.0] * 64 for _ in range(3)]
    matrix[0][0] = matrix[0][1] = matrix[1][2] = 1.0
    matrix[1][3], matrix[2][4] = -1.0, 0.5
    p = table(spark, sf, "embeddings").select("vec_id", encoders.projected(F.col("embedding"), matrix).alias("p"))
    return p.select("vec_id", F.transform("p", lambda x: F.round(x, 6)).alias("projected"))


# Re-ranking with the graph: .18 of the score is graph, of that .7 match, .2 seed and .1 neighbours.

_POOL = _sql_top(_MATCH_SQL, "match", 20)
_NEIGHBOURS = RETRIEVAL.sql["graph_neighbours"]


@EXTRAS.add(
    "graph_rerank",
    f"""SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT p.query_id, p.doc_id, round(0.82 * (1 / (1 + p.rank)) + 0.18 * (0.7 * p.match + 0.2 * c.prior / m.most
      + 0.1 * coalesce(n.neighbour, 0)), 6) AS score FROM ({_POOL}) p JOIN ({_MATCH_SQL}) c USING (query_id, doc_id)
    JOIN (SELECT query_id, max(prior) AS most FROM ({_MATCH_SQL}) GROUP BY query_id) m ON m.query_id = p.query_id
    LEFT JOIN ({_NEIGHBOURS}) n ON n.query_id = p.query_id AND n.doc_id = p.doc_id)""",
)
def graph_rerank(spark, sf):
    """Scores depend on what is asked for only, so they are worked out once for all queries that ask for the same."""
    web = _edges(spark, sf)
    queries, pool = graph.best_matches(_asked(spark, sf), web, 20)
    rows = pool.join(kind_neighbours(pool, web), ["asked_kind", "doc_id"], "left")
    inner = 0.7 * F.col("match") + 0.2 * F.col("prior") / F.col("most") + 0.1 * F.coalesce("neighbour", F.lit(0.0))
    scored = rows.select("asked_kind", "doc_id", F.round(0.82 / (1 + F.col("rank")) + 0.18 * inner, 6).alias("score"))
    ranked = lexical.top_k(scored, "score", 20, query="asked_kind")
    return queries.join(ranked, "asked_kind").select("query_id", "doc_id", "score", "rank")


@EXTRAS.add(
    "pool_rerank",
    f"""SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (rank > 5)::INT, CASE WHEN rank <= 5 THEN
    -(0.5 * score + 0.5 * length(doc_id) / 100.0) ELSE rank END, doc_id) AS rank FROM ({_sql_top(_RRF_SQL, "score", 12)})""",
)
def pool_rerank(spark, sf):
    top = lexical.top_k(reciprocal_ranks(spark, sf), "score", 12)
    within = F.when(F.col("rank") <= 5, -(0.5 * F.col("score") + 0.5 * F.length("doc_id") / 100.0)).otherwise(F.col("rank").cast("double"))
    order = Window.partitionBy("query_id").orderBy((F.col("rank") > 5).cast("int"), within, "doc_id")
    return top.select("query_id", "doc_id", F.row_number().over(order).alias("rank"))


@EXTRAS.add(
    "weight_sensitivity",
    f"""SELECT a.query_id, count(*) FILTER (WHERE a.rank <> b.rank) AS n_moved FROM ({_sql_top(_FUSED_SQL, "score", 20)}) a
    JOIN ({_sql_top(_FUSED_SQL.replace("0.18 *", "0.30 *"), "score", 20)}) b USING (query_id, doc_id) GROUP BY a.query_id""",
)
def weight_sensitivity(spark, sf):
    """The same ranking under another weight of words: how many of the documents in both moved."""
    pool = cut(_pool(spark, sf))
    top = lambda weights=None: lexical.top_k(fusion.fused(pool, weights).withColumn("score", F.round("score", 6)), "score", 20)
    one = top().select("query_id", "doc_id", F.col("rank").alias("a"))
    two = top({"vector": 0.44, "bm25": 0.30})
    met = one.join(two.select("query_id", "doc_id", F.col("rank").alias("b")), ["query_id", "doc_id"])
    return met.groupBy("query_id").agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_moved"))


@EXTRAS.add(
    "label_agreement",
    """SELECT count(*) AS n, round(avg(len(list_intersect(a, b)) / len(list_distinct(a || b))), 6) AS mean_jaccard,
    round(avg((len(list_intersect(a, b)) > 0)::INT), 6) AS any_share FROM (SELECT query_id,
    list(DISTINCT notice_id) FILTER (WHERE grade >= 1) AS a, list(DISTINCT notice_id) FILTER (WHERE grade >= 2) AS b FROM qrels
    GROUP BY query_id) WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def label_agreement(spark, sf):
    """Labels of two thresholds: what has the higher one has the lower one too, so counts by query are enough."""
    each = table(spark, sf, "qrels").groupBy("query_id", "notice_id").agg(F.max("grade").alias("grade"))
    sets = each.groupBy("query_id").agg(
        F.count(F.when(F.col("grade") >= 1, 1)).alias("either"), F.count(F.when(F.col("grade") >= 2, 1)).alias("both")
    )
    return sets.where("both > 0").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("both") / F.col("either")), 6).alias("mean_jaccard"),
        F.round(F.avg((F.col("both") > 0).cast("int")), 6).alias("any_share"),
    )


@EXTRAS.add(
    "tfidf_terms",
    """WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[0-9A-Za-z가-힣]+'))) AS term FROM documents),
    n AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM n GROUP BY term
    HAVING count(*) >= 3), s AS (SELECT count(*) AS n FROM documents)
    SELECT doc_id, term, round((1 + ln(tf)) * (ln((1 + s.n) / (1 + df)) + 1), 6) AS weight FROM n JOIN d USING (term), s""",
)
def tfidf_terms(spark, sf):
    """Texts are read and counted once. Only the words' frequencies may be broadcast, never the lists: Spark guesses their
    size by the file of texts, which is far smaller."""
    docs = table(spark, sf, "documents")
    # All rows of a document meet before their words become rows, so texts are shuffled, not words. An outer explode, as
    # a plain one adds a filter that takes the words out of every text once more.
    words = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", F.explode_outer(tokens(F.col("text"))).alias("term"))
    lists = stored(words.where("term IS NOT NULL").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")), "lists")
    df = small_side(lists.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 3"))
    weight = (1 + F.log("tf")) * (F.log((1 + F.lit(docs.count())) / (1 + F.col("df"))) + 1)
    return lists.hint("merge").join(df, "term").select("doc_id", "term", F.round(weight, 6).alias("weight"))


# Queries, labels and classes of texts.

LEXICON = Lexicon(
    canonical=("small", "large", "red", "blue", "old", "new", "hot", "cold", "widget", "gear", "ring"),
    aliases={"tiny": "small", "big": "large"},
)


@EXTRAS.add(
    "canonical_words",
    """SELECT p_partkey, array_to_string(list_filter(['small', 'large', 'red', 'blue', 'old', 'new', 'hot', 'cold', 'widget', 'gear',
    'ring'], lambda w: list_contains(string_split(replace(p_name, ' rod', ' red'), ' '), w)), ' ') AS words FROM part""",
)
def canonical_words(spark, sf):
    queries = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query_text"))
    out = normalised_queries(queries, LEXICON)
    return out.select(F.col("query_id").alias("p_partkey"), F.array_join("canonical", " ").alias("words"))


@EXTRAS.add(
    "evidence_labels",
    """SELECT doc_id, CASE WHEN y AND NOT n THEN 1 WHEN n AND NOT y THEN -1 ELSE 0 END AS label FROM (SELECT doc_id,
    contains(text, '온순') OR contains(text, '사람을 잘 따름') AS y, contains(text, '겁이 많') OR contains(text, '예민함') AS n
    FROM documents)""",
)
def evidence_labels(spark, sf):
    label = evidence_label(F.col("text"), "온순|사람을 잘 따름", "겁이 많|예민함", window=0)
    return table(spark, sf, "documents").select("doc_id", label.alias("label"))


@EXTRAS.add("evidence_labels_negated")
def evidence_labels_negated(spark, sf):
    """With the operator's own window, so that a match negated further on does not count as asserted."""
    label = evidence_label(F.col("text"), "온순|사람을 잘 따름", "겁이 많|예민함")
    return table(spark, sf, "documents").select("doc_id", label.alias("label"))


@EXTRAS.add(
    "safe_links",
    """SELECT item_id, CASE WHEN regexp_matches(detail_url, '^https?://[^/?#@ ]+([/?#][^ ]*)?$') THEN detail_url END AS link
    FROM notice_items""",
)
def safe_links(spark, sf):
    return table(spark, sf, "notice_items").select("item_id", safe_link(F.col("detail_url")).alias("link"))


@EXTRAS.add("text_classifier")
def text_classifier(spark, sf):
    """Guide pages told from other texts: fitted on the training groups, AUC on all held-out ones."""
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("source") == "guide_page").cast("int").alias("label"))
    part = split_of(F.col("doc_id").cast("string"), "classifier")
    train, held = docs.where(part == "train"), docs.where(part != "train")
    if train.isEmpty():
        return spark.createDataFrame([], "axis string, auc double")
    scores = classified(fit_text_classifier(train, "doc_id", "text", "label"), held, "doc_id", "text")
    scored = scores.join(held, F.col("key") == F.col("doc_id")).select(F.lit("guide_page").alias("axis"), "label", "score")
    return roc_auc(scored, ["axis"])


@EXTRAS.add(
    "identity_precision",
    f"""SELECT label, count(*) AS n_queries, round(avg(p), 6) AS precision_10 FROM (SELECT n.query_id, a.label,
    count(*) FILTER (WHERE b.label = a.label) / 10 AS p FROM ({RETRIEVAL.sql["nearest_l2"]}) n JOIN embeddings a
    ON a.vec_id = n.query_id JOIN embeddings b ON b.vec_id = n.doc_id GROUP BY ALL) GROUP BY label""",
)
def identity_precision(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("found"))
    own = labels.select(F.col("doc_id").alias("query_id"), F.col("found").alias("label"))
    met = RETRIEVAL.plans["nearest_l2"](spark, sf).join(labels, "doc_id").join(own, "query_id")
    each = met.groupBy("query_id", "label").agg((F.count(F.when(F.col("found") == F.col("label"), 1)) / 10).alias("p"))
    return each.groupBy("label").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("p"), 6).alias("precision_10"))
