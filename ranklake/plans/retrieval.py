"""Queries of retrieval: BM25, nearest neighbours, graph, fusion. The queries are profiles, documents or vectors whose
id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklake.functions import vocabulary as V
from ranklake.operators import fusion, graph, lexical, vectors
from ranklake.plans.notices import SQL_TYPED, typed
from ranklake.plans.registry import Registry, table
from ranklake.session import small_side

RETRIEVAL = Registry()

# Texts of queries: what a profile prefers, in words of the documents.
_QUERY_SQL = """SELECT DISTINCT profile_id AS query_id, concat_ws(' ', preferred_region, '산책', '접종', '사람',
  CASE preferred_size WHEN 'small' THEN '작은 아이' WHEN 'large' THEN '큰 개' END,
  CASE preferred_age WHEN 'puppy' THEN '개월' WHEN 'senior' THEN '노령' END) AS query_text
  FROM appearance_profiles WHERE profile_id % 50 = 0"""


def profile_queries(spark, sf):
    p = table(spark, sf, "appearance_profiles").where("profile_id % 50 = 0")
    size = F.when(F.col("preferred_size") == "small", "작은 아이").when(F.col("preferred_size") == "large", "큰 개")
    age = F.when(F.col("preferred_age") == "puppy", "개월").when(F.col("preferred_age") == "senior", "노령")
    words = [F.lit("산책"), F.lit("접종"), F.lit("사람")]
    text = F.concat_ws(" ", F.col("preferred_region"), *words, size, age)
    return p.select(F.col("profile_id").alias("query_id"), text.alias("query_text")).distinct()


_POSTINGS_SQL = """SELECT doc_id, len(w) AS doc_length, term, count(*) AS tf FROM (SELECT doc_id, w, lower(unnest(w)) AS term
  FROM (SELECT doc_id, regexp_extract_all(text, '[0-9A-Za-z가-힣]+') AS w FROM documents)) GROUP BY ALL"""
_BM25_SQL = f"""SELECT q.query_id, p.doc_id, sum(q.qf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.5
    / (p.tf + 1.5 * (0.25 + 0.75 * p.doc_length / s.m))) AS bm25
  FROM (SELECT query_id, lower(term) AS term, count(*) AS qf FROM (SELECT query_id,
      unnest(regexp_extract_all(query_text, '[0-9A-Za-z가-힣]+')) AS term FROM ({_QUERY_SQL})) GROUP BY ALL) q
  JOIN ({_POSTINGS_SQL}) p ON p.term = q.term
  JOIN (SELECT term, count(*) AS df FROM ({_POSTINGS_SQL}) GROUP BY term) d ON d.term = q.term,
  (SELECT count(*) AS n, avg(len(regexp_extract_all(text, '[0-9A-Za-z가-힣]+'))) AS m FROM documents) s
  GROUP BY ALL"""


@RETRIEVAL.add("postings", _POSTINGS_SQL)
def postings(spark, sf):
    return lexical.postings(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))


@RETRIEVAL.add("document_frequency", f"SELECT term, count(*) AS df FROM ({_POSTINGS_SQL}) GROUP BY term")
def document_frequency(spark, sf):
    return postings(spark, sf).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _bm25(spark, sf):
    return lexical.bm25(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), profile_queries(spark, sf))


@RETRIEVAL.add("bm25_scores", f"SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM ({_BM25_SQL})")
def bm25_scores(spark, sf):
    return _bm25(spark, sf).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))


def bm25_best(spark, sf, k: int):
    """The k best documents of each query by rounded BM25."""
    return lexical.bm25_top(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), profile_queries(spark, sf), k)


def _sql_top(sql: str, by: str, k: int) -> str:
    return f"""SELECT query_id, doc_id, {by}, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY {by} DESC, doc_id) AS rank FROM ({sql})) WHERE rank <= {k}"""


_ROUNDED_BM25 = f"SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM ({_BM25_SQL})"


@RETRIEVAL.add("bm25_top", _sql_top(_ROUNDED_BM25, "bm25", 10))
def bm25_top(spark, sf):
    return bm25_best(spark, sf, 10)


# Vectors.

_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_L2 = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@RETRIEVAL.add(
    "vector_quality",
    """SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_size,
    count(*) FILTER (WHERE abs(nrm - 1) > 0.05) AS off_norm, round(min(nrm), 6) AS least_norm,
    round(avg(nrm), 6) AS mean_norm, round(max(nrm), 6) AS greatest_norm FROM (SELECT embedding,
    sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM embeddings)""",
)
def vector_quality(spark, sf):
    v = table(spark, sf, "embeddings").select("embedding", vectors.norm(F.col("embedding")).alias("nrm"))
    return v.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.size("embedding") != 64, 1)).alias("wrong_size"),
        F.count(F.when(F.abs(F.col("nrm") - 1) > 0.05, 1)).alias("off_norm"),
        F.round(F.min("nrm"), 6).alias("least_norm"),
        F.round(F.avg("nrm"), 6).alias("mean_norm"),
        F.round(F.max("nrm"), 6).alias("greatest_norm"),
    )


@RETRIEVAL.add(
    "unit_vectors",
    """SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / nrm, 6)) AS unit FROM (SELECT vec_id, embedding,
    sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM embeddings)""",
)
def unit_vectors(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("unit"))
    return v.select("vec_id", F.transform("unit", lambda x: F.round(x, 6)).alias("unit"))


def _vector_queries(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _gallery(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _sql_near(score: str, k: int) -> str:
    return f"""SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query_id,
      b.vec_id AS doc_id, {score} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {score} DESC, b.vec_id) AS rank
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= {k}"""


@RETRIEVAL.add("nearest_l2", _sql_near(f"1 / (1 + {_L2} * {_L2})", 10))
def nearest_l2(spark, sf):
    near = vectors.nearest(_vector_queries(spark, sf), _gallery(spark, sf), 10)
    return near.withColumn("score", F.round("score", 6))


@RETRIEVAL.add("nearest_dot", _sql_near(_DOT, 10))
def nearest_dot(spark, sf):
    near = vectors.nearest(_vector_queries(spark, sf), _gallery(spark, sf), 10, metric="ip")
    return near.withColumn("score", F.round("score", 6))


_HITS_SQL = f"""SELECT query_id, doc_id % 100 AS doc_id, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'full_image'
  WHEN 2 THEN 'crop_image' ELSE 'other' END AS modality, score FROM ({_sql_near(f"1 / (1 + {_L2} * {_L2})", 60)})"""


def _hits(spark, sf):
    near = vectors.nearest(_vector_queries(spark, sf), _gallery(spark, sf), 60)
    kind = F.col("doc_id") % 4
    modality = F.when(kind == 0, "text").when(kind == 1, "full_image").when(kind == 2, "crop_image").otherwise("other")
    return near.select("query_id", (F.col("doc_id") % 100).alias("doc_id"), modality.alias("modality"), F.round("score", 6).alias("score"))


_BEST_SQL = f"SELECT query_id, doc_id, modality, max(score) AS score, count(*) AS n_hits FROM ({_HITS_SQL}) GROUP BY ALL"


@RETRIEVAL.add("modality_best", _BEST_SQL)
def modality_best(spark, sf):
    return vectors.best_by_modality(_hits(spark, sf))


_W = "CASE modality " + " ".join(f"WHEN '{m}' THEN {w}" for m, w in V.MODALITY_WEIGHTS.items()) + " ELSE 0 END"


@RETRIEVAL.add(
    "modality_mean",
    f"""SELECT query_id, doc_id, round(coalesce(sum({_W} * score) / nullif(sum({_W}), 0), 0), 6) AS score,
    3 - count(*) FILTER (WHERE modality <> 'other') AS n_missing FROM ({_BEST_SQL}) GROUP BY query_id, doc_id""",
)
def modality_mean(spark, sf):
    mean = vectors.available_mean(modality_best(spark, sf))
    return mean.select(
        "query_id", "doc_id", F.round("score", 6).alias("score"), F.size("missing").cast("long").alias("n_missing")
    )


@RETRIEVAL.add(
    "blended_vectors",
    """SELECT a.vec_id, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6)) AS blended FROM (
      SELECT a.vec_id, list_transform(range(1, 65), lambda i: 0.8 * a.embedding[i]::DOUBLE + 0.2 * b.embedding[i]::DOUBLE)
      AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a""",
)
def blended_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mixed = e.join(b, "vec_id").select("vec_id", vectors.blend(F.col("embedding"), F.col("other"), 0.2).alias("v"))
    return mixed.select("vec_id", F.transform("v", lambda x: F.round(x, 6)).alias("blended"))


# Graph: features of items and what profiles ask for.

_EDGES_SQL = f"""SELECT DISTINCT item_id AS doc_id, f AS feature, CASE split_part(f, ':', 1) {
    " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.FEATURE_WEIGHTS.items())
} ELSE {V.OTHER_FEATURE_WEIGHT} END AS weight FROM (SELECT item_id, unnest(list_filter([
  'trait:body_size:' || lower(size), 'age:' || lower(nullif(age_group, '')), 'sex:' || lower(sex),
  'neuter:' || CASE WHEN neutered THEN 'true' WHEN NOT neutered THEN 'false' END, 'breed:name:' || lower(breed),
  'shelter:' || lower(care_name), 'status:' || lower(status)], lambda x: x IS NOT NULL)) AS f FROM ({SQL_TYPED}))"""


def _edges(spark, sf):
    features = {
        "trait:body_size": F.col("size"), "age": F.col("age_group"), "sex": F.col("sex"), "neuter": F.col("neutered"),
        "breed:name": F.col("breed"), "shelter": F.col("care_name"), "status": F.col("status"),
    }
    return graph.edges(typed(spark, sf), F.col("item_id"), features)


_ASKED_SQL = """SELECT DISTINCT query_id, f AS feature FROM (SELECT profile_id AS query_id, unnest(list_filter([
  CASE WHEN preferred_size <> 'any' THEN 'trait:body_size:' || preferred_size END,
  CASE WHEN preferred_age <> 'any' THEN 'age:' || preferred_age END, 'status:active'], lambda x: x IS NOT NULL)) AS f
  FROM appearance_profiles WHERE profile_id % 50 = 0)"""


def _asked(spark, sf):
    p = table(spark, sf, "appearance_profiles").where("profile_id % 50 = 0")
    wanted = F.array(
        F.when(F.col("preferred_size") != "any", F.concat(F.lit("trait:body_size:"), "preferred_size")),
        F.when(F.col("preferred_age") != "any", F.concat(F.lit("age:"), "preferred_age")),
        F.lit("status:active"),
    )
    f = F.explode(F.filter(wanted, lambda x: x.isNotNull())).alias("feature")
    return p.select(F.col("profile_id").alias("query_id"), f).distinct()


@RETRIEVAL.add("feature_edges", _EDGES_SQL)
def feature_edges(spark, sf):
    return _edges(spark, sf)


@RETRIEVAL.add(
    "graph_summary",
    f"""SELECT s AS status, count(DISTINCT doc_id) AS n_docs, count(DISTINCT feature) AS n_features, count(*) AS n_edges,
    round(count(*) / count(DISTINCT doc_id), 2) AS mean_edges,
    count(DISTINCT feature) FILTER (WHERE starts_with(feature, 'shelter:')) AS n_shelters
    FROM ({_EDGES_SQL}) JOIN (SELECT item_id, status AS s FROM ({SQL_TYPED})) ON item_id = doc_id GROUP BY s""",
)
def graph_summary(spark, sf):
    status = typed(spark, sf).select(F.col("item_id").alias("doc_id"), "status")
    e = _edges(spark, sf).join(status, "doc_id")
    shelter = F.when(F.col("feature").startswith("shelter:"), F.col("feature"))
    out = e.groupBy("status").agg(
        F.countDistinct("doc_id").alias("n_docs"),
        F.countDistinct("feature").alias("n_features"),
        F.count(F.lit(1)).alias("n_edges"),
        F.countDistinct(shelter).alias("n_shelters"),
    )
    return out.withColumn("mean_edges", F.round(F.col("n_edges") / F.col("n_docs"), 2))


@RETRIEVAL.add(
    "graph_top_features",
    f"""SELECT feature, n, rank FROM (SELECT feature, n, row_number() OVER (ORDER BY n DESC, feature) AS rank FROM (
    SELECT feature, count(*) AS n FROM ({_EDGES_SQL}) GROUP BY feature)) WHERE rank <= 12""",
)
def graph_top_features(spark, sf):
    counts = _edges(spark, sf).groupBy("feature").agg(F.count(F.lit(1)).alias("n")).withColumn("query_id", F.lit(0))
    return lexical.top_k(counts, "n", 12, key="feature").select("feature", "n", "rank")


_MATCH_SQL = f"""SELECT query_id, doc_id, round(prior, 6) AS prior, round(least(1, prior / total), 6) AS match FROM (
  SELECT a.query_id, e.doc_id, sum(e.weight) AS prior FROM ({_ASKED_SQL}) a JOIN ({_EDGES_SQL}) e USING (feature) GROUP BY ALL)
  JOIN (SELECT query_id, sum(CASE split_part(feature, ':', 1) {
    " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.FEATURE_WEIGHTS.items())
} ELSE {V.OTHER_FEATURE_WEIGHT} END) AS total FROM ({_ASKED_SQL}) GROUP BY query_id) USING (query_id)"""


@RETRIEVAL.add("graph_candidates", _MATCH_SQL)
def graph_candidates(spark, sf):
    found = graph.candidates(_asked(spark, sf), _edges(spark, sf))
    return found.select("query_id", "doc_id", F.round("prior", 6).alias("prior"), F.round("match", 6).alias("match"))


_POOL_SQL = _sql_top(_MATCH_SQL, "match", 20)


@RETRIEVAL.add(
    "graph_neighbours",
    f"""WITH e AS (SELECT * FROM ({_EDGES_SQL}) WHERE NOT starts_with(feature, 'breed:')),
    o AS (SELECT doc_id, sum(weight) AS own FROM e GROUP BY doc_id), p AS ({_POOL_SQL}),
    s AS (SELECT p.query_id, p.doc_id, t.doc_id AS seed_id, sum(e.weight) AS shared FROM p JOIN p t ON t.query_id = p.query_id
      AND t.rank <= 8 AND t.doc_id <> p.doc_id JOIN e ON e.doc_id = p.doc_id JOIN e f ON f.doc_id = t.doc_id
      AND f.feature = e.feature GROUP BY ALL)
    SELECT query_id, s.doc_id, round(least(1, max(shared / (o.own + q.own - shared))), 6) AS neighbour
    FROM s JOIN o ON o.doc_id = s.doc_id JOIN o q ON q.doc_id = seed_id GROUP BY ALL""",
)
def graph_neighbours(spark, sf):
    web = _edges(spark, sf)
    queries, pool = graph.best_matches(_asked(spark, sf), web, 20)
    return queries.join(kind_neighbours(pool, web), "asked_kind").select("query_id", "doc_id", "neighbour")


def kind_neighbours(pool, web):
    """``asked_kind, doc_id, neighbour`` of the best documents of each kind of query."""
    pool = pool.withColumnRenamed("asked_kind", "query_id")
    seeds = pool.where("rank <= 8").select("query_id", F.col("doc_id").alias("seed_id"))
    near = graph.neighbours(pool.select("query_id", "doc_id"), seeds, web)
    return near.select(F.col("query_id").alias("asked_kind"), "doc_id", F.round("neighbour", 6).alias("neighbour"))


# Fusion.

_VEC_SQL = f"""SELECT p.query_id, b.vec_id AS doc_id, 1 / (1 + {_L2} * {_L2}) AS score FROM (SELECT DISTINCT
  profile_id AS query_id FROM appearance_profiles WHERE profile_id % 50 = 0) p JOIN embeddings a ON a.vec_id = p.query_id
  JOIN embeddings b ON b.vec_id <> a.vec_id"""
_FUSED_SQL = f"""WITH b AS ({_sql_top(_ROUNDED_BM25, "bm25", 50)}), v AS ({
    _sql_top(f"SELECT query_id, doc_id, round(score, 6) AS score FROM ({_VEC_SQL})", "score", 50)
}), u AS (SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.doc_id, v.doc_id) AS doc_id,
    coalesce(score, 0) AS vector, coalesce(bm25, 0) AS bm25 FROM b FULL JOIN v ON b.query_id = v.query_id AND b.doc_id = v.doc_id)
  SELECT query_id, doc_id, round(0.44 * vector + 0.18 * coalesce(bm25 / nullif(max(bm25) OVER (PARTITION BY query_id), 0), 0), 6)
  AS score FROM u"""


def _pool(spark, sf):
    """What words and vectors find for each query, with both scores."""
    words = bm25_best(spark, sf, 50).select("query_id", "doc_id", "bm25")
    asked = profile_queries(spark, sf).select(F.col("query_id").alias("doc_id"))
    wanted = _gallery(spark, sf).join(asked, "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "vector")
    near = vectors.nearest(wanted, _gallery(spark, sf), 50, decimals=6).select("query_id", "doc_id", F.col("score").alias("vector"))
    return fusion.candidate_union({"vector": near, "bm25": words})


def _fused(spark, sf):
    return fusion.fused(_pool(spark, sf)).withColumn("score", F.round("score", 6))


@RETRIEVAL.add("vector_word_top", _sql_top(_FUSED_SQL, "score", 10))
def vector_word_top(spark, sf):
    """Words and vectors of every query against all documents, fused, the ten best of each."""
    return lexical.top_k(_fused(spark, sf), "score", 10)


@RETRIEVAL.add("candidate_union", f"SELECT query_id, count(*) AS n_candidates FROM ({_FUSED_SQL}) GROUP BY query_id")
def candidate_union(spark, sf):
    return _pool(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"))


_RUN_SQL = """SELECT system_id, query_id, notice_id AS doc_id, row_number() OVER (PARTITION BY system_id, query_id
  ORDER BY min(rank_pos), notice_id) AS rank FROM ranking_run GROUP BY system_id, query_id, notice_id"""


def runs(spark, sf):
    r = table(spark, sf, "ranking_run")
    return fusion.first_ranks(r.select("system_id", "query_id", F.col("notice_id").alias("doc_id"), F.col("rank_pos").alias("rank")))


@RETRIEVAL.add("first_ranks", _RUN_SQL)
def first_ranks(spark, sf):
    return runs(spark, sf)


_RRF_SQL = f"SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 8) AS score FROM ({_RUN_SQL}) GROUP BY ALL"


@RETRIEVAL.add("reciprocal_ranks", _RRF_SQL)
def reciprocal_ranks(spark, sf):
    return fusion.reciprocal_ranks(runs(spark, sf)).withColumn("score", F.round("score", 8))


@RETRIEVAL.add(
    "place_scores",
    """SELECT system_id, query_id, doc_id, round((row_number() OVER (PARTITION BY system_id, query_id ORDER BY s, doc_id) - 1)
    / greatest(1, count(*) OVER (PARTITION BY system_id, query_id) - 1), 6) AS place_score FROM (
    SELECT system_id, query_id, notice_id AS doc_id, coalesce(max(score) FILTER (WHERE NOT isnan(score)), 0) AS s FROM ranking_run
    GROUP BY ALL)""",
)
def place_scores(spark, sf):
    best = table(spark, sf, "ranking_run").groupBy("system_id", "query_id", F.col("notice_id").alias("doc_id"))
    best = best.agg(F.coalesce(F.max(F.when(~F.isnan("score"), F.col("score"))), F.lit(0.0)).alias("s"))
    placed = fusion.place_scores(best, "s", "doc_id", ["system_id", "query_id"])
    return placed.select("system_id", "query_id", "doc_id", F.round("place_score", 6).alias("place_score"))


_CAND_SQL = f"""SELECT m.query_id, m.doc_id, m.match AS score, p.preferred_size, p.preferred_age, t.size, t.age_group, t.neutered
  FROM ({_POOL_SQL}) m JOIN (SELECT DISTINCT profile_id, preferred_size, preferred_age FROM appearance_profiles) p
  ON p.profile_id = m.query_id JOIN ({SQL_TYPED}) t ON t.item_id = m.doc_id"""


def _conditions():
    size, age = F.col("preferred_size"), F.col("preferred_age")
    return [
        (size != "any", F.when(F.col("size").isNotNull(), F.col("size") == size)),
        (age != "any", F.when(F.col("age_group") != "", F.col("age_group") == age)),
    ]


def _candidates(spark, sf):
    queries, best = graph.best_matches(_asked(spark, sf), _edges(spark, sf), 20)
    # The facts of the few documents that are among the best of a kind.
    met = small_side(best.select("doc_id").distinct())
    profiles = table(spark, sf, "appearance_profiles").select(F.col("profile_id").alias("query_id"), "preferred_size", "preferred_age").distinct()
    facts = typed(spark, sf).select(F.col("item_id").alias("doc_id"), "size", "age_group", "neutered")
    best = best.select("asked_kind", "doc_id", F.col("match").alias("score")).join(facts.join(met, "doc_id", "left_semi"), "doc_id")
    return queries.join(best, "asked_kind").drop("asked_kind").join(profiles, "query_id")


_MET = "CASE WHEN {a} = 'any' THEN 0 WHEN {k} THEN {u} WHEN {x} = {a} THEN 1 ELSE 0 END"
_S = dict(a="preferred_size", k="size IS NULL", x="size")
_A = dict(a="preferred_age", k="age_group = ''", x="age_group")
_N = "((preferred_size <> 'any')::INT + (preferred_age <> 'any')::INT)"


@RETRIEVAL.add(
    "condition_credit",
    f"""SELECT query_id, doc_id, round(coalesce(({_MET.format(u="0.2", **_S)} + {_MET.format(u="0.2", **_A)}) / nullif({_N}, 0), 0), 6)
    AS credit FROM ({_CAND_SQL})""",
)
def condition_credit(spark, sf):
    return _candidates(spark, sf).select("query_id", "doc_id", F.round(fusion.condition_parts(_conditions()), 6).alias("credit"))


@RETRIEVAL.add(
    "profile_rerank",
    f"""SELECT query_id, doc_id, round(final, 6) AS final, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY final DESC, score DESC, doc_id DESC) AS rank FROM (SELECT query_id, doc_id, score, score + 0.25 * coalesce(
      ({_MET.format(u="0", **_S)} + {_MET.format(u="0", **_A)}) / nullif({_N}, 0), 0) + 0.05 * CASE WHEN neutered THEN 1.0 ELSE 0 END
      AS final FROM ({_CAND_SQL})))""",
)
def profile_rerank(spark, sf):
    c = _candidates(spark, sf).withColumns(fusion.compatibility(_conditions()))
    ranked = fusion.profile_rerank(c.withColumn("quality", F.when(F.col("neutered"), 1.0)))
    return ranked.select("query_id", "doc_id", F.round("final", 6).alias("final"), "rank")


@RETRIEVAL.add(
    "any_overlap",
    f"""SELECT a.query_id, count(*) AS n FROM (SELECT DISTINCT profile_id AS query_id, preferred_size, preferred_age
    FROM appearance_profiles WHERE profile_id % 50 = 0) a JOIN ({SQL_TYPED}) t ON t.size = a.preferred_size
    AND t.age_group = a.preferred_age AND t.status = 'active' GROUP BY a.query_id""",
)
def any_overlap(spark, sf):
    """Relevance by public attributes: all criteria are equalities, so an equi join replaces the theta join."""
    p = table(spark, sf, "appearance_profiles").where("profile_id % 50 = 0")
    p = p.select(F.col("profile_id").alias("query_id"), F.col("preferred_size").alias("size"), F.col("preferred_age").alias("age_group"))
    active = typed(spark, sf).where("status = 'active'").select("size", "age_group")
    return p.distinct().join(active, ["size", "age_group"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
