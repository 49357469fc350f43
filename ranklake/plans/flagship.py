"""The whole hybrid search: vectors, words, conditions, pictures and graph, fused, re-ranked with the graph, projected.

Queries are the profiles whose id is divisible by 50, against all documents. What is known of a document comes from the
item with its notice. Stages of an ablation leave out the conditions, take them from the query's text or from the profile,
and leave out the graph.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklake.functions import vocabulary as V
from ranklake.operators import fusion, graph, lexical, vectors
from ranklake.operators import notices as N
from ranklake.plans.extras import _VISUAL_SQL, visual_scores
from ranklake.plans.notices import SQL_TYPED, sql_any, typed
from ranklake.plans.registry import Registry, table
from ranklake.plans.retrieval import _QUERY_SQL, _ROUNDED_BM25, _VEC_SQL, _gallery, _sql_top, bm25_best, profile_queries
from ranklake.session import cut

HYBRID = Registry()
#: How many documents each way of searching gives, how many are re-ranked, seeds of the graph, and what comes out.
DEPTH, POOL, SEEDS, TOP = 50, 80, 10, 10
STAGES = ("none", "natural", "oracle")

# Facts.

_FACTS = f"""SELECT d.doc_id, d.source, t.status, t.size, nullif(t.age_group, '') AS age_group, t.sex, t.neutered, t.breed, t.care_name
  FROM documents d LEFT JOIN (SELECT notice_id, min(item_id) AS item_id FROM notice_items WHERE notice_id IS NOT NULL
  GROUP BY notice_id) i USING (notice_id) LEFT JOIN ({SQL_TYPED}) t USING (item_id)"""
_KIND = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.FEATURE_WEIGHTS.items())
_W = f"CASE split_part(feature, ':', 1) {_KIND} ELSE {V.OTHER_FEATURE_WEIGHT} END"
_EDGES = """SELECT DISTINCT doc_id, unnest(list_filter(['trait:body_size:' || lower(size), 'age:' || lower(age_group),
  'sex:' || lower(sex), 'neuter:' || CASE WHEN neutered THEN 'true' WHEN NOT neutered THEN 'false' END,
  'breed:name:' || lower(breed), 'region:' || lower(split_part(care_name, ' ', 1)), 'shelter:' || lower(care_name),
  'status:' || lower(status)], lambda x: x IS NOT NULL)) AS feature FROM facts"""


def facts(spark, sf):
    """What is known of each document, from the item of the lowest id with its notice."""
    first = table(spark, sf, "notice_items").where("notice_id IS NOT NULL").groupBy("notice_id").agg(F.min("item_id").alias("item_id"))
    known = typed(spark, sf).select(
        "item_id", "status", "size", F.nullif("age_group", F.lit("")).alias("age_group"), "sex", "neutered", "breed", "care_name"
    )
    docs = table(spark, sf, "documents").select("doc_id", "source", "notice_id")
    return docs.join(first, "notice_id", "left").join(known, "item_id", "left").drop("notice_id", "item_id")


def edges(of_docs):
    return graph.edges(
        of_docs, F.col("doc_id"),
        {
            "trait:body_size": F.col("size"), "age": F.col("age_group"), "sex": F.col("sex"), "neuter": F.col("neutered"),
            "breed:name": F.col("breed"), "region": F.substring_index("care_name", " ", 1), "shelter": F.col("care_name"),
            "status": F.col("status"),
        },
    )


# What is asked for.


def _sql_asked(structured: str) -> str:
    text = "query_text"
    size = {
        "none": "NULL", "oracle": "nullif(preferred_size, 'any')",
        "natural": f"CASE {' '.join(f'WHEN {sql_any(text, t)} THEN {chr(39)}{k}{chr(39)}' for k, t in V.SIZE_TERMS.items())} END",
    }[structured]
    age = {
        "none": "NULL", "oracle": "nullif(preferred_age, 'any')",
        "natural": f"CASE {' '.join(f'WHEN {sql_any(text, t)} THEN {chr(39)}{k}{chr(39)}' for k, t in V.AGE_TERMS.items())} END",
    }[structured]
    return f"""SELECT DISTINCT p.profile_id AS query_id, {size} AS size, {age} AS age, lower(nullif(trim(preferred_region), '')) AS region
      FROM appearance_profiles p JOIN ({_QUERY_SQL}) q ON q.query_id = p.profile_id AND q.query_text = concat_ws(' ',
      p.preferred_region, '산책', '접종', '사람', CASE p.preferred_size WHEN 'small' THEN '작은 아이' WHEN 'large' THEN '큰 개' END,
      CASE p.preferred_age WHEN 'puppy' THEN '개월' WHEN 'senior' THEN '노령' END) WHERE p.profile_id % 50 = 0"""


def asked_for(spark, sf, structured: str):
    """``query_id, size, age, region``; a profile that was delivered twice counts once."""
    p = table(spark, sf, "appearance_profiles").where("profile_id % 50 = 0")
    none = F.lit(None).cast("string")
    if structured == "oracle":
        size, age = (F.nullif(c, F.lit("any")) for c in ("preferred_size", "preferred_age"))
    elif structured == "natural":
        text = profile_queries(spark, sf)
        p = p.join(text, F.col("query_id") == F.col("profile_id"))
        size, age = (
            F.get(N.matching_labels(F.col("query_text"), terms), F.lit(0)) for terms in (V.SIZE_TERMS, V.AGE_TERMS)
        )
    else:
        size = age = none
    region = F.lower(F.nullif(F.trim("preferred_region"), F.lit("")))
    return p.select(F.col("profile_id").alias("query_id"), size.alias("size"), age.alias("age"), region.alias("region")).distinct()


def features_of(asked, structured: str):
    if structured == "none":
        return asked.select("query_id", F.lit("").alias("feature")).limit(0)
    each = F.array(
        F.concat(F.lit("trait:body_size:"), "size"), F.concat(F.lit("age:"), "age"), F.concat(F.lit("region:"), "region"),
        F.lit("status:active"),
    )
    return asked.select("query_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("feature")).distinct()


_FEATURES = """SELECT DISTINCT query_id, unnest(list_filter(['trait:body_size:' || size, 'age:' || age, 'region:' || region,
  'status:active'], lambda x: x IS NOT NULL)) AS feature FROM asked"""


def sql_ranked(structured: str = "oracle", with_graph: bool = True) -> str:
    """All CTEs of a stage; the last one, ``final``, has every re-ranked document with its parts."""
    features = _FEATURES if structured != "none" else f"SELECT * FROM ({_FEATURES}) WHERE false"
    met = "CASE WHEN {a} IS NULL THEN 0 WHEN {x} IS NULL THEN 0.2 WHEN {x} = {a} THEN 1 ELSE 0 END"
    credit = f"""coalesce(({met.format(a="a.size", x="c.size")} + {met.format(a="a.age", x="c.age_group")}) /
      nullif((a.size IS NOT NULL)::INT + (a.age IS NOT NULL)::INT, 0), 0)"""
    w = f"""CASE WHEN NOT {with_graph} THEN 0 WHEN placed THEN {V.GRAPH_WEIGHTS["place"]} WHEN n_features > 0
      THEN {V.GRAPH_WEIGHTS["features"]} ELSE {V.GRAPH_WEIGHTS["none"]} END"""
    f = V.FUSION_WEIGHTS
    return f"""facts AS MATERIALIZED ({_FACTS}), edges AS MATERIALIZED ({_EDGES}), asked AS MATERIALIZED ({_sql_asked(structured)}),
  f AS MATERIALIZED (SELECT *, {_W} AS w FROM ({features})), edge AS MATERIALIZED (SELECT *, {_W} AS w FROM edges),
  pr AS MATERIALIZED (SELECT query_id, doc_id, sum(f.w) AS prior FROM f JOIN edges USING (feature) GROUP BY ALL),
  g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(prior, 6) DESC, doc_id) AS n FROM pr)
    WHERE n <= {DEPTH}),
  v AS ({_sql_top(f"SELECT query_id, doc_id, round(score, 6) AS score FROM ({_VEC_SQL})", "score", DEPTH)}),
  b AS ({_sql_top(_ROUNDED_BM25, "bm25", DEPTH)}),
  keys AS (SELECT query_id, doc_id FROM g UNION SELECT query_id, doc_id FROM v UNION SELECT query_id, doc_id FROM b),
  pool AS (SELECT * FROM keys UNION ALL SELECT query_id, doc_id FROM (SELECT DISTINCT query_id FROM asked WHERE query_id NOT IN
    (SELECT query_id FROM keys)), (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {POOL})),
  parts AS (SELECT p.query_id, p.doc_id, coalesce(v.score, 0) AS vector, coalesce(b.bm25, 0) AS bm25, coalesce(g.prior, 0) AS prior
    FROM pool p LEFT JOIN v ON v.query_id = p.query_id AND v.doc_id = p.doc_id LEFT JOIN b ON b.query_id = p.query_id
    AND b.doc_id = p.doc_id LEFT JOIN g ON g.query_id = p.query_id AND g.doc_id = p.doc_id),
  scaled AS (SELECT *, coalesce(bm25 / nullif(max(bm25) OVER (PARTITION BY query_id), 0), 0) AS words,
    coalesce(prior / nullif(max(prior) OVER (PARTITION BY query_id), 0), 0) AS graph FROM parts),
  base AS (SELECT s.*, {credit} AS conditions, coalesce(x.visual, 0.5) AS visual, c.status FROM scaled s JOIN facts c USING (doc_id)
    JOIN (SELECT query_id, any_value(size) AS size, any_value(age) AS age FROM asked GROUP BY query_id) a USING (query_id)
    LEFT JOIN (SELECT vec_id AS doc_id, visual FROM ({_VISUAL_SQL})) x USING (doc_id)),
  fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT *,
    round({f["vector"]} * vector + {f["bm25"]} * words + {f["conditions"]} * conditions + {f["visual"]} * visual +
      {f["prior"]} * graph, 6) AS score FROM base WHERE coalesce(status, 'unknown') IN ('active', 'unknown'))),
  ranked AS MATERIALIZED (SELECT * FROM fused WHERE rank <= {POOL}),
  own AS (SELECT doc_id, sum(w) AS own FROM edge WHERE NOT starts_with(feature, 'breed:') GROUP BY doc_id),
  sh AS (SELECT r.query_id, r.doc_id, t.doc_id AS seed_id, sum(e.w) AS shared FROM ranked r JOIN ranked t ON t.query_id = r.query_id
    AND t.rank <= {SEEDS} AND t.doc_id <> r.doc_id JOIN edge e ON e.doc_id = r.doc_id AND NOT starts_with(e.feature, 'breed:')
    JOIN edge e2 ON e2.doc_id = t.doc_id AND e2.feature = e.feature GROUP BY ALL),
  nb AS (SELECT query_id, sh.doc_id, least(1, max(shared / (o.own + q.own - shared))) AS neighbour FROM sh JOIN own o
    ON o.doc_id = sh.doc_id JOIN own q ON q.doc_id = seed_id GROUP BY ALL),
  fs AS (SELECT query_id, sum(w) AS total, count(*) AS n_features, bool_or(starts_with(feature, 'region:')) AS placed FROM f GROUP BY ALL),
  ms AS (SELECT query_id, max(prior) AS most FROM pr GROUP BY query_id),
  final AS (SELECT r.query_id, r.doc_id, r.score AS base, r.rank AS base_rank,
    round((1 - w) * r.score + w * CASE WHEN coalesce(n_features, 0) > 0 THEN 0.7 * match + 0.2 * seed + 0.1 * neighbour
      ELSE neighbour END, 6) AS score FROM (SELECT r.*, coalesce(least(1, coalesce(pr.prior, 0) / total), 0) AS match,
      coalesce(coalesce(pr.prior, 0) / most, 0) AS seed, coalesce(nb.neighbour, 0) AS neighbour, n_features, {w} AS w FROM ranked r
      LEFT JOIN pr ON pr.query_id = r.query_id AND pr.doc_id = r.doc_id LEFT JOIN nb ON nb.query_id = r.query_id
      AND nb.doc_id = r.doc_id LEFT JOIN fs ON fs.query_id = r.query_id LEFT JOIN ms ON ms.query_id = r.query_id) r)"""


class Search:
    """What all stages share, each computed once: facts, edges, pictures, and the hits of words and vectors."""

    def __init__(self, spark, sf) -> None:
        self.spark, self.sf = spark, sf
        self.known = cut(facts(spark, sf))
        self.web = cut(edges(self.known))
        words = bm25_best(spark, sf, DEPTH).select("query_id", "doc_id", "bm25")
        asked = asked_for(spark, sf, "none").select(F.col("query_id").alias("doc_id")).distinct()
        wanted = _gallery(spark, sf).join(F.broadcast(asked), "doc_id", "left_semi")
        near = vectors.nearest(wanted.select(F.col("doc_id").alias("query_id"), "vector"), _gallery(spark, sf), DEPTH + 10)
        near = lexical.top_k(near.withColumn("vector", F.round("score", 6)).drop("rank"), "vector", DEPTH)
        self.hits = cut(fusion.candidate_union({"vector": near.select("query_id", "doc_id", "vector"), "bm25": words}))
        self.visual = visual_scores(spark, sf).withColumnRenamed("vec_id", "doc_id")

    def ranked(self, structured: str = "oracle", weights: dict[str, float] | None = None):
        """``query_id, doc_id, base, score`` of all documents that are re-ranked."""
        return self.both(structured, weights)[1]

    def both(self, structured: str = "oracle", weights: dict[str, float] | None = None):
        """``query_id, doc_id, base, score`` of all documents that are re-ranked, without and with the graph."""
        asked = asked_for(self.spark, self.sf, structured)
        one = asked.groupBy("query_id").agg(F.first("size").alias("q_size"), F.first("age").alias("q_age"))
        features = features_of(asked, structured)
        best = cut(graph.best_candidates(features, self.web, DEPTH))
        prior = best.select("query_id", "doc_id", F.lit(None).cast("double").alias("vector"), F.lit(None).cast("double").alias("bm25"), "prior")
        parts = self.hits.withColumn("prior", F.lit(None).cast("double")).unionByName(prior)
        names = ("vector", "bm25", "prior")
        pool = parts.groupBy("query_id", "doc_id").agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in names))
        # A query that found nothing gets the first documents; as many rows as a pool has.
        first = table(self.spark, self.sf, "documents").select("doc_id").orderBy("doc_id").limit(POOL)
        lost = one.select("query_id").join(parts.select("query_id").distinct(), "query_id", "left_anti")
        lost = lost.join(F.broadcast(first), F.lit(True)).select("query_id", "doc_id", *(F.lit(0.0).alias(c) for c in names))
        pool = pool.unionByName(lost).join(self.known.select("doc_id", "status", "size", "age_group"), "doc_id").join(one, "query_id")
        pool = pool.join(self.visual, "doc_id", "left").na.fill(0.5, ["visual"])
        conditions = [
            (F.col("q_size").isNotNull(), F.col("size") == F.col("q_size")),
            (F.col("q_age").isNotNull(), F.col("age_group") == F.col("q_age")),
        ]
        pool = pool.withColumn("conditions", fusion.condition_parts(conditions))
        fused = fusion.fused(pool, weights, keep=("status",)).where("coalesce(status, 'unknown') IN ('active', 'unknown')")
        ranked = lexical.top_k(fused.withColumn("score", F.round("score", 6)).drop("status"), "score", POOL)
        ranked = cut(ranked)
        done = graph.reranked(ranked, features, self.web, best, SEEDS)
        plain = ranked.select("query_id", "doc_id", F.col("score").alias("base"), "score")
        return plain, done.select("query_id", "doc_id", "base", F.round("score", 6).alias("score"))


def _sql_stage(structured: str = "oracle", with_graph: bool = True, k: int = TOP) -> str:
    return f"""WITH {sql_ranked(structured, with_graph)} SELECT query_id, doc_id, base, score, rank FROM (SELECT *, row_number() OVER
      (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM final) WHERE rank <= {k}"""


_SHOWN = "t.rank, t.query_id, t.doc_id, t.score, t.base, c.source, c.status, c.size, c.age_group, c.sex, c.breed, c.care_name"


@HYBRID.add("hybrid_top", f"SELECT {_SHOWN} FROM ({_sql_stage()}) t JOIN ({_FACTS}) c USING (doc_id)")
def hybrid_top(spark, sf):
    """The flagship: vectors, words, graph, conditions and pictures of every query against all documents, the ten best shown."""
    search = Search(spark, sf)
    top = lexical.top_k(search.ranked(), "score", TOP)
    shown = search.known.select("doc_id", "source", "status", "size", "age_group", "sex", "breed", "care_name")
    return top.join(shown, "doc_id")


@HYBRID.add(
    "ablation_stages",
    " UNION ALL ".join(
        f"SELECT '{s}' AS structured, {g} AS with_graph, query_id, doc_id, rank FROM ({_sql_stage(s, g)})"
        for s in STAGES for g in (False, True)
    ),
)
def ablation_stages(spark, sf):
    """The ten best of each query with the conditions left out, read from the text or given, with and without graph."""
    search, out = Search(spark, sf), None
    for s in STAGES:
        for g, rows in zip((False, True), search.both(s)):
            top = lexical.top_k(rows, "score", TOP)
            top = top.select(F.lit(s).alias("structured"), F.lit(g).alias("with_graph"), "query_id", "doc_id", "rank")
            out = top if out is None else out.unionByName(top)
    return out


_MISMATCH = """((a.size IS NOT NULL AND c.size IS NOT NULL AND a.size <> c.size) OR
  (a.age IS NOT NULL AND c.age_group IS NOT NULL AND a.age <> c.age_group))"""


@HYBRID.add(
    "strict_top",
    f"""WITH {sql_ranked()} SELECT query_id, doc_id, score, rank FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY
      score DESC, doc_id) AS rank FROM final f JOIN facts c USING (doc_id) JOIN asked a USING (query_id) WHERE NOT {_MISMATCH})
      WHERE rank <= {TOP}""",
)
def strict_top(spark, sf):
    """Of the re-ranked documents only those without any mismatched condition; what is not known is no mismatch."""
    asked = asked_for(spark, sf, "oracle").select("query_id", F.col("size").alias("q_size"), "age")
    search = Search(spark, sf)
    rows = search.ranked().join(search.known.select("doc_id", "size", "age_group"), "doc_id").join(asked, "query_id")
    differs = F.coalesce(F.col("size") != F.col("q_size"), F.lit(False)) | F.coalesce(F.col("age_group") != F.col("age"), F.lit(False))
    return lexical.top_k(rows.where(~differs).select("query_id", "doc_id", "score"), "score", TOP)
