"""Queries of synchronisation, audits, splits and relational work."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ranklake.operators import splits as P
from ranklake.operators import statistics as S
from ranklake.operators import sync as Y
from ranklake.operators.notices import notice_date
from ranklake.plans.notices import REFERENCE, SQL_TYPED, sql_date, typed
from ranklake.plans.registry import Registry, table
from ranklake.plans.retrieval import _RUN_SQL, runs

UPKEEP = Registry()

# Two states of one table: each provider's date against its own date before, of each date the last delivery.
_DATES = """(SELECT *, lag(snapshot_date) OVER (PARTITION BY provider_id ORDER BY snapshot_date) AS earlier FROM (SELECT provider_id,
  snapshot_date, max(delivery_no) AS delivery_no FROM notice_snapshots GROUP BY ALL))"""
_STATES = f"""(SELECT d.provider_id, d.snapshot_date, notice_id, max(source_status) AS status, max(notice_end) AS ends
  FROM notice_snapshots JOIN {_DATES} d USING (provider_id, snapshot_date, delivery_no) WHERE notice_id IS NOT NULL GROUP BY ALL)"""
_ACTIONS_BY_DATE = f"""SELECT provider_id, snapshot_date, notice_id, CASE WHEN a.is_old IS NULL THEN 'new' WHEN b.is_new IS NULL
  THEN 'stale' WHEN a.status IS DISTINCT FROM b.status AND a.ends IS DISTINCT FROM b.ends THEN 'changed_both'
  WHEN a.status IS DISTINCT FROM b.status THEN 'changed_text' WHEN a.ends IS DISTINCT FROM b.ends THEN 'changed_picture'
  ELSE 'retained' END AS action FROM (SELECT d.provider_id, d.snapshot_date, notice_id, status, ends, 1 AS is_old FROM {_DATES} d
  JOIN {_STATES} s ON s.provider_id = d.provider_id AND s.snapshot_date = d.earlier) a FULL JOIN (SELECT s.*, 1 AS is_new
  FROM {_STATES} s JOIN {_DATES} d USING (provider_id, snapshot_date) WHERE d.earlier IS NOT NULL) b
  USING (provider_id, snapshot_date, notice_id)"""


@UPKEEP.add("sync_actions", _ACTIONS_BY_DATE)
def sync_actions(spark, sf):
    rows = table(spark, sf, "notice_snapshots")
    dates = rows.groupBy("provider_id", "snapshot_date").agg(F.max("delivery_no").alias("delivery_no"))
    order = Window.partitionBy("provider_id").orderBy("snapshot_date")
    dates = dates.select("*", F.lag("snapshot_date").over(order).alias("earlier"), F.lead("snapshot_date").over(order).alias("later"))
    last = rows.where("notice_id IS NOT NULL").join(dates, ["provider_id", "snapshot_date", "delivery_no"])
    states = last.groupBy("provider_id", "snapshot_date", "earlier", "later", "notice_id").agg(
        F.max("source_status").alias("status"), F.max("notice_end").alias("ends")
    )
    key = lambda date: F.struct("provider_id", F.col(date).alias("snapshot_date"), "notice_id").alias("key")
    side = lambda date, given: states.where(F.col(given).isNotNull()).select(key(date), "status", "ends")
    actions = Y.sync_actions(side("later", "later"), side("snapshot_date", "earlier"), "key", ["status"], ["ends"])
    return actions.select("key.*", "action")


@UPKEEP.add(
    "sync_counts",
    f"SELECT provider_id, snapshot_date, action, count(*) AS n FROM ({_ACTIONS_BY_DATE}) GROUP BY ALL",
)
def sync_counts(spark, sf):
    return sync_actions(spark, sf).groupBy("provider_id", "snapshot_date", "action").agg(F.count(F.lit(1)).alias("n"))


@UPKEEP.add(
    "safety_gates",
    f"""SELECT provider_id, snapshot_date, n_fresh, round(share, 6) AS removed_fraction, n_fresh >= 1 AND share <= 0.5 AS passed
    FROM (SELECT provider_id, snapshot_date, count(*) FILTER (WHERE action <> 'stale') AS n_fresh,
    coalesce(count(*) FILTER (WHERE action = 'stale') / nullif(count(*) FILTER (WHERE action <> 'new'), 0), 0) AS share
    FROM ({_ACTIONS_BY_DATE}) GROUP BY provider_id, snapshot_date)""",
)
def safety_gates(spark, sf):
    return Y.safety_gates(sync_actions(spark, sf), by=["provider_id", "snapshot_date"])


# Items of the new batches, of each number the first, are the source for those of the history.
_MERGE_SOURCE = """(SELECT notice_id, arg_min(desc_full, item_id) AS desc_full, arg_min(color, item_id) AS color FROM (SELECT
  notice_id, item_id, coalesce(desc_full, '') AS desc_full, coalesce(color, '') AS color FROM notice_items
  WHERE batch_no > 0 AND notice_id IS NOT NULL) GROUP BY notice_id)"""
_TARGET = "(SELECT * FROM notice_items WHERE batch_no = 0)"


def _merge_sides(spark, sf):
    items = table(spark, sf, "notice_items")
    new = items.where("batch_no > 0 AND notice_id IS NOT NULL").groupBy("notice_id")
    first = lambda c: F.min_by(F.coalesce(c, F.lit("")), "item_id").alias(c)
    return items.where("batch_no = 0"), new.agg(first("desc_full"), first("color"))


_full = lambda c: f"nullif(trim({c}, ' '), '')"


@UPKEEP.add(
    "merge_non_empty",
    f"""SELECT t.notice_id, coalesce({_full("s.desc_full")}, t.desc_full) AS desc_full, coalesce({_full("s.color")}, t.color)
    AS color FROM {_TARGET} t LEFT JOIN {_MERGE_SOURCE} s USING (notice_id)""",
)
def merge_non_empty(spark, sf):
    return Y.merged(*_merge_sides(spark, sf), "notice_id", ["desc_full", "color"])


@UPKEEP.add(
    "fill_blanks",
    f"""SELECT t.notice_id, coalesce({_full("t.desc_full")}, {_full("s.desc_full")}) AS desc_full,
    coalesce({_full("t.color")}, {_full("s.color")}) AS color FROM {_TARGET} t LEFT JOIN {_MERGE_SOURCE} s USING (notice_id)""",
)
def fill_blanks(spark, sf):
    return Y.merged(*_merge_sides(spark, sf), "notice_id", ["desc_full", "color"], fill_only=True)


_KNOWN = " + ".join(f"({_full(c)} IS NOT NULL)::INT" for c in ("color", "desc_full", "image_urls"))


@UPKEEP.add(
    "best_records",
    f"""SELECT notice_no, n_known, color, desc_full, image_urls FROM (SELECT *, row_number() OVER (PARTITION BY notice_no
    ORDER BY n_known DESC, item_id) AS p FROM (SELECT *, {_KNOWN} AS n_known FROM notice_items)) WHERE p = 1""",
)
def best_records(spark, sf):
    return Y.best_records(table(spark, sf, "notice_items"), "notice_no", ["color", "desc_full", "image_urls"], F.col("item_id"))


@UPKEEP.add(
    "first_known",
    f"""SELECT notice_no, arg_min({_full("color")}, item_id) FILTER (WHERE {_full("color")} IS NOT NULL) AS color,
    arg_min({_full("breed")}, item_id) FILTER (WHERE {_full("breed")} IS NOT NULL) AS breed FROM notice_items GROUP BY notice_no""",
)
def first_known(spark, sf):
    return Y.first_known(table(spark, sf, "notice_items"), "notice_no", F.col("item_id"), ["color", "breed"])


@UPKEEP.add(
    "freshness",
    f"""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN d IS NULL THEN 'missing' WHEN d > DATE '{REFERENCE}' THEN 'future'
    WHEN date_diff('day', d, DATE '{REFERENCE}') <= 30 THEN 'fresh' ELSE 'stale' END AS bucket FROM (SELECT notice_id,
    max({sql_date("notice_end")}) AS d FROM notice_items GROUP BY notice_id)) GROUP BY bucket""",
)
def freshness(spark, sf):
    return Y.freshness(table(spark, sf, "notice_items"), "notice_id", notice_date(F.col("notice_end")), REFERENCE, 30)


@UPKEEP.add(
    "duplicate_ids",
    """SELECT provider_id, count(*) AS n_rows, count(DISTINCT notice_id) AS n_ids,
    count(*) FILTER (WHERE notice_id IS NULL) AS n_missing, count(notice_id) - count(DISTINCT notice_id) AS n_repeated
    FROM notice_snapshots GROUP BY provider_id""",
)
def duplicate_ids(spark, sf):
    # Counted by id first: distinct counts then need no expansion of rows.
    each = table(spark, sf, "notice_snapshots").groupBy("provider_id", "notice_id").agg(F.count(F.lit(1)).alias("n"))
    has = F.col("notice_id").isNotNull()
    return each.groupBy("provider_id").agg(
        F.sum("n").alias("n_rows"), F.count("notice_id").alias("n_ids"),
        F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.when(has, F.col("n") - 1)), F.lit(0)).alias("n_repeated"),
    )


_TOP = f"""SELECT r.system_id, t.item_id AS doc_id FROM ({_RUN_SQL}) r JOIN (SELECT notice_id, min(item_id) AS item_id
  FROM notice_items WHERE notice_id IS NOT NULL GROUP BY notice_id) t ON t.notice_id = r.doc_id WHERE r.rank <= 10"""
_LONG = f"""SELECT item_id AS doc_id, unnest(['status', 'size', 'age_group']) AS dim, unnest([coalesce(status, 'unknown'),
  coalesce(size, 'unknown'), coalesce(age_group, 'unknown')]) AS value FROM ({SQL_TYPED})"""


@UPKEEP.add(
    "exposure_ratio",
    f"""WITH l AS ({_LONG}), c AS (SELECT dim, value, count(*) AS nc, sum(count(*)) OVER (PARTITION BY dim) AS tc FROM l
      GROUP BY dim, value), s AS (SELECT system_id, dim, value, count(*) AS ns, sum(count(*)) OVER (PARTITION BY system_id, dim)
      AS ts FROM ({_TOP}) JOIN l USING (doc_id) GROUP BY system_id, dim, value)
    SELECT system_id, dim, value, round(nc / tc, 6) AS corpus_share, round(ns / ts, 6) AS shown_share,
    round((ns / ts) / (nc / tc), 6) AS ratio FROM s JOIN c USING (dim, value)""",
)
def exposure_ratio(spark, sf):
    items = table(spark, sf, "notice_items").where("notice_id IS NOT NULL").groupBy(F.col("notice_id").alias("doc_id"))
    ids = items.agg(F.min("item_id").alias("item_id"))
    shown = runs(spark, sf).where("rank <= 10").join(ids, "doc_id").select("system_id", F.col("item_id").alias("doc_id"))
    corpus = typed(spark, sf).select(F.col("item_id").alias("doc_id"), "status", "size", "age_group")
    return Y.exposure(corpus, shown, ["status", "size", "age_group"])


@UPKEEP.add(
    "exclusion_reasons",
    f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN status IN ('closed', 'expired') THEN 'not active'
    WHEN breed IS NULL THEN 'no breed' WHEN size IS NULL THEN 'no weight' WHEN age_group = '' THEN 'no age' ELSE 'kept' END AS reason
    FROM ({SQL_TYPED})) GROUP BY reason""",
)
def exclusion_reasons(spark, sf):
    reasons = {
        "not active": F.col("status").isin("closed", "expired"), "no breed": F.col("breed").isNull(),
        "no weight": F.col("size").isNull(), "no age": F.col("age_group") == "",
    }
    return Y.exclusion_reasons(typed(spark, sf), reasons)


@UPKEEP.add(
    "gallery_groups",
    """SELECT breed, count(*) AS n, min(care_name) AS first_care_name, array_to_string(list_slice(list_sort(list(DISTINCT item_id),
    'DESC'), 1, 3), ',') AS samples FROM notice_items WHERE breed IS NOT NULL GROUP BY breed""",
)
def gallery_groups(spark, sf):
    """Groups with three sample ids: the three greatest come from a ranked cut, no group is gathered whole."""
    items = table(spark, sf, "notice_items").where("breed IS NOT NULL").select("breed", "care_name", "item_id")
    top = items.select("breed", "item_id").distinct()
    top = top.withColumn("p", F.row_number().over(Window.partitionBy("breed").orderBy(F.desc("item_id")))).where("p <= 3")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("p", "item_id"))), lambda x: x["item_id"].cast("string"))
    samples = top.groupBy("breed").agg(F.array_join(ids, ",").alias("samples"))
    counts = items.groupBy("breed").agg(F.count(F.lit(1)).alias("n"), F.min("care_name").alias("first_care_name"))
    return counts.join(samples, "breed")


@UPKEEP.add(
    "trial_summary",
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(quantile_cont(least(value, 15), 0.5), 6)
    AS median_capped, round(count(*) FILTER (WHERE value > 15) / count(*), 6) AS share_over FROM events GROUP BY event_type""",
)
def trial_summary(spark, sf):
    e = table(spark, sf, "events").withColumn("capped", F.least("value", F.lit(15.0)))
    out = e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"),
        F.round(F.count(F.when(F.col("value") > 15, 1)) / F.count(F.lit(1)), 6).alias("share_over"),
    )
    median = S.quantiles(e, ["event_type"], "capped", [0.5])
    return out.join(median.select("event_type", F.round("quantile", 6).alias("median_capped")), "event_type")


@UPKEEP.add(
    "paired_conditions",
    """SELECT user_id, round(median(value) FILTER (WHERE event_type = 'click') - median(value) FILTER (WHERE event_type = 'view'), 6)
    AS delta FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id HAVING count(DISTINCT event_type) = 2""",
)
def paired_conditions(spark, sf):
    e = table(spark, sf, "events").where("event_type IN ('click', 'view')")
    medians = S.quantiles(e, ["user_id", "event_type"], "value", [0.5])
    wide = medians.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.max("quantile"))
    return wide.dropna().select("user_id", F.round(F.col("click") - F.col("view"), 6).alias("delta"))


@UPKEEP.add("json_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_values(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@UPKEEP.add(
    "canonical_json",
    """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS digest FROM part""",
)
def canonical_json(spark, sf):
    record = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    return table(spark, sf, "part").select("p_partkey", F.sha2(record, 256).alias("digest"))


@UPKEEP.add(
    "valid_until",
    """SELECT event_id FROM events WHERE ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-30 00:00:00'""",
)
def valid_until(spark, sf):
    return table(spark, sf, "events").where("ts > TIMESTAMP_NTZ '2024-01-30 00:00:00' - INTERVAL 1 DAY").select("event_id")


@UPKEEP.add(
    "incremental_append",
    """SELECT batch_no, item_id FROM notice_items n WHERE batch_no > 0 AND NOT EXISTS (SELECT 1 FROM notice_items h
    WHERE h.batch_no < n.batch_no AND h.notice_id = n.notice_id)""",
)
def incremental_append(spark, sf):
    i = table(spark, sf, "notice_items").select("item_id", "batch_no", "notice_id")
    first = i.where("notice_id IS NOT NULL").groupBy("notice_id").agg(F.min("batch_no").alias("first_batch"))
    new = i.where("batch_no > 0").join(first, "notice_id", "left")
    return new.where("notice_id IS NULL OR batch_no = first_batch").select("batch_no", "item_id")


@UPKEEP.add(
    "expected_and_actual",
    """SELECT coalesce(e.notice_id, a.notice_id) AS notice_id, CASE WHEN a.notice_id IS NULL THEN 'missing'
    WHEN e.notice_id IS NULL THEN 'unexpected' ELSE 'both' END AS state FROM (SELECT DISTINCT notice_id FROM qrels) e FULL JOIN
    (SELECT DISTINCT notice_id FROM ranking_run) a ON a.notice_id = e.notice_id""",
)
def expected_and_actual(spark, sf):
    ids = lambda t: table(spark, sf, t).select("notice_id").distinct()
    e, a = ids("qrels").withColumn("e", F.lit(1)), ids("ranking_run").withColumn("a", F.lit(1))
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("both")
    return e.join(a, "notice_id", "full_outer").select("notice_id", state.alias("state"))


# Splits and samples.

_unit = lambda seed, c: f"('0x' || substr(sha256('{seed}|' || {c}), 1, 13))::BIGINT / 4503599627370496"


@UPKEEP.add(
    "hash_split",
    f"""SELECT care_name, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS part, count(*) AS n
    FROM (SELECT care_name, {_unit("v1", "care_name")} AS u FROM documents) GROUP BY ALL""",
)
def hash_split(spark, sf):
    part = P.split_of(F.col("care_name"), "v1").alias("part")
    return table(spark, sf, "documents").groupBy("care_name", part).agg(F.count(F.lit(1)).alias("n"))


@UPKEEP.add(
    "stratified_split",
    """SELECT stratum, key, CASE WHEN p <= CASE WHEN n = 1 THEN 0 ELSE greatest(1, least(n - 1, round_even(n * 0.15, 0)::BIGINT)) END
    THEN 'validation' ELSE 'train' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER
    (PARTITION BY stratum ORDER BY sha256('s|' || stratum || '|' || key), key) AS p FROM (SELECT source AS stratum,
    doc_id::VARCHAR AS key FROM documents))""",
)
def stratified_split(spark, sf):
    return P.stratified_split(table(spark, sf, "documents"), F.col("source"), F.col("doc_id"), 0.15, "s")


@UPKEEP.add(
    "stratified_sample",
    """SELECT stratum, key FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, key) AS p FROM (SELECT source AS
    stratum, doc_id::VARCHAR AS key, sha256('s|' || doc_id) AS h FROM documents)) ORDER BY (p > 1)::INT, h, key LIMIT 40""",
)
def stratified_sample(spark, sf):
    return P.stratified_sample(table(spark, sf, "documents"), F.col("source"), F.col("doc_id"), 40, "s")


@UPKEEP.add(
    "gallery_draw",
    """SELECT identity, key, CASE WHEN row_number() OVER (PARTITION BY identity ORDER BY sha256('g|' || key), key) = 1
    THEN 'gallery' ELSE 'query' END AS role FROM (SELECT label AS identity, vec_id::VARCHAR AS key FROM embeddings)""",
)
def gallery_draw(spark, sf):
    return P.draw_per_identity(table(spark, sf, "embeddings"), F.col("label"), F.col("vec_id"), "g")


@UPKEEP.add(
    "opaque_codes",
    "SELECT doc_id, upper(substr(sha256('task|' || doc_id), 1, 12)) AS code FROM documents",
)
def opaque_codes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.opaque_code(F.lit("task"), F.col("doc_id")).alias("code"))


@UPKEEP.add(
    "shared_content_owners",
    """SELECT DISTINCT care_name FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE length(text) > 20
    GROUP BY 1 HAVING count(DISTINCT care_name) > 1)""",
)
def shared_content_owners(spark, sf):
    d = table(spark, sf, "documents").where("length(text) > 20").select(F.sha2("text", 256).alias("h"), "care_name").distinct()
    shared = d.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return d.join(shared, "h", "left_semi").select("care_name").distinct()


@UPKEEP.add(
    "split_is_disjoint",
    f"""SELECT count(*) AS n_in_two FROM (SELECT care_name FROM (SELECT DISTINCT care_name, CASE WHEN u < 0.7 THEN 'train'
    WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS part FROM (SELECT care_name, {_unit("v1", "care_name")} AS u FROM documents))
    GROUP BY care_name HAVING count(*) > 1)""",
)
def split_is_disjoint(spark, sf):
    groups = hash_split(spark, sf).groupBy("care_name").agg(F.countDistinct("part").alias("k"))
    return groups.agg(F.count(F.when(F.col("k") > 1, 1)).alias("n_in_two"))


_LINKS = "(SELECT 'q' || query_id AS a, 'd' || notice_id AS b FROM qrels WHERE grade >= 2)"


@UPKEEP.add(
    "components",
    f"""WITH RECURSIVE e AS (SELECT a, b FROM {_LINKS} UNION SELECT b, a FROM {_LINKS}), r(n, m) AS (SELECT a, a FROM e UNION
    SELECT e.b, r.m FROM r JOIN e ON e.a = r.n) SELECT n AS node, min(m) AS component FROM r GROUP BY n""",
)
def components(spark, sf):
    q = table(spark, sf, "qrels").where("grade >= 2")
    return P.components(q.select(F.concat(F.lit("q"), "query_id").alias("a"), F.concat(F.lit("d"), "notice_id").alias("b")))


@UPKEEP.add(
    "counterfactual_targets",
    """SELECT p_partkey, arg_min(target, h) AS target FROM (SELECT a.p_partkey, b.p_type AS target, sha256('c|' || a.p_partkey || '|'
    || b.p_type) AS h FROM part a JOIN (SELECT DISTINCT p_type FROM part) b ON b.p_type <> a.p_type) GROUP BY p_partkey""",
)
def counterfactual_targets(spark, sf):
    """The other type of least hash for every part; the types are a bounded list, so they travel in each row."""
    types = table(spark, sf, "part").agg(F.collect_set("p_type").alias("types"))
    part = table(spark, sf, "part").select("p_partkey", "p_type").join(F.broadcast(types), F.lit(True))
    other = F.filter("types", lambda t: t != F.col("p_type"))
    h = lambda t: F.sha2(F.concat_ws("|", F.lit("c"), F.col("p_partkey").cast("string"), t), 256)
    best = F.array_min(F.transform(other, lambda t: F.struct(h(t).alias("h"), t.alias("t"))))
    return part.select("p_partkey", best["t"].alias("target"))


# Set algebra and relational work.


@UPKEEP.add(
    "set_algebra",
    """SELECT 'common' AS kind, count(*) AS n FROM (SELECT notice_id FROM qrels INTERSECT SELECT notice_id FROM ranking_run)
    UNION ALL SELECT 'only_judged', count(*) FROM (SELECT notice_id FROM qrels EXCEPT SELECT notice_id FROM ranking_run)
    UNION ALL SELECT 'either', count(*) FROM (SELECT notice_id FROM qrels UNION SELECT notice_id FROM ranking_run)""",
)
def set_algebra(spark, sf):
    a, b = (table(spark, sf, t).select("notice_id") for t in ("qrels", "ranking_run"))
    parts = {"common": a.intersect(b), "only_judged": a.subtract(b), "either": a.union(b).distinct()}
    out = None
    for kind, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@UPKEEP.add(
    "revenue_by_nation",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey =
    n_nationkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name""",
)
def revenue_by_nation(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND o_orderdate < TIMESTAMP_NTZ '1998-01-01'")
    lines = table(spark, sf, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("r"))
    met = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    met = met.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name")
    return met.agg(F.round(F.sum("r"), 2).alias("revenue"), F.count(F.lit(1)).alias("n_orders"))


@UPKEEP.add(
    "region_size_cube",
    f"""SELECT coalesce(care_name, 'all') AS care_name, coalesce(size, 'all') AS size, count(*) AS n FROM (SELECT care_name,
    coalesce(size, 'unknown') AS size FROM ({SQL_TYPED})) GROUP BY CUBE (care_name, size)""",
)
def region_size_cube(spark, sf):
    t = typed(spark, sf).select("care_name", F.coalesce("size", F.lit("unknown")).alias("size"))
    n = t.cube("care_name", "size").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.coalesce("care_name", F.lit("all")).alias("care_name"), F.coalesce("size", F.lit("all")).alias("size"), "n")
