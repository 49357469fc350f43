"""Queries of free texts, contacts, groups and schedules, and of JSON trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ranklake.functions import vocabulary as V
from ranklake.functions.text import known
from ranklake.operators import fusion, json_tree, lexical, splits
from ranklake.operators import notices as N
from ranklake.operators.query_policy import NEGATION, PARTICLES, Lexicon, normalised_queries
from ranklake.plans.notices import _q, sql_any, sql_known
from ranklake.plans.registry import Registry, table
from ranklake.plans.retrieval import _BM25_SQL, _QUERY_SQL, _sql_top, bm25_top, profile_queries
from ranklake.sources import sinks

POLICIES = Registry()

# Free texts brought to words of a lexicon.

COLORS = Lexicon(
    canonical=("흰색", "검정", "갈색", "크림", "회색", "얼룩", "소형", "중형", "대형", "단모", "장모"),
    aliases={"하얀": "흰색", "화이트": "흰색", "블랙": "검정", "까만": "검정", "브라운": "갈색", "작은": "소형", "큰": "대형"},
    least_typo=99,
)
_BARE = f"regexp_replace(w, '^(.{{2,}}?)({'|'.join(PARTICLES)})$', '\\1')"
_KNOWN = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in ({w: w for w in COLORS.canonical} | COLORS.aliases).items()) + "}"


@POLICIES.add(
    "canonical_texts",
    f"""SELECT doc_id, array_to_string(list_filter([{", ".join(map(_q, COLORS.canonical))}], lambda c: list_contains(found, c)), ' ') AS words, n_removed
    FROM (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(t, '[^\\s,.]+\\s*{NEGATION}', ' ', 'g'), '[0-9a-z가-힣]+'),
    lambda w: coalesce({_KNOWN}[w], {_KNOWN}[{_BARE}])) AS found, len(regexp_extract_all(t, '[^\\s,.]+\\s*{NEGATION}')) AS n_removed
    FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))""",
)
def canonical_texts(spark, sf):
    """Colours, sizes and coats that whole texts name, negated clauses taken out and counted."""
    queries = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    out = normalised_queries(queries, COLORS)
    return out.select(F.col("query_id").alias("doc_id"), F.array_join("canonical", " ").alias("words"), F.size("removed").cast("long").alias("n_removed"))


_PREFERENCES = {"calm": (("차분", "조용", "온순"), ("활발", "예민")), "friendly": (("사람을 잘 따", "애교"), ("겁이 많", "경계"))}


@POLICIES.add(
    "explicit_preferences",
    " UNION ALL ".join(
        f"SELECT doc_id, '{axis}' AS axis, CASE WHEN y AND n THEN 0 WHEN y THEN 1 ELSE -1 END AS label FROM (SELECT doc_id, {sql_any('text', yes)} AS y, "
        f"{sql_any('text', no)} AS n FROM documents) WHERE y OR n"
        for axis, (yes, no) in _PREFERENCES.items()
    ),
)
def explicit_preferences(spark, sf):
    """Only what a text says outright: for each axis 1, -1, or 0 where it says both."""
    docs, out = table(spark, sf, "documents"), None
    for axis, (yes, no) in _PREFERENCES.items():
        y, n = N.contains_any(F.col("text"), yes), N.contains_any(F.col("text"), no)
        label = F.when(y & n, 0).when(y, 1).otherwise(-1)
        one = docs.where(y | n).select("doc_id", F.lit(axis).alias("axis"), label.alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


_TEMPER = "|".join(V.PERSONALITY_TERMS)


_CALM_SQL = _BM25_SQL.replace(f"FROM ({_QUERY_SQL})", f"FROM (SELECT query_id, regexp_replace(query_text, '{_TEMPER}', ' ', 'g') AS query_text FROM ({_QUERY_SQL}))")


@POLICIES.add("appearance_top", _sql_top(f"SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM ({_CALM_SQL})", "bm25", 10))
def appearance_top(spark, sf):
    """Ranking by words of appearance only: words of temperament in a query take no part."""
    q = profile_queries(spark, sf)
    q = q.withColumn("query_text", F.regexp_replace("query_text", _TEMPER, " "))
    return lexical.bm25_top(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), q, 10)


@POLICIES.add(
    "pair_contract",
    f"""SELECT query_id, normal = other AS is_equal, contains(normal, '산책') AND contains(normal, '접종') AS has_required, NOT contains(normal, '가격') AS lacks_forbidden
    FROM (SELECT query_id, lower(trim(regexp_replace(query_text, '\\s+', ' ', 'g'))) AS normal, lower(trim(regexp_replace('  ' || replace(query_text, ' ', '  '),
    '\\s+', ' ', 'g'))) AS other FROM ({_QUERY_SQL}))""",
)
def pair_contract(spark, sf):
    """Two spellings of a query must be equal once normalised, hold the required words and none that is forbidden."""
    q = profile_queries(spark, sf)
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    one, other = plain(F.col("query_text")), plain(F.concat(F.lit("  "), F.replace("query_text", F.lit(" "), F.lit("  "))))
    return q.select(
        "query_id", (one == other).alias("is_equal"), (one.contains("산책") & one.contains("접종")).alias("has_required"),
        (~one.contains("가격")).alias("lacks_forbidden"),
    )


@POLICIES.add(
    "merged_facets",
    f"""SELECT profile_id, array_to_string(list_filter([preferred_size, CASE WHEN {sql_any('session_code', ('a', 'b'))} THEN 'small' END], lambda x: x IS NOT NULL
    AND x <> 'any'), ',') AS sizes, coalesce(nullif(preferred_age, 'any'), 'adult') AS age FROM appearance_profiles""",
)
def merged_facets(spark, sf):
    """What was read from a text and what a profile says: lists are united in order, single values override."""
    base = F.filter(F.array(F.col("preferred_size")), lambda x: x.isNotNull() & (x != "any"))
    said = F.filter(F.array(F.when(N.contains_any(F.col("session_code"), ("a", "b")), "small")), lambda x: x.isNotNull())
    return table(spark, sf, "appearance_profiles").select(
        "profile_id", F.array_join(F.concat(base, said), ",").alias("sizes"),
        F.coalesce(F.nullif("preferred_age", F.lit("any")), F.lit("adult")).alias("age"),
    )


@POLICIES.add(
    "contact_links",
    """SELECT doc_id, phone, CASE WHEN phone <> '' THEN 'tel:' || regexp_replace(phone, '[^0-9+]', '', 'g') END AS href FROM (SELECT doc_id,
    regexp_extract(coalesce(text, ''), '(0[0-9]{1,2}[- .]?[0-9]{3,4}[- .]?[0-9]{4})', 1) AS phone FROM documents)""",
)
def contact_links(spark, sf):
    """The first number to call in a text, and the link that dials it."""
    phone = F.regexp_extract(F.coalesce("text", F.lit("")), r"(0[0-9]{1,2}[- .]?[0-9]{3,4}[- .]?[0-9]{4})", 1)
    rows = table(spark, sf, "documents").select("doc_id", phone.alias("phone"))
    return rows.withColumn("href", F.when(F.col("phone") != "", F.concat(F.lit("tel:"), F.regexp_replace("phone", "[^0-9+]", ""))))


@POLICIES.add(
    "inquiry_questions",
    """SELECT item_id, array_to_string(list_distinct_in_order, '|') AS questions FROM (SELECT item_id, list_filter([CASE WHEN weight IS NULL THEN 'how heavy' END,
    CASE WHEN age IS NULL THEN 'how old' END, CASE WHEN NOT coalesce(contains(desc_full, '접종'), false) THEN 'vaccinated' END,
    CASE WHEN neuter NOT IN ('Y', 'N') THEN 'neutered' END], lambda x: x IS NOT NULL) AS list_distinct_in_order FROM notice_items)""",
)
def inquiry_questions(spark, sf):
    """What a notice leaves open, as questions, each once and in a fixed order."""
    asked = F.array(
        F.when(F.col("weight").isNull(), "how heavy"), F.when(F.col("age").isNull(), "how old"),
        F.when(~F.coalesce(F.col("desc_full").contains("접종"), F.lit(False)), "vaccinated"), F.when(~F.col("neuter").isin("Y", "N"), "neutered"),
    )
    questions = F.array_distinct(F.filter(asked, lambda x: x.isNotNull()))
    return table(spark, sf, "notice_items").select("item_id", F.array_join(questions, "|").alias("questions"))


# Results, evidence, releases.


@POLICIES.add(
    "results_with_evidence",
    f"""SELECT t.query_id, t.doc_id, t.rank, d.source, d.care_name, d.notice_id IS NOT NULL AS has_notice FROM ({_sql_top(f"SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM ({_BM25_SQL})", "bm25", 10)}) t
    LEFT JOIN documents d USING (doc_id)""",
)
def results_with_evidence(spark, sf):
    shown = table(spark, sf, "documents").select("doc_id", "source", "care_name", F.col("notice_id").isNotNull().alias("has_notice"))
    return bm25_top(spark, sf).select("query_id", "doc_id", "rank").join(shown, "doc_id", "left")


_MASK = r"[0-9]{2,4}[- ][0-9]{3,4}[- ][0-9]{4}|[A-Za-z0-9._]+@[A-Za-z0-9.]+"


@POLICIES.add(
    "released_texts",
    f"""SELECT doc_id, sha256(released) AS digest, released <> text AS was_masked FROM (SELECT doc_id, text, regexp_replace(text, '{_MASK}', '***', 'g') AS released
    FROM documents WHERE length(trim(text)) > 0)""",
)
def released_texts(spark, sf):
    """A release of all texts with something in them: numbers to call and addresses masked, each bound to its digest."""
    docs = table(spark, sf, "documents").where("length(trim(text)) > 0").withColumn("released", F.regexp_replace("text", _MASK, "***"))
    return docs.select("doc_id", F.sha2("released", 256).alias("digest"), (F.col("released") != F.col("text")).alias("was_masked"))


@POLICIES.add("bound_release", "SELECT count(*) AS n, true AS is_bound FROM documents WHERE length(trim(text)) > 0")
def bound_release(spark, sf):
    """The fingerprint of a release, computed twice over differently spread rows, must be the same."""
    rows = released_texts(spark, sf)
    one, two = sinks.fingerprint(rows), sinks.fingerprint(rows.repartition(7))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.lit(one == two).alias("is_bound"))


@POLICIES.add("candidate_depths", "SELECT profile_id, least(50, greatest(1 + profile_id % 20, 5 * (1 + profile_id % 20)))::BIGINT AS depth FROM appearance_profiles")
def candidate_depths(spark, sf):
    return table(spark, sf, "appearance_profiles").select("profile_id", fusion.candidate_depth(1 + F.col("profile_id") % 20).alias("depth"))


@POLICIES.add(
    "verified_times",
    """SELECT item_id, strftime(coalesce(try_cast(replace(last_verified, 'Z', '') AS TIMESTAMP), received_at), '%Y-%m-%d %H:%M:%S') AS verified FROM (SELECT item_id,
    received_at, CASE item_id % 3 WHEN 0 THEN strftime(received_at, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN 'not a time' END AS last_verified FROM notice_items)""",
)
def verified_times(spark, sf):
    """The first readable time of several fields, ISO texts with or without Z."""
    iso = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    said = F.when(F.col("item_id") % 3 == 0, iso).when(F.col("item_id") % 3 == 1, "not a time")
    time = F.coalesce(F.regexp_replace(said, "Z$", "").try_cast("timestamp_ntz"), F.col("received_at").cast("timestamp_ntz"))
    return table(spark, sf, "notice_items").select("item_id", F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("verified"))


# Groups, slots, schedules.


@POLICIES.add(
    "text_groups_split",
    """WITH g AS (SELECT sha256(text) AS key, min(coalesce(lang, '')) AS stratum FROM documents WHERE text IS NOT NULL GROUP BY 1), r AS (SELECT *, count(*) OVER (PARTITION BY
    stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY sha256('t|' || stratum || '|' || key), key) AS p FROM g)
    SELECT doc_id, CASE WHEN p <= CASE WHEN n = 1 THEN 0 ELSE greatest(1, least(n - 1, round_even(n * 0.2, 0)::BIGINT)) END THEN 'validation' ELSE 'train' END AS part
    FROM documents JOIN r ON key = sha256(text)""",
)
def text_groups_split(spark, sf):
    """Copies of a text stay on one side: groups are split within the signature of their labels, then joined back."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "lang", F.sha2("text", 256).alias("key"))
    groups = docs.groupBy("key").agg(F.min(F.coalesce("lang", F.lit(""))).alias("stratum"))
    parts = splits.stratified_split(groups, F.col("stratum"), F.col("key"), 0.2, "t").select("key", "part")
    return docs.join(parts, "key").select("doc_id", "part")


@POLICIES.add(
    "slot_audit",
    """SELECT query_id, count(*) AS n, count(DISTINCT notice_id) AS n_distinct, substr(sha256(array_to_string(list_sort(list(DISTINCT notice_id)), '|')), 1, 16) AS slot
    FROM qrels GROUP BY query_id""",
)
def slot_audit(spark, sf):
    """The members of each slot, named by a hash of their sorted ids, and whether any repeats; judgments of a query are few."""
    rows = table(spark, sf, "qrels").groupBy("query_id")
    ids = F.array_join(F.array_sort(F.collect_set("notice_id")), "|")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("notice_id").alias("n_distinct"), F.substring(F.sha2(ids, 256), 1, 16).alias("slot"))


_SEQUENCES = ((1, "AB", 1, "A"), (1, "AB", 2, "B"), (2, "BA", 1, "B"), (2, "BA", 2, "A"), (3, "BA", 1, "B"), (3, "BA", 2, "A"), (0, "AB", 1, "A"), (0, "AB", 2, "B"))


@POLICIES.add(
    "trial_schedule",
    f"""SELECT rater, sequence, trial, condition FROM (SELECT rater, ('0x' || substr(sha256('s|' || rater), 1, 8))::BIGINT % 4 AS k FROM (SELECT DISTINCT rater FROM rating_log))
    JOIN (VALUES {", ".join(map(str, _SEQUENCES))}) v(k, sequence, trial, condition) USING (k)""",
)
def trial_schedule(spark, sf):
    """Four counterbalanced sequences, dealt to participants by hash."""
    code = F.conv(F.substring(F.sha2(F.concat(F.lit("s|"), "rater"), 256), 1, 8), 16, 10).cast("long") % 4
    raters = table(spark, sf, "rating_log").select("rater").distinct().withColumn("k", code.cast("int"))
    plan = spark.createDataFrame(list(_SEQUENCES), "k int, sequence string, trial int, condition string")
    return raters.join(F.broadcast(plan), "k").select("rater", "sequence", "trial", "condition")


# JSON trees.


@POLICIES.add("json_leaves", "SELECT event_id, '$.k' AS path, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_leaves(spark, sf):
    """Every leaf of every tree with its path; numbers as numbers."""
    rows = table(spark, sf, "events").select("event_id", F.explode(json_tree.leaf_values(F.col("props"))).alias("x"))
    return rows.select("event_id", "x.path", F.col("x.value").try_cast("long").alias("value"))


@POLICIES.add(
    "sorted_trees",
    """SELECT item_id, '{"a":{"x":' || coalesce('"' || sex || '"', 'null') || ',"y":[' || batch_no || ']},"b":' || item_id || '}' AS tree, 2 + (sex IS NOT NULL AND sex <> '')::INT AS n_known
    FROM notice_items""",
)
def sorted_trees(spark, sf):
    """Objects with their members in order at every depth, and how many leaves they fill."""
    inner = F.struct(F.array("batch_no").alias("y"), F.col("sex").alias("x"))
    text = F.to_json(F.struct(F.col("item_id").alias("b"), inner.alias("a")), {"ignoreNullFields": "false"})
    return table(spark, sf, "notice_items").select("item_id", json_tree.canonical(text).alias("tree"), json_tree.known_leaves(text).alias("n_known"))


@POLICIES.add(
    "kept_conditions",
    "SELECT item_id, CASE WHEN color IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN sex IS NOT NULL THEN 1 ELSE 0 END AS n_kept FROM notice_items",
)
def kept_conditions(spark, sf):
    """Of a map of conditions only those of a list of names, and of these only the ones with a value."""
    pairs = F.create_map(*(x for c in ("color", "sex", "detail_url", "notice_no") for x in (F.lit(c), F.col(c))))
    kept = F.map_filter(pairs, lambda k, v: k.isin("color", "sex") & v.isNotNull())
    return table(spark, sf, "notice_items").select("item_id", F.size(kept).alias("n_kept"))


@POLICIES.add(
    "first_regions",
    "SELECT item_id, CASE "
    + " ".join(f"WHEN contains(coalesce({sql_known('care_name')}, ''), '{h}') THEN '{h}'" for h in ("가람", "검바위", "아라", "하늘"))
    + " ELSE '' END AS region FROM notice_items",
)
def first_regions(spark, sf):
    """The first region of an ordered list that the shelter's name hints at."""
    hints = [(h, (h,)) for h in ("가람", "검바위", "아라", "하늘")]
    return table(spark, sf, "notice_items").select("item_id", N.first_region(F.coalesce(known(F.col("care_name")), F.lit("")), hints).alias("region"))


@POLICIES.add(
    "asserted_texts",
    """SELECT doc_id, regexp_matches(lower(text), '온순') AND NOT regexp_matches(lower(text), '온순.{0,8}\\s*(않|없|아니|못)') AS is_asserted FROM documents
    WHERE contains(lower(text), '온순') AND len(regexp_extract_all(lower(text), '온순')) = 1 AND NOT regexp_matches(lower(text), '(안|못|not|no)\\s*온순')""",
)
def asserted_texts(spark, sf):
    """Of the texts that name a trait once and with no negation before it: whether a negation follows."""
    low = F.lower("text")
    once = (F.size(F.regexp_extract_all(low, F.lit("온순"), 0)) == 1) & ~low.rlike(r"(?:안|못|not|no)\s*온순")
    return table(spark, sf, "documents").where(once).select("doc_id", N.asserted(F.col("text"), ("온순",)).alias("is_asserted"))
