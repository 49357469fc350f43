"""Queries of typed facts, comparisons with profiles, and texts made of fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklake.functions import vocabulary as V
from ranklake.functions.text import known
from ranklake.operators import graph, profiles
from ranklake.operators import notices as N
from ranklake.plans.flagship import _EDGES, _FACTS, _W, edges, facts
from ranklake.plans.notices import REFERENCE, SQL_BREED, SQL_KG, YEAR, _q, sql_any, sql_date, sql_known, sql_status
from ranklake.plans.registry import Registry, table

PROFILES = Registry()

_AGE = f"({sql_known('age')})"
_BORN = f"try_cast(nullif(regexp_extract({_AGE}, '((?:19|20)[0-9]{{2}})', 1), '') AS INT)"
_SAID = lambda unit: f"try_cast(nullif(replace(regexp_extract({_AGE}, '(-?[0-9]+(?:[.,][0-9]+)?)\\s*(?:{unit})', 1), ',', '.'), '') AS DOUBLE)"
_SINCE = f"CASE WHEN {_BORN} <= {YEAR} THEN ({YEAR} - {_BORN})::DOUBLE END"
_YEARS = f"""CASE WHEN {_BORN} IS NOT NULL AND contains({_AGE}, '년생') THEN {_SINCE} WHEN {_SAID("살|세")} IS NOT NULL THEN
  CASE WHEN {_SAID("살|세")} >= 0 THEN {_SAID("살|세")} END WHEN {_SAID("개월")} IS NOT NULL THEN CASE WHEN {_SAID("개월")} >= 0
  THEN {_SAID("개월")} / 12 END WHEN contains({_AGE}, '60일미만') THEN 2.0::DOUBLE / 12 ELSE {_SINCE} END"""
_GROUP = f"""CASE WHEN years <= 1 THEN 'puppy' WHEN years >= 8 THEN 'senior' WHEN years IS NOT NULL THEN 'adult'
  WHEN {sql_any("a", ("puppy", "개월", "새끼"))} THEN 'puppy' WHEN {sql_any("a", ("senior", "노령", "노견"))} THEN 'senior'
  WHEN {sql_any("a", ("adult", "성견"))} THEN 'adult' ELSE 'unknown' END"""
_DESC = f"({sql_known('desc_full')})"


def _sql_said(phrases: dict) -> str:
    lit = lambda k: str(k).lower() if isinstance(k, bool) else _q(k)
    return f"CASE {' '.join(f'WHEN {sql_any(_DESC, words)} THEN {lit(k)}' for k, words in phrases.items())} END"


_HOURS = f"try_cast(nullif(replace(regexp_extract({_DESC}, '{profiles.ABSENCE}', 1), ',', '.'), '') AS DOUBLE)"
_CONSTANT = (
    "vlm_attributes", "upstream_updated_at", "safety_health_note", "safety_social_note", "behavior_evidence_source", "care_tel",
    "care_addr", "org_name", "happen_place", "happen_date",
)
SQL_FACTS = f"""SELECT *, {_GROUP} AS age_group, CASE WHEN kg > 0 THEN kg END AS weight_number, CASE WHEN kg <= 0 OR kg IS NULL THEN
  'unknown' WHEN kg <= 8 THEN 'small' WHEN kg <= 18 THEN 'medium' ELSE 'large' END AS size FROM (SELECT item_id,
  {sql_known("notice_id")} AS record_id, {_YEARS} AS years, coalesce({_AGE}, '') AS a, {SQL_KG} AS kg,
  CASE WHEN lower({sql_known("sex")}) IN ('m', 'male', '수', '수컷', '남아') THEN 'male' WHEN lower({sql_known("sex")}) IN
    ('f', 'female', '암', '암컷', '여아') THEN 'female' ELSE 'unknown' END AS sex,
  CASE WHEN lower({sql_known("neuter")}) IN ('y', 'yes', 'true', '1', '중성화', '완료') THEN 'yes' WHEN lower({sql_known("neuter")})
    IN ('n', 'no', 'false', '0', '미중성화', '안함') THEN 'no' ELSE 'unknown' END AS neutered,
  coalesce(split_part({sql_known("care_name")}, ' ', 1), 'unknown') AS region, coalesce({SQL_BREED}, 'unknown') AS breed,
  CASE WHEN regexp_matches({sql_known("breed")}, '^[0-9]+$') THEN {sql_known("breed")} ELSE '' END AS breed_code,
  coalesce({SQL_BREED}, '') AS breed_name, coalesce({sql_known("breed")}, '') AS breed_full_name,
  coalesce({sql_known("breed")}, '') AS breed_source_label, coalesce({sql_known("breed_source")}, '') AS breed_source, mixed_breed,
  coalesce({sql_known("color")}, '') AS color, coalesce({_DESC}, '') AS description,
  NULL::DOUBLE AS photo_quality_score, {sql_status("source_status", "notice_end")} AS notice_status,
  {sql_known("notice_end")} AS notice_end, {sql_known("notice_start")} AS notice_start, coalesce({sql_known("notice_no")}, '') AS notice_no,
  strftime(received_at, '%Y-%m-%d %H:%M:%S') AS last_verified_at, coalesce({sql_known("detail_url")}, '') AS source_url,
  array_to_string(list_filter([{", ".join(f"CASE WHEN contains({_DESC}, '{w}') THEN '{w}' END" for w in profiles.HEALTH)}],
    lambda x: x IS NOT NULL), ',') AS health_checks,
  coalesce({sql_known("care_name")}, 'unknown') AS care_name, '' AS housing_types, {_sql_said(profiles.ACTIVITY)} AS activity_level_hint,
  CASE WHEN {_HOURS} BETWEEN 0 AND 24 THEN {_HOURS} END AS max_absence_hours, {_sql_said(profiles.EXPERIENCE)} AS recommended_experience,
  {_sql_said(profiles.CHILDREN)} AS children_compatible, {_sql_said(profiles.OTHER_PETS)} AS other_pets_compatible,
  {", ".join(f"'' AS {c}" for c in _CONSTANT)} FROM notice_items)"""


def typed_facts(spark, sf):
    """Over forty typed columns of every item; a field that no column delivers is empty or unknown, never guessed."""
    items = table(spark, sf, "notice_items")
    items = items.withColumn("received_at", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss"))
    c = profiles.canonical(items)
    clean = items.select("item_id", "mixed_breed", *(v.alias(f"c_{k}") for k, v in c.items()))
    col = lambda k: F.col(f"c_{k}")
    text = lambda k: F.coalesce(col(k), F.lit(""))
    kg = N.first_number(col("weight"))
    years = profiles.age_years(col("age"), YEAR)
    words = F.nullif(N.age_bucket(F.when(~col("age").rlike(r"(?:19|20)[0-9]{2}"), col("age")), YEAR), F.lit(""))
    group = F.when(years <= 1, "puppy").when(years >= 8, "senior").when(years.isNotNull(), "adult").otherwise(F.coalesce(words, F.lit("unknown")))
    sex, neuter = F.lower(col("sex")), F.lower(col("neuter"))
    return clean.select(
        "item_id", col("record_id").alias("record_id"), years.alias("years"), group.alias("age_group"),
        F.when(kg > 0, kg).alias("weight_number"),
        F.when((kg <= 0) | kg.isNull(), "unknown").when(kg <= 8, "small").when(kg <= 18, "medium").otherwise("large").alias("size"),
        F.when(sex.isin("m", "male", "수", "수컷", "남아"), "male").when(sex.isin("f", "female", "암", "암컷", "여아"), "female").otherwise("unknown").alias("sex"),
        F.when(neuter.isin("y", "yes", "true", "1", "중성화", "완료"), "yes").when(neuter.isin("n", "no", "false", "0", "미중성화", "안함"), "no").otherwise("unknown").alias("neutered"),
        F.coalesce(F.substring_index(col("care_name"), " ", 1), F.lit("unknown")).alias("region"),
        F.coalesce(N.breed_name(col("breed")), F.lit("unknown")).alias("breed"),
        F.when(col("breed").rlike("^[0-9]+$"), col("breed")).otherwise("").alias("breed_code"),
        F.coalesce(N.breed_name(col("breed")), F.lit("")).alias("breed_name"), text("breed").alias("breed_full_name"),
        text("breed").alias("breed_source_label"), text("breed_source").alias("breed_source"), "mixed_breed",
        text("color").alias("color"), text("description").alias("description"),
        F.when(col("photo_quality").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), col("photo_quality").try_cast("double")))).alias("photo_quality_score"),
        N.notice_status(col("status"), N.notice_date(col("notice_end")), REFERENCE).alias("notice_status"),
        col("notice_end").alias("notice_end"), col("notice_start").alias("notice_start"), text("notice_no").alias("notice_no"),
        col("last_verified_at").alias("last_verified_at"), text("source_url").alias("source_url"),
        F.array_join(profiles.named_words(text("description"), profiles.HEALTH), ",").alias("health_checks"),
        F.coalesce(col("care_name"), F.lit("unknown")).alias("care_name"), text("housing").alias("housing_types"),
        profiles.said(col("description"), profiles.ACTIVITY).alias("activity_level_hint"),
        profiles.absence_hours(col("description")).alias("max_absence_hours"),
        profiles.said(col("description"), profiles.EXPERIENCE).alias("recommended_experience"),
        profiles.said(col("description"), profiles.CHILDREN).alias("children_compatible"),
        profiles.said(col("description"), profiles.OTHER_PETS).alias("other_pets_compatible"),
        F.lit("").alias("vlm_attributes"),
        *(text(c).alias(c) for c in _CONSTANT if c != "vlm_attributes"),
    )


_OUT = SQL_FACTS.replace("SELECT *,", "SELECT * EXCLUDE (a, kg),", 1)


@PROFILES.add("typed_facts", _OUT)
def typed_facts_query(spark, sf):
    return typed_facts(spark, sf)


# Comparisons: every profile whose id is divisible by 50 with the 20 items that share most with it. Profiles in the tables
# name size, age and region; what else a profile may tell is set by its id.

_ASKED = """SELECT DISTINCT profile_id AS query_id, preferred_size, preferred_age, preferred_region,
  ['apartment', 'house', 'other'][1 + profile_id % 3] AS housing, (profile_id % 13)::DOUBLE AS hours,
  ['low', 'medium', 'high'][1 + profile_id % 3] AS activity, ['none', 'some', 'experienced'][1 + profile_id % 3] AS experience_of,
  profile_id % 4 = 2 AS has_children, profile_id % 3 = 0 AS has_pets FROM appearance_profiles WHERE profile_id % 50 = 0"""
_KNOWN = f"SELECT item_id AS doc_id, nullif(size, 'unknown') AS size, nullif(age_group, 'unknown') AS age_group, notice_status AS status FROM ({_OUT})"
_ITEM_POOL = f"""SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(prior, 6) DESC, doc_id) AS n
  FROM (SELECT query_id, doc_id, sum({_W}) AS prior FROM (SELECT query_id, unnest(list_filter(['trait:body_size:' ||
  nullif(preferred_size, 'any'), 'age:' || nullif(preferred_age, 'any'), 'status:active'], lambda x: x IS NOT NULL)) AS feature
  FROM (SELECT DISTINCT query_id, preferred_size, preferred_age FROM ({_ASKED}))) JOIN (SELECT DISTINCT doc_id, unnest(list_filter([
  'trait:body_size:' || size, 'age:' || age_group, 'status:' || status], lambda x: x IS NOT NULL)) AS feature FROM ({_KNOWN}))
  USING (feature) GROUP BY ALL)) WHERE n <= 20"""
_KEY = lambda c: f"lower(regexp_replace({c}, '\\s+', '', 'g'))"
_LEVEL = lambda c: f"list_position(['none', 'some', 'experienced'], {c})"
_STATE = lambda applies, met: f"CASE WHEN {applies} THEN CASE WHEN ({met}) IS NULL THEN 'unknown' WHEN {met} THEN 'matched' ELSE 'caution' END END"
_STATES = {
    "size_state": _STATE("preferred_size <> 'any'", "nullif(size, 'unknown') = preferred_size"),
    "age_state": _STATE("preferred_age <> 'any'", "nullif(age_group, 'unknown') = preferred_age"),
    "region_state": _STATE(
        f"coalesce({_KEY('preferred_region')}, '') <> ''",
        f"CASE WHEN region <> 'unknown' THEN contains({_KEY('region')}, {_KEY('preferred_region')}) OR contains({_KEY('preferred_region')}, {_KEY('region')}) END",
    ),
    "housing_state": _STATE("true", "CASE WHEN housing_types <> '' THEN housing_types = housing END"),
    "activity_state": _STATE("true", "activity_level_hint = activity"),
    "absence_state": _STATE("true", "hours <= max_absence_hours"),
    "experience_state": _STATE("true", f"{_LEVEL('experience_of')} >= {_LEVEL('recommended_experience')}"),
    "children_state": _STATE("has_children", "children_compatible"),
    "pets_state": _STATE("has_pets", "other_pets_compatible"),
}
_STATED = f"""SELECT a.query_id, t.item_id AS doc_id, {", ".join(f"{v} AS {k}" for k, v in _STATES.items())} FROM ({_ITEM_POOL}) p
  JOIN ({_ASKED}) a USING (query_id) JOIN ({_OUT}) t ON t.item_id = p.doc_id"""


def _stated(spark, sf):
    p = table(spark, sf, "appearance_profiles").where("profile_id % 50 = 0")
    i = F.col("profile_id")
    pick = lambda *names: F.get(F.array(*(F.lit(n) for n in names)), (i % 3).cast("int"))
    asked = p.select(
        i.alias("query_id"), "preferred_size", "preferred_age", "preferred_region", pick("apartment", "house", "other").alias("housing"),
        (i % 13).cast("double").alias("hours"), pick("low", "medium", "high").alias("activity"),
        pick("none", "some", "experienced").alias("experience_of"), (i % 4 == 2).alias("has_children"), (i % 3 == 0).alias("has_pets"),
    ).distinct()
    t = typed_facts(spark, sf).withColumnRenamed("item_id", "doc_id")
    told = lambda c: F.nullif(c, F.lit("unknown"))
    web = graph.edges(t, F.col("doc_id"), {"trait:body_size": told("size"), "age": told("age_group"), "status": F.col("notice_status")})
    wanted = F.array(
        F.concat(F.lit("trait:body_size:"), F.nullif("preferred_size", F.lit("any"))),
        F.concat(F.lit("age:"), F.nullif("preferred_age", F.lit("any"))), F.lit("status:active"),
    )
    features = asked.select("query_id", F.explode(F.filter(wanted, lambda x: x.isNotNull())).alias("feature")).distinct()
    pool = graph.best_candidates(features, web, 20).select("query_id", "doc_id")
    listed = F.filter(F.split("housing_types", ","), lambda x: x != "")
    rows = pool.join(asked, "query_id").join(t.withColumn("housing_types", listed), "doc_id")
    states = profiles.condition_states()
    return rows.select("query_id", "doc_id", *(v.alias(k) for k, v in states.items()))


@PROFILES.add("condition_states", _STATED)
def condition_states(spark, sf):
    return _stated(spark, sf)


_N = lambda *kinds: "(" + " + ".join(f"coalesce({s} IN ({', '.join(map(_q, kinds))}), false)::INT" for s in _STATES) + ")"


@PROFILES.add(
    "compatibility",
    f"""SELECT query_id, doc_id, round({_N("matched")} / {_N("matched", "caution", "unknown")}, 6) AS compatibility,
    round({_N("matched", "caution")} / {_N("matched", "caution", "unknown")}, 6) AS evidence_coverage FROM ({_STATED})""",
)
def compatibility(spark, sf):
    both = profiles.compatibility_of(list(_STATES))
    return _stated(spark, sf).select("query_id", "doc_id", *(F.round(v, 6).alias(k) for k, v in both.items()))


@PROFILES.add(
    "known_dimensions",
    f"""SELECT dim, count(*) AS n, count(*) FILTER (WHERE v NOT IN ('unknown', '')) AS n_known FROM (SELECT
    unnest(['age_group', 'size', 'sex', 'neutered', 'region', 'breed', 'color']) AS dim,
    unnest([age_group, size, sex, neutered, region, breed, color]) AS v FROM ({_OUT})) GROUP BY dim""",
)
def known_dimensions(spark, sf):
    dims = ["age_group", "size", "sex", "neutered", "region", "breed", "color"]
    told = [F.count(F.when(~F.col(d).isin("unknown", ""), 1)).alias(d) for d in dims]
    one = typed_facts(spark, sf).agg(F.count(F.lit(1)).alias("n"), *told)
    return one.unpivot(["n"], dims, "dim", "n_known")


@PROFILES.add(
    "trusted_sources",
    "SELECT item_id, breed_source, coalesce(lower(trim(breed_source)) IN ('shelter', 'official', 'rescue_group'), false) AS trusted FROM notice_items",
)
def trusted_sources(spark, sf):
    ok = F.coalesce(F.lower(F.trim("breed_source")).isin(*profiles.TRUSTED_SOURCES), F.lit(False))
    return table(spark, sf, "notice_items").select("item_id", "breed_source", ok.alias("trusted"))


# Texts and keys made of fields.

_SEARCHED = ("notice_no", "breed", "breed_source", "sex", "age", "weight", "neuter", "color", "desc_full", "care_name", "provider_id", "species", "upkind", "source_status", "notice_start", "notice_end")


@PROFILES.add(
    "searchable_text",
    f"SELECT item_id, concat_ws(' ', {', '.join(sql_known(c) for c in _SEARCHED)}) AS search_text FROM notice_items",
)
def searchable_text(spark, sf):
    return table(spark, sf, "notice_items").select("item_id", F.concat_ws(" ", *(known(F.col(c)) for c in _SEARCHED)).alias("search_text"))


_SIGNED = f"""SELECT doc_id, array_to_string(list_filter([coalesce(size, 'any'), coalesce(age_group, 'any'), coalesce(sex, 'any')],
  lambda x: x IS NOT NULL), '|') AS signature FROM ({_FACTS}) WHERE size IS NOT NULL OR age_group IS NOT NULL"""


def signatures(spark, sf):
    parts = [F.coalesce(F.col(c), F.lit("any")) for c in ("size", "age_group", "sex")]
    known_ones = facts(spark, sf).where("size IS NOT NULL OR age_group IS NOT NULL")
    return known_ones.select("doc_id", F.concat_ws("|", *parts).alias("signature"))


@PROFILES.add("attribute_signatures", _SIGNED)
def attribute_signatures(spark, sf):
    return signatures(spark, sf)


@PROFILES.add(
    "training_prompts",
    f"""SELECT signature, unnest(['a photo of a ' || s[1] || ' dog', s[2] || ' dog, ' || s[1], '사진: ' || s[1] || ', ' || s[2]]) AS prompt,
    n FROM (SELECT signature, string_split(signature, '|') AS s, count(*) AS n FROM ({_SIGNED}) GROUP BY ALL)""",
)
def training_prompts(spark, sf):
    n = signatures(spark, sf).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    size, age = (F.get(F.split("signature", "\\|"), F.lit(k)) for k in (0, 1))
    prompts = F.array(
        F.concat(F.lit("a photo of a "), size, F.lit(" dog")), F.concat(age, F.lit(" dog, "), size),
        F.concat(F.lit("사진: "), size, F.lit(", "), age),
    )
    return n.select("signature", F.explode(prompts).alias("prompt"), "n")


@PROFILES.add(
    "blinded_display",
    f"SELECT upper(substr(sha256('blind|' || doc_id), 1, 10)) AS code, size, age_group, sex FROM ({_FACTS}) WHERE status = 'active'",
)
def blinded_display(spark, sf):
    code = F.upper(F.substring(F.sha2(F.concat(F.lit("blind|"), F.col("doc_id").cast("string")), 256), 1, 10))
    return facts(spark, sf).where("status = 'active'").select(code.alias("code"), "size", "age_group", "sex")


@PROFILES.add(
    "limited_labels",
    f"""SELECT doc_id, list_slice(list_sort(list(DISTINCT split_part(feature, ':', -1))), 1, 4) AS labels FROM (WITH facts AS ({_FACTS})
    {_EDGES}) GROUP BY doc_id""",
)
def limited_labels(spark, sf):
    label = F.substring_index("feature", ":", -1)
    rows = edges(facts(spark, sf)).groupBy("doc_id").agg(F.collect_set(label).alias("l"))
    return rows.select("doc_id", F.slice(F.array_sort("l"), 1, 4).alias("labels"))


@PROFILES.add(
    "species_codes",
    """SELECT item_id, CASE upkind WHEN '417000' THEN 'dog' WHEN '422400' THEN 'cat' WHEN '429900' THEN 'other' ELSE 'dog' END AS code,
    CASE WHEN lower(trim(species)) IN ('dog', 'cat', 'other') THEN lower(trim(species)) WHEN trim(species) IN ('개') THEN 'dog'
    WHEN trim(species) IN ('고양이') THEN 'cat' ELSE 'unknown' END AS species FROM notice_items""",
)
def species_codes(spark, sf):
    code = F.create_map(*(F.lit(x) for x in ("417000", "dog", "422400", "cat", "429900", "other")))
    bare = F.lower(F.trim("species"))
    return table(spark, sf, "notice_items").select(
        "item_id", F.coalesce(F.try_element_at(code, F.col("upkind")), F.lit("dog")).alias("code"),
        F.when(bare.isin("dog", "cat", "other"), bare).when(bare == "개", "dog").when(bare == "고양이", "cat").otherwise("unknown").alias("species"),
    )


@PROFILES.add(
    "search_windows",
    f"""SELECT item_id, CAST(coalesce({sql_date("notice_start")} - INTERVAL 30 DAY, DATE '{REFERENCE}' - INTERVAL 365 DAY)::DATE AS VARCHAR)
    AS window_start, '{REFERENCE}' AS window_end FROM notice_items""",
)
def search_windows(spark, sf):
    """From 30 days before the start of the notice, else a year before the reference date, to the reference date."""
    start = F.coalesce(F.date_sub(N.notice_date(F.col("notice_start")), 30), F.date_sub(F.lit(REFERENCE), 365))
    return table(spark, sf, "notice_items").select("item_id", start.cast("string").alias("window_start"), F.lit(str(REFERENCE)).alias("window_end"))


@PROFILES.add(
    "segmented_colors",
    """SELECT item_id, CASE WHEN rest = '' AND c <> '' THEN c END AS color_words FROM (SELECT item_id, c, regexp_replace(c,
    '갈색|흰색|검정|회색|크림|[&,/ ]', '', 'g') AS rest FROM (SELECT item_id, coalesce(color, '') AS c FROM notice_items))""",
)
def segmented_colors(spark, sf):
    """Colours made of words of a list only, longest words first; any residue makes it null."""
    words = sorted(("갈색", "흰색", "검정", "회색", "크림"), key=lambda w: (-len(w), w))
    c = F.coalesce("color", F.lit(""))
    rest = F.regexp_replace(c, "|".join(words) + "|[&,/ ]", "")
    return table(spark, sf, "notice_items").select("item_id", F.when((rest == "") & (c != ""), c).alias("color_words"))
