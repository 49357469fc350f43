"""Queries over notices and texts: normalising, predicates, text functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ranklake.functions import vocabulary as V
from ranklake.functions.text import known
from ranklake.functions.urls import picture_key
from ranklake.operators import notices as N
from ranklake.plans.records import sql_missing
from ranklake.plans.registry import Registry, table

NOTICES = Registry()
REFERENCE = date(2026, 2, 15)
YEAR = 2026

_q = lambda s: "'" + s.replace("'", "''") + "'"


def sql_any(c: str, terms) -> str:
    return "coalesce(" + " OR ".join(f"contains(lower({c}), {_q(t.lower())})" for t in terms) + ", false)"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\p{{Z}}\\p{{Cf}}]+|[\\s\\p{{Z}}\\p{{Cf}}]+$', '', 'g')"


def sql_known(c: str) -> str:
    return f"CASE WHEN {sql_missing(c)} THEN NULL ELSE {sql_trim(c)} END"


def sql_date(c: str) -> str:
    return f"try_strptime({c}, ['%Y%m%d', '%Y-%m-%d', '%Y.%m.%d'])::DATE"


def sql_status(state: str, end: str) -> str:
    text = f"coalesce({sql_known(state)}, '')"
    low = f"lower(replace({text}, ' ', ''))"
    adopt = sql_any(f"replace({text}, ' ', '')", V.ADOPTION_OPEN_TOKENS)
    ends = sql_date(end)
    return f"""CASE WHEN {low} IN ('closed', 'inactive') THEN 'closed' WHEN {low} = 'expired' THEN 'expired'
      WHEN {sql_any(text, V.HARD_CLOSED_TOKENS)} THEN 'closed'
      WHEN contains({text}, '입양') AND NOT {adopt} THEN 'closed'
      WHEN {ends} < DATE '{REFERENCE}' THEN 'expired'
      WHEN {low} = 'active' OR {adopt} OR {sql_any(text, V.ACTIVE_TOKENS)} THEN 'active'
      WHEN {ends} >= DATE '{REFERENCE}' THEN 'active' ELSE 'unknown' END"""


SQL_KG = "try_cast(nullif(regexp_extract(replace(weight, ',', ''), '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE)"


def sql_size(kg: str) -> str:
    return f"CASE WHEN {kg} <= 3 THEN 'tiny' WHEN {kg} <= 8 THEN 'small' WHEN {kg} <= 18 THEN 'medium' WHEN {kg} IS NOT NULL THEN 'large' END"


_BORN = "try_cast(nullif(regexp_extract(coalesce(age, ''), '((?:19|20)\\d{2})', 1), '') AS INT)"
SQL_AGE = f"""CASE WHEN {_BORN} IS NOT NULL THEN CASE WHEN {YEAR} - {_BORN} <= 1 THEN 'puppy'
    WHEN {YEAR} - {_BORN} >= 8 THEN 'senior' ELSE 'adult' END
  WHEN {sql_any("coalesce(age, '')", ("puppy", "개월", "새끼"))} THEN 'puppy'
  WHEN {sql_any("coalesce(age, '')", ("senior", "노령", "노견"))} THEN 'senior'
  WHEN {sql_any("coalesce(age, '')", ("adult", "성견"))} THEN 'adult' ELSE '' END"""
_BREED = "trim(regexp_replace(regexp_replace(regexp_replace(breed, '^\\s*\\[[^\\]]*\\]\\s*', ''), '[\\s\\p{Z}\\p{Cf}]+', ' ', 'g'), '^ | $', '', 'g'))"
SQL_BREED = f"CASE WHEN NOT {sql_missing(_BREED)} AND NOT regexp_matches({_BREED}, '^[0-9]+$') THEN {_BREED} END"


def typed(spark, sf):
    """The typed projection of every item; texts are cleaned once, in a step of their own."""
    clean = table(spark, sf, "notice_items").withColumns(
        {"state": known(F.col("source_status")), "ends": N.notice_date(known(F.col("notice_end")))}
    )
    return clean.select(
        "item_id",
        "provider_id",
        N.notice_status(F.col("state"), F.col("ends"), REFERENCE).alias("status"),
        N.notice_date(F.col("notice_start")).cast("string").alias("start_date"),
        N.notice_date(F.col("notice_end")).cast("string").alias("end_date"),
        N.breed_name(F.col("breed")).alias("breed"),
        N.first_number(F.col("weight")).alias("weight_number"),
        N.size_bucket(N.first_number(F.col("weight"))).alias("size"),
        N.age_bucket(F.col("age"), YEAR).alias("age_group"),
        F.when(F.col("sex").isin("M", "F"), F.col("sex")).alias("sex"),
        N.flag(F.col("neuter")).alias("neutered"),
        F.coalesce(F.col("mixed_breed"), F.col("breed").contains("믹스")).alias("mixed"),
        "care_name",
    )


SQL_TYPED = f"""SELECT item_id, provider_id, {sql_status("source_status", "notice_end")} AS status,
  CAST({sql_date("notice_start")} AS VARCHAR) AS start_date, CAST({sql_date("notice_end")} AS VARCHAR) AS end_date,
  {SQL_BREED} AS breed, {SQL_KG} AS weight_number, {sql_size(SQL_KG)} AS size, {SQL_AGE} AS age_group,
  CASE WHEN sex IN ('M', 'F') THEN sex END AS sex,
  CASE WHEN lower(trim(neuter)) IN ('true', 'yes', 'y', '1', 'active', '검색가능') THEN true
    WHEN lower(trim(neuter)) IN ('false', 'no', 'n', '0', 'inactive', '검색불가') THEN false END AS neutered,
  coalesce(mixed_breed, contains(breed, '믹스')) AS mixed, care_name FROM notice_items"""


@NOTICES.add("notice_projection", SQL_TYPED)
def notice_projection(spark, sf):
    return typed(spark, sf)


@NOTICES.add("status_counts", f"SELECT provider_id, status, count(*) AS n FROM ({SQL_TYPED}) GROUP BY ALL")
def status_counts(spark, sf):
    return typed(spark, sf).groupBy("provider_id", "status").agg(F.count(F.lit(1)).alias("n"))


@NOTICES.add(
    "searchable_notices",
    f"SELECT item_id, status FROM ({SQL_TYPED}) WHERE status IN ('active', 'unknown')",
)
def searchable_notices(spark, sf):
    return typed(spark, sf).where("status IN ('active', 'unknown')").select("item_id", "status")


@NOTICES.add(
    "missing_to_null",
    f"""SELECT item_id, {sql_known("source_status")} AS source_status, {sql_known("color")} AS color,
    {sql_known("weight")} AS weight FROM notice_items""",
)
def missing_to_null(spark, sf):
    cols = ("source_status", "color", "weight")
    return table(spark, sf, "notice_items").select("item_id", *(known(F.col(c)).alias(c) for c in cols))


@NOTICES.add(
    "field_coverage",
    "SELECT field, count(*) AS n_rows, count(*) FILTER (WHERE v IS NOT NULL) AS n_known, "
    "round(count(*) FILTER (WHERE v IS NOT NULL) / count(*), 6) AS share FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, {sql_known(c)} AS v FROM notice_items"
        for c in ("source_status", "breed", "color", "weight", "age", "desc_full", "image_urls")
    )
    + ") GROUP BY field",
)
def field_coverage(spark, sf):
    cols = ("source_status", "breed", "color", "weight", "age", "desc_full", "image_urls")
    items = table(spark, sf, "notice_items").select(*(known(F.col(c)).alias(c) for c in cols))
    each = items.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count(c).alias(c) for c in cols))
    return each.unpivot(["n_rows"], list(cols), "field", "n_known").select(
        "field", "n_rows", "n_known", F.round(F.try_divide("n_known", "n_rows"), 6).alias("share")
    )


@NOTICES.add(
    "labelled_fields",
    f"""SELECT item_id, concat_ws(', ', '품종 ' || ({sql_known("breed")}), '색 ' || ({sql_known("color")}),
    '나이 ' || ({sql_known("age")}), '체중 ' || ({sql_known("weight")}), '특징 ' || ({sql_known("desc_full")}))
    AS public_text FROM notice_items""",
)
def labelled_fields(spark, sf):
    fields = {"품종": "breed", "색": "color", "나이": "age", "체중": "weight", "특징": "desc_full"}
    return table(spark, sf, "notice_items").select(
        "item_id", N.labelled_text({k: F.col(c) for k, c in fields.items()}).alias("public_text")
    )


@NOTICES.add(
    "split_distinct_list",
    """SELECT item_id, array_to_string(list_filter(list_transform(parts, lambda x, i:
      CASE WHEN list_position(parts, x) = i THEN x END), lambda x: x IS NOT NULL), '|') AS parts, len(list_distinct(parts)) AS n
    FROM (SELECT item_id, list_filter(list_transform(regexp_split_to_array(coalesce(desc_full, ''), '[,;|\\n]+'),
      lambda x: trim(x, ' \t\n\r')), lambda x: x <> '') AS parts FROM notice_items)""",
)
def split_distinct_list(spark, sf):
    parts = N.listed(F.col("desc_full"))
    return table(spark, sf, "notice_items").select(
        "item_id", F.array_join(parts, "|").alias("parts"), F.size(parts).cast("long").alias("n")
    )


# Text functions over the documents.


@NOTICES.add(
    "word_frequency",
    """SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[0-9A-Za-z가-힣]+')) AS t FROM documents),
    LATERAL (SELECT lower(t) AS token) GROUP BY token HAVING count(*) >= 3 AND length(token) > 1""",
)
def word_frequency(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(N.tokens(F.col("text"))).alias("token"))
    return words.where("length(token) > 1").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@NOTICES.add(
    "word_frequency_top",
    """SELECT token, n, rank FROM (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rank FROM (
      SELECT lower(t) AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[0-9A-Za-z가-힣]+')) AS t
      FROM documents) GROUP BY 1)) WHERE rank <= 50""",
)
def word_frequency_top(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(N.tokens(F.col("text"))).alias("token"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # A limit is the feature: the fifty most frequent; TakeOrdered keeps fifty rows a task.
    top = counts.orderBy(F.desc("n"), "token").limit(50)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")))


# The blanks of Python's isspace; RE2 and Java read the class alike.
_NO_BLANK = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"


@NOTICES.add(
    "char_frequency",
    f"SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_NO_BLANK}')) AS ch FROM documents) GROUP BY ch",
)
def char_frequency(spark, sf):
    """Every character that is no blank: digits, marks and single letters of Hangul too; by code point, so no half of a pair."""
    chars = F.regexp_extract_all("text", F.lit(f"({_NO_BLANK})"), F.lit(1))
    docs = table(spark, sf, "documents").select(F.explode(chars).alias("ch"))
    return docs.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


@NOTICES.add(
    "char_bigram_frequency",
    f"""SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) AS gram FROM
    (SELECT regexp_extract_all(unnest([desc_full, breed]), '{_NO_BLANK}') AS c FROM notice_items) WHERE len(c) >= 2) GROUP BY gram""",
)
def char_bigram_frequency(spark, sf):
    """Pairs of neighbouring characters of descriptions and breeds, blanks left out first."""
    texts = table(spark, sf, "notice_items").select(F.explode(F.array("desc_full", "breed")).alias("text"))
    chars = texts.select(F.regexp_extract_all("text", F.lit(f"({_NO_BLANK})"), F.lit(1)).alias("c")).where("size(c) >= 2")
    grams = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.get("c", i - 1), F.get("c", i)))
    return chars.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def _sql_labels(c: str, mapping, broader=None) -> str:
    tests = {k: sql_any(c, t) for k, t in mapping.items()}
    if broader:
        s, b = broader
        rest = c
        for t in mapping[s]:
            rest = f"regexp_replace({rest}, '(?i){t}', ' ', 'g')"
        tests[b] = f"({tests[b]} AND (NOT {tests[s]} OR {sql_any(rest, mapping[b])}))"
    each = ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in tests.items())
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


def _sql_facets(c: str) -> dict[str, str]:
    out = {n: _sql_labels(c, t, V.BROADER.get(n)) for n, t in V.FACETS.items()}
    young = f"regexp_matches({c}, '어린([^이]|$)')"
    out["age_hint"] = (
        f"CASE WHEN {young} AND NOT list_contains({out['age_hint']}, 'puppy') "
        f"THEN list_append({out['age_hint']}, 'puppy') ELSE {out['age_hint']} END"
    )
    out["personality"] = (
        "list_filter([" + ", ".join(f"CASE WHEN contains({c}, '{t}') THEN '{t}' END" for t in V.PERSONALITY_TERMS)
        + "], lambda x: x IS NOT NULL)"
    )
    return out


@NOTICES.add(
    "query_facets",
    "SELECT doc_id, "
    + ", ".join(f"array_to_string({s}, ',') AS {n}" for n, s in _sql_facets("text").items())
    + " FROM documents",
)
def query_facets(spark, sf):
    facets = N.parsed_query(F.col("text"))
    names = [*V.FACETS, "personality"]
    return table(spark, sf, "documents").select("doc_id", *(F.array_join(facets[n], ",").alias(n) for n in names))


@NOTICES.add(
    "query_keywords",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[0-9A-Za-z가-힣]+'),
    lambda x: lower(x)), lambda x: length(x) > 1 AND x NOT IN ({", ".join(_q(s) for s in V.STOPWORDS)}))[1:20], ' ') AS keywords
    FROM documents""",
)
def query_keywords(spark, sf):
    words = N.parsed_query(F.col("text"))["keywords"]
    return table(spark, sf, "documents").select("doc_id", F.array_join(words, " ").alias("keywords"))


_F = _sql_facets("text")


@NOTICES.add(
    "expanded_queries",
    "SELECT doc_id, md5(concat_ws(' ', nullif(t, ''), "
    + ", ".join(
        f"CASE WHEN len({_F[n]}) > 0 THEN '{lab} ' || array_to_string({_F[n]}, ' ') END" for n, lab in V.FACET_LABELS.items()
    )
    + f""", CASE WHEN {sql_any("text", ("얼굴 안", "얼굴 가려", "얼굴이 안", "face hidden"))} THEN NULL
      WHEN {sql_any("text", ("얼굴 잘", "얼굴이 잘", "정면", "눈이 잘", "face visible"))} THEN '얼굴이 잘 보이는 사진' END,
    CASE WHEN {sql_any("text", ("전신", "몸 전체", "whole body"))} THEN '전신이 보이는 사진' END)) AS expanded_md5
    FROM (SELECT doc_id, text, {sql_trim("text")} AS t FROM documents)""",
)
def expanded_queries(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(N.expanded_query(text, N.parsed_query(text)).cast("binary")).alias("expanded_md5")
    )


@NOTICES.add(
    "cnf_groups",
    """SELECT doc_id FROM documents WHERE (contains(text, '산책') OR contains(text, 'walk')) AND
    (contains(text, '사람') OR contains(text, '가족') OR contains(text, 'famil'))""",
)
def cnf_groups(spark, sf):
    groups = (("산책", "walk"), ("사람", "가족", "famil"))
    ok = F.lit(True)
    for g in groups:
        hit = F.lit(False)
        for t in g:
            hit = hit | F.col("text").contains(t)
        ok = ok & hit
    return table(spark, sf, "documents").where(ok).select("doc_id")


@NOTICES.add(
    "edit_distances",
    "SELECT p_partkey, levenshtein(p_name, 'small ring') AS distance FROM part",
)
def edit_distances(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.levenshtein("p_name", F.lit("small ring")).cast("long").alias("distance")
    )


@NOTICES.add(
    "one_letter_typos",
    """WITH t AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part),
    n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part)
    SELECT t.w AS token, u.w AS entry FROM t, (SELECT * FROM t UNION SELECT * FROM n) u
    WHERE length(t.w) = length(u.w) AND hamming(t.w, u.w) = 1""",
)
def one_letter_typos(spark, sf):
    part = table(spark, sf, "part")
    first = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w")).distinct()
    second = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w")).distinct()
    # Words one substitution apart agree once the letter at one place is masked: an equi join, not all pairs.
    masks = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.overlay("w", F.lit("\x00"), i, F.lit(1)))
    keyed = lambda d, name: d.select(F.col("w").alias(name), F.explode(masks).alias("mask"))
    pairs = keyed(first, "token").join(keyed(first.union(second).distinct(), "entry"), "mask")
    return pairs.where("token <> entry").select("token", "entry").distinct()


@NOTICES.add(
    "evidence_windows",
    """SELECT doc_id, array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN len(list_filter(hits,
      lambda h: h IS NOT NULL AND abs(h - i) <= 3)) > 0 THEN x END), lambda x: x IS NOT NULL)[1:60], ' ') AS evidence
    FROM (SELECT doc_id, w, list_transform(w, lambda x, i: CASE WHEN contains(x, '산책') THEN i END) AS hits
      FROM (SELECT doc_id, regexp_extract_all(text, '[0-9A-Za-z가-힣]+') AS w FROM documents))
    WHERE len(list_filter(hits, lambda h: h IS NOT NULL)) > 0""",
)
def evidence_windows(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text").contains("산책"))
    docs = docs.select("doc_id", F.regexp_extract_all("text", F.lit("[0-9A-Za-z가-힣]+"), 0).alias("w"))
    docs = docs.withColumn("hits", F.filter(F.transform("w", lambda x, i: F.when(x.contains("산책"), i)), lambda h: h.isNotNull()))
    near = F.filter("w", lambda x, i: F.exists("hits", lambda h: F.abs(h - i) <= 3))
    return docs.where(F.size("hits") > 0).select("doc_id", F.array_join(F.slice(near, 1, 60), " ").alias("evidence"))


@NOTICES.add(
    "strip_markup",
    """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '<[^<>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' '))
    AS plain_md5 FROM documents WHERE contains(text, '<')""",
)
def strip_markup(spark, sf):
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", "<[^<>]+>", " "), r"[ \t\r\n]+", " "))
    docs = table(spark, sf, "documents").where(F.col("text").contains("<"))
    return docs.select("doc_id", F.md5(plain.cast("binary")).alias("plain_md5"))


_PII = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|01[016789][- ]?[0-9]{3,4}[- ]?[0-9]{4}|[0-9]{6}-[1-4][0-9]{6}"


@NOTICES.add("personal_data_gate", f"SELECT doc_id, regexp_matches(text, '{_PII}') AS rejected FROM documents")
def personal_data_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").rlike(_PII).alias("rejected"))


_SECRET = r"(?i)(?:api[_-]?key|secret|token|password)\s*[=:]\s*[A-Za-z0-9_\-]{8,}|/p/[0-9a-f]{7}"


@NOTICES.add(
    "secret_lines",
    f"""SELECT DISTINCT doc_id, i AS line_no FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(line, '{_SECRET}')""",
)
def secret_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike(_SECRET)).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no")).distinct()


@NOTICES.add(
    "document_links",
    r"""SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9./_-]+')) AS link FROM documents
    WHERE regexp_matches(text, 'https?://[A-Za-z0-9./_-]+')""",
)
def document_links(spark, sf):
    found = F.regexp_extract_all("text", F.lit("https?://[A-Za-z0-9./_-]+"), 0)
    return table(spark, sf, "documents").select("doc_id", F.explode(found).alias("link"))


@NOTICES.add("picture_keys")
def picture_keys(spark, sf):
    return table(spark, sf, "stock_images").select("image_id", picture_key(F.col("image_url")).alias("picture"))


@NOTICES.add(
    "labels_in_text",
    """SELECT d.doc_id, r.ref_id FROM documents d, ref_values r WHERE r.field_name = 'preferred_region' AND
    regexp_matches(d.text, '(^|[^0-9A-Za-z가-힣])' || r.label ||
      '(으로|로|은|는|이|가|을|를|와|과|도|만|의|에서|에)?($|[^0-9A-Za-z가-힣])')""",
)
def labels_in_text(spark, sf):
    """Whole-word labels of a bounded dictionary in every text: tokens meet labels in an equi join, particles stripped."""
    refs = table(spark, sf, "ref_values").where("field_name = 'preferred_region'").select("ref_id", "label")
    word = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9A-Za-z가-힣]+"), 0))).alias("word")
    words = table(spark, sf, "documents").select("doc_id", word)
    bare = F.regexp_replace("word", "(?:으로|로|은|는|이|가|을|를|와|과|도|만|의|에서|에)$", "")
    forms = words.select("doc_id", F.explode(F.array_distinct(F.array("word", bare))).alias("label"))
    return forms.join(refs, "label").select("doc_id", "ref_id").distinct()


@NOTICES.add(
    "asserted_hints",
    """SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '.{0,4}산책.{0,8}'),
      lambda x: NOT regexp_matches(x, '(안|못) {0,2}산책') AND NOT regexp_matches(x, '산책.{0,6}(않|없|아니|못)'))) > 0""",
)
def asserted_hints(spark, sf):
    near = F.regexp_extract_all(F.lower("text"), F.lit(".{0,4}산책.{0,8}"), 0)
    ok = F.exists(near, lambda x: ~x.rlike("(안|못) {0,2}산책") & ~x.rlike("산책.{0,6}(않|없|아니|못)"))
    return table(spark, sf, "documents").where(ok).select("doc_id")

