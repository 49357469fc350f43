"""Problems of record data: snapshots, units and packed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.functions import text
from ranklake.functions.text import fold_width, is_missing, notice_number
from ranklake.operators.packed_values import URL_PACKING, Packing, color_packing, unpacked
from ranklake.operators.quantities import common_units
from ranklake.operators.snapshots import snapshot_changes
from ranklake.plans.registry import Registry, table
from ranklake.session import bounded_rows

RECORDS = Registry()

#: Most entries of the reference list of one field whose names may part values at blanks.
MOST_NAMES = 10_000


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SQL_MISSING = ", ".join(_quoted(w) for w in text.MISSING_WORDS)


def sql_fold(c: str) -> str:
    wide, plain = _quoted(text._WIDE), _quoted(text._PLAIN)
    return f"replace(regexp_replace(translate({c}, {wide}, {plain}), '\\p{{Cf}}', '', 'g'), '㎏', 'kg')"


def sql_missing(c: str) -> str:
    folded = sql_fold(c)
    return f"({c} IS NULL OR lower(trim(regexp_replace({folded}, '\\s+', ' ', 'g'))) IN ({_SQL_MISSING}))"


def sql_notice_number(c: str) -> str:
    plain = f"trim(regexp_replace(upper({sql_fold(c)}), '[^0-9A-Z]+', '-', 'g'), '-')"
    shape = "'^([A-Z]{2})-?([0-9OIL]{2})-?([0-9OIL]{4})-?([0-9OIL]{1,8})$'"
    part = lambda k: f"translate(regexp_extract({plain}, {shape}, {k}), 'OIL', '011')"
    return (
        f"CASE WHEN {sql_missing(c)} THEN NULL WHEN regexp_matches({plain}, {shape}) THEN "
        f"regexp_extract({plain}, {shape}, 1) || {part(2)} || '-' || {part(3)} || '-' || lpad({part(4)}, 8, '0') "
        f"ELSE nullif({plain}, '') END"
    )


def plain_status(c):
    """A status without case, blanks and width; all missing ones are "unknown"."""
    bare = F.lower(F.regexp_replace(fold_width(c), r"[\s\p{Z}\p{Cf}]+", ""))
    long_way = F.when(is_missing(c), "unknown").otherwise(bare)
    words = F.when(c.isin(*text.MISSING_WORDS), "unknown").otherwise(c)
    return F.when(c.rlike(r"^[a-z가-힣()]+\z"), words).otherwise(long_way)


def color_names(spark: SparkSession, sf_dir: str) -> Packing:
    """How colours are packed; the reference list is refused beyond MOST_NAMES rows."""
    ref = table(spark, sf_dir, "ref_values").where("field_name = 'color'").select("label", "label_en", "aliases")
    names: list[str] = []
    for r in bounded_rows(ref, MOST_NAMES):
        names += [r.label, r.label_en, *(r.aliases or "").split("|")]
    return color_packing([n.strip() for n in names if n and n.strip()])


@RECORDS.add(
    "p1_found",
    f"""
WITH t AS (
  SELECT provider_id, snapshot_date, delivery_no, retrieved_at, {sql_notice_number("notice_id")} AS id,
    CASE WHEN {sql_missing("source_status")} THEN 'unknown'
      ELSE lower(regexp_replace({sql_fold("source_status")}, '\\s+', '', 'g')) END AS status
  FROM notice_snapshots),
d AS (
  SELECT *, lag(snapshot_date) OVER w AS before, lead(snapshot_date) OVER w AS after
  FROM (SELECT provider_id, snapshot_date, max(delivery_no) AS delivery_no FROM t GROUP BY ALL)
  WINDOW w AS (PARTITION BY provider_id ORDER BY snapshot_date)),
v AS (
  SELECT t.provider_id, t.snapshot_date, d.before, d.after, t.id, arg_max(t.status, t.retrieved_at) AS status
  FROM t JOIN d USING (provider_id, snapshot_date, delivery_no) WHERE t.id IS NOT NULL GROUP BY ALL),
m AS (
  SELECT coalesce(n.provider_id, w.provider_id) AS provider_id, coalesce(n.snapshot_date, w.after) AS snapshot_date,
    coalesce(n.id, w.id) AS notice_id,
    CASE WHEN w.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed'
      WHEN n.status <> w.status THEN 'changed' END AS change_kind
  FROM (SELECT * FROM v WHERE before IS NOT NULL) n FULL JOIN (SELECT * FROM v WHERE after IS NOT NULL) w
    ON n.provider_id = w.provider_id AND n.snapshot_date = w.after AND n.id = w.id)
SELECT * FROM m WHERE change_kind IS NOT NULL""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshot_changes(
        table(spark, sf_dir, "notice_snapshots"),
        owner=F.col("provider_id"),
        date=F.col("snapshot_date"),
        delivery=F.col("delivery_no"),
        seen_at=F.col("retrieved_at"),
        key=notice_number(F.col("notice_id")),
        content=[plain_status(F.col("source_status"))],
    )
    return changes.select(
        F.col("owner").alias("provider_id"), "snapshot_date", F.col("record_key").alias("notice_id"), "change_kind"
    )


_QUIET = "'\\s+', ' ', 'g'"
_PARTS = r"'([0-9][0-9,]*(?:\.[0-9]+)?)\s*\(?\s*([a-z]+|[가-힣]+)?'"
_BOUNDS = r"'미만|이하|이상|초과|이내|최소|최대|넘음|넘는|under|over|below|above|less than|more than|at least|at most|up to|within|[<>≤≥]'"
_RANGES = r"'[0-9]\s*\(?([a-z]+|[가-힣]+)?\)?\s*(~|-|to\s|에서|내지)\s*[0-9]'"
_LB, _OZ = "453.59237", "28.349523125"


def _sql_factor(field: str, c: str) -> str:
    """The factor of the first unit that a word, clause or note names."""
    units = {
        "weight": (
            ("kg|킬로|키로|kilo", "1000"), ("파운드|pound|(^|[^a-z])lbs?([^a-z]|$)", _LB),
            ("온스|ounce|(^|[^a-z])oz([^a-z]|$)", _OZ), ("그램|gram|(^|[^a-z])g([^a-z]|$)", "1"),
        ),
        "age": (
            ("개월|달|month|(^|[^a-z])(m|mo|mos)([^a-z]|$)", "30"), ("주|week|(^|[^a-z])(w|wk)([^a-z]|$)", "7"),
            ("살|년|세|year|(^|[^a-z])(y|yrs?)([^a-z]|$)", "365"), ("일|days?|(^|[^a-z])d([^a-z]|$)", "1"),
        ),
    }
    whens = " ".join(f"WHEN regexp_matches({c}, '{p}') THEN {f}::DECIMAL(18, 9)" for p, f in units[field])
    return f"CASE {whens} END"


def _sql_amounts(field: str) -> str:
    words = "체중|무게|몸무게|weight|mass" if field == "weight" else "나이|연령|월령|age"
    text = f"lower(trim(regexp_replace({sql_fold(field)}, {_QUIET})))"
    if field == "age":
        for n, word in enumerate("한 두 세 네 다섯 여섯 일곱 여덟 아홉 열".split(), 1):
            text = f"regexp_replace({text}, '^{word}\\s*(살|년|개월|달|주)', '{n}\\1')"
    born = r"'((^|[^0-9])(19|20)?[0-9][0-9]\s*\(?(년\s*생|\s*출생))|((19|20)[0-9][0-9]\s*[-./년]\s*[0-9]+\s*\(?\s*(년월생|월\s*생|출생))|^(19|20)[0-9][0-9]$'"
    clause = rf"regexp_extract(lower(coalesce(desc_full, '')), '[^,./;\n|]*({words})[^,./;\n|]*')"
    number = (
        "CASE WHEN regexp_matches(n, '^[0-9]{1,3}(,[0-9]{3})+(\\.[0-9]+)?$') THEN replace(n, ',', '') "
        "ELSE replace(regexp_replace(n, ',+$', ''), ',', '.') END::DECIMAL(19, 4)"
    )
    own = _sql_factor(field, "u")
    amount = f"""CASE WHEN len(ns) = 1 THEN {number.replace("(n,", "(ns[1],")} * coalesce({_sql_factor(field, "us[1]")},
      {_sql_factor(field, "lead")}, {_sql_factor(field, "clause")}, {_sql_factor(field, "lower(unit_note)")})
      WHEN len(list_filter(us, lambda u: ({own}) IS NULL)) = 0 THEN list_sum(list_transform(list_zip(ns, us),
      lambda z: ({number.replace("(n,", "(z[1],")}) * ({_sql_factor(field, "z[2]")}))) END"""
    return f"""SELECT item_id, '{field}' AS field_name, exact FROM (SELECT item_id, {amount} AS exact FROM (
      SELECT item_id, unit_note, {clause} AS clause, regexp_extract(v, '([a-z]+|[가-힣]+)[\\s:(]*[0-9]', 1) AS lead,
        regexp_extract_all(v, {_PARTS}, 1) AS ns, regexp_extract_all(v, {_PARTS}, 2) AS us
      FROM (SELECT *, {text} AS v FROM notice_items LEFT JOIN providers USING (provider_id) WHERE NOT {sql_missing(field)})
      WHERE NOT regexp_matches(v, {_BOUNDS}) AND NOT regexp_matches(v, {_RANGES})
        {f"AND NOT regexp_matches(v, {born})" if field == "age" else ""}) WHERE len(ns) > 0) WHERE exact IS NOT NULL"""


def _sql_births() -> str:
    v = f"lower(trim(regexp_replace({sql_fold('age')}, {_QUIET})))"
    first = r"'(?:^|[^0-9])((?:19|20)?[0-9][0-9])\s*\(?(?:년\s*생|\s*출생)'"
    both = r"'((?:19|20)[0-9][0-9])\s*[-./년]\s*([0-9]+)\s*\(?\s*(?:년월생|월\s*생|출생)'"
    bare = r"'^((?:19|20)[0-9][0-9])$'"
    return f"""SELECT item_id, 'age' AS field_name, CASE WHEN m = '' THEN (sy - y) * 365 ELSE ((sy - y) * 12 + sm - m::INT) * 30 END
      AS amount FROM (SELECT item_id, CASE WHEN y < 100 THEN 2000 + y ELSE y END AS y, m, substr(d, 1, 4)::INT AS sy,
      substr(d, 5, 2)::INT AS sm FROM (SELECT item_id, regexp_replace(notice_start, '[^0-9]', '', 'g') AS d,
        try_cast(coalesce(nullif(regexp_extract({v}, {both}, 1), ''), nullif(regexp_extract({v}, {first}, 1), ''),
          nullif(regexp_extract({v}, {bare}, 1), '')) AS INT) AS y, regexp_extract({v}, {both}, 2) AS m
        FROM notice_items WHERE NOT {sql_missing("age")}) WHERE length(d) = 8 AND y IS NOT NULL)"""


@RECORDS.add(
    "p4_found",
    f"""SELECT item_id, field_name, round(exact)::BIGINT AS amount FROM ({_sql_amounts("weight")}) WHERE exact > 0
    UNION ALL SELECT item_id, field_name, round(exact)::BIGINT FROM ({_sql_amounts("age")})
    UNION ALL SELECT item_id, field_name, amount FROM ({_sql_births()})""",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = common_units(
        table(spark, sf_dir, "notice_items"),
        table(spark, sf_dir, "providers").select("provider_id", F.col("unit_note").alias("note")),
        row_id=F.col("item_id"),
        weight=F.col("weight"),
        age=F.col("age"),
        desc=F.col("desc_full"),
        start=F.col("notice_start"),
        provider=F.col("provider_id"),
    )
    return amounts.select(F.col("row_id").alias("item_id"), "field_name", "amount")


def packed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpacked(
        table(spark, sf_dir, "notice_items"),
        F.col("item_id"),
        {"color": (F.col("color"), color_names(spark, sf_dir)), "image_urls": (F.col("image_urls"), URL_PACKING)},
    )


@RECORDS.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        packed_items(spark, sf_dir)
        .where("n_values >= 2")
        .select(F.col("row_id").alias("item_id"), "field_name", "item_no", "item_value")
    )
