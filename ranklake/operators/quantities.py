"""Quantities recorded in different units, brought to one unit per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.functions.text import fold_width, is_missing, squeezed
from ranklake.operators.ngram_index import edit_distance, indexed_cosine, with_distance
from ranklake.session import cut, stored

# Units with their size in the unit of the result, and their usual spellings.
UNITS: dict[str, dict[str, tuple[str, tuple[str, ...]]]] = {
    "weight": {
        "kg": ("1000", ("kg", "kgs", "kilogram", "kilo", "킬로그램", "킬로", "키로", "키로그램")),
        "g": ("1", ("g", "gr", "gram", "그램")),
        "lb": ("453.59237", ("lb", "lbs", "pound", "파운드")),
        "oz": ("28.349523125", ("oz", "ounce", "온스")),
    },
    "age": {
        "year": ("365", ("y", "yr", "yrs", "year", "년", "살", "세")),
        "month": ("30", ("m", "mo", "mos", "month", "개월", "달", "개월령")),
        "week": ("7", ("w", "wk", "week", "주", "주령")),
        "day": ("1", ("d", "day", "일", "일령")),
        # Counted from, not multiplied: the number is a year or month of birth.
        "birth": ("0", ("년생", "년월생", "월생", "출생", "년출생", "월출생", "born")),
    },
}

# Words that name the quantity, number words, and words of a bound.
QUANTITY_WORDS = {"weight": "체중|무게|몸무게|weight|mass", "age": "나이|연령|월령|age"}
NUMBER_WORDS = ("한", "두", "세", "네", "다섯", "여섯", "일곱", "여덟", "아홉", "열")
BOUND_WORDS = (
    "미만|이하|이상|초과|이내|최소|최대|넘음|넘는|under|over|below|above|less than|more than|at least|at most|up to|"
    "within|min\\.|max\\.|[<>≤≥]|\\d\\s*\\+"
)
PARTICLES = ("으로", "로", "은", "는", "이", "가", "을", "를", "입니다", "임", "정도", "가량", "s")

_NUMBER = r"\d[\d,]*(?:\.\d+)?"
_WORD = r"[a-z]+|[가-힣]+"


def plain_quantity(c: Column) -> Column:
    """The text in lower case and plain width, number words before a unit as digits."""
    text = F.lower(squeezed(fold_width(c)))
    for n, word in reversed(list(enumerate(NUMBER_WORDS, 1))):
        text = F.regexp_replace(text, rf"(?<![가-힣]){word}\s*(?=살|년|개월|달|주)", str(n))
    return text


def number(c: Column) -> Column:
    """Digits with a decimal point or comma, or commas between thousands, as a decimal."""
    grouped = c.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$")
    return F.when(grouped, F.replace(c, F.lit(","), F.lit(""))).otherwise(
        F.replace(F.regexp_replace(c, ",+$", ""), F.lit(","), F.lit("."))
    ).try_cast("decimal(18,6)")


def day_of(c: Column) -> Column:
    """Eight digits from a date in any of the usual ways of writing it, null otherwise."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(digits.rlike(r"^\d{8}$"), digits)


def alias_dictionary(spellings: DataFrame, most: float = 0.3) -> DataFrame:
    """The unit that each distinct spelling means: ``field, spelling, unit, factor``; spellings of no unit are left out.

    ``spellings(field, spelling)``. Candidates come from a character n-gram inverted index over the usual spellings;
    they are verified by a weighted edit distance in which a final plural s or particle costs 0.1 and a doubled letter
    0.8. It may be at most ``most`` of the spelling's length, and spellings of up to 3 letters must be exact but for the
    cheap tail. If the nearest two units are as near, the spelling means none.
    """
    spark = spellings.sparkSession
    lexicon = spark.createDataFrame(
        [(f, u, s) for f, units in UNITS.items() for u, (_, names) in units.items() for s in names],
        "field string, ref_id string, name string",
    )
    sizes = spark.createDataFrame(
        [(f, u, factor) for f, units in UNITS.items() for u, (factor, _) in units.items()],
        "field string, unit string, factor string",
    ).withColumn("factor", F.col("factor").cast("decimal(18,9)"))
    asked = spellings.select("field", F.col("spelling").alias("text"))
    near = indexed_cosine(asked, lexicon, (1, 2))
    near = near.where(F.abs(F.length("text") - F.length("name")) <= 4)
    near = with_distance(
        near, "text", "name", "distance", lambda a, b: edit_distance(a, b, cheap_tail=PARTICLES, twin=0.8)
    )
    allowed = F.when(F.length("text") <= 3, 0.2).otherwise(F.greatest(F.lit(0.2), F.length("text") * F.lit(most)))
    best = (
        near.where(F.col("distance") <= allowed)
        .groupBy("field", "text", "ref_id")
        .agg(F.min("distance").alias("distance"))
        .withColumn("place", F.rank().over(Window.partitionBy("field", "text").orderBy("distance")))
        .where("place = 1")
        .groupBy("field", F.col("text").alias("spelling"))
        .agg(F.min("ref_id").alias("unit"), F.count(F.lit(1)).alias("ties"))
        .where("ties = 1")
    )
    return best.join(F.broadcast(sizes), ["field", "unit"]).select("field", "spelling", "unit", "factor")


def _mentions(field: str, text: Column, desc: Column) -> Column:
    """Each number of the value with every word that may name its unit: the word after it, before it, in the description."""
    text = F.regexp_replace(text, r"\([^()]*\d[^()]*\)", "")
    whole = rf"({_NUMBER})\s*\(?\s*({_WORD})?"
    numbers = F.regexp_extract_all(text, F.lit(whole), 1)
    after = F.regexp_extract_all(text, F.lit(whole), 2)
    before = F.regexp_extract(text, rf"(?<![a-z가-힣])({_WORD})[\s:(]*\d", 1)
    alone = F.size(numbers) == 1
    clauses = F.split(F.lower(fold_width(F.coalesce(desc, F.lit("")))), r"[,./;\n|]")
    clause = F.array_join(F.filter(clauses, lambda x: x.rlike(QUANTITY_WORDS[field])), " ")
    hints = F.regexp_extract_all(clause, F.lit(f"({_WORD})"), 1)
    entry = lambda n, role, i, w: F.struct(
        F.lit(field).alias("field"), n.alias("part"), F.lit(role).alias("role"), i.alias("pos"), w.alias("spelling"),
        F.get(numbers, n).alias("digits"), F.size(numbers).alias("parts"),
    )
    own = F.transform(after, lambda w, i: entry(i, 0, F.lit(0), w))
    lead = F.when(alone, F.array(entry(F.lit(0), 1, F.lit(0), before)))
    told = F.when(alone, F.transform(hints, lambda w, i: entry(F.lit(0), 2, i, w)))
    none = F.array().cast(
        "array<struct<field:string,part:int,role:int,pos:int,spelling:string,digits:string,parts:int>>"
    )
    return F.concat(own, F.coalesce(lead, none), F.coalesce(told, none))


def common_units(
    df: DataFrame,
    notes: DataFrame,
    *,
    row_id: Column,
    weight: Column,
    age: Column,
    desc: Column,
    start: Column,
    provider: Column,
) -> DataFrame:
    """Weights in grams and ages in days: ``row_id, field_name, amount BIGINT, unit``, ``notes(provider_id, note)``.

    The unit of a number is the word after it, else before it, else what the description says in a clause about this
    quantity, else what the provider's note names; spellings are mapped by ``alias_dictionary``. Several numbers with a
    unit each are added. Ranges, bounds, missing values, words without number, zero weights, numbers whose unit stays
    unknown and birth years without a start date give no row. From a year of birth the age is the difference of the
    years x 365, with a month the difference in months x 30. Repeated rows with one id and content count once. A null in
    any column is a missing value, an empty table gives no rows, very long texts are read whole.
    """
    base = df.select(
        row_id.alias("row_id"),
        provider.alias("provider_id"),
        desc.alias("desc"),
        day_of(start).alias("start"),
        F.when(~is_missing(weight), plain_quantity(weight)).alias("weight"),
        F.when(~is_missing(age), plain_quantity(age)).alias("age"),
    )
    # Years of birth.
    y = r"(?:^|[^0-9])'?((?:19|20)\d\d|\d\d)"
    born = rf"{y}\s*\(?(?:년\s*생|\s*출생)|{y}\s*[-./년]\s*(\d\d?)\s*\(?\s*(?:년월생|월\s*생|출생|월\s*출생)|^((?:19|20)\d\d)$|born\D*(\d{{4}})"
    year = F.coalesce(*(F.nullif(F.regexp_extract("age", born, k), F.lit("")) for k in (1, 2, 4, 5))).cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    month = F.nullif(F.regexp_extract("age", born, 3), F.lit("")).cast("int")
    s_year, s_month = F.substring("start", 1, 4).cast("int"), F.substring("start", 5, 2).cast("int")
    is_birth = F.coalesce(F.col("age").rlike(born), F.lit(False))
    birth_word = F.regexp_replace(F.regexp_extract("age", r"((?:년|월)?\s*(?:월\s*)?(?:생|출생)|born)", 1), r"\s+", "")
    # A bare year of four digits is one of birth without saying so.
    birth_word = F.when(F.col("age").rlike(r"^(?:19|20)\d\d$"), "년생").otherwise(birth_word)
    births = base.where(is_birth & F.col("start").isNotNull()).select(
        "row_id",
        birth_word.alias("spelling"),
        F.lit("age").alias("field_name"),
        F.when(month.isNull(), (s_year - year) * 365)
        .otherwise(((s_year - year) * 12 + s_month - month) * 30)
        .cast("bigint")
        .alias("amount"),
        F.lit("birth").alias("unit"),
    )
    # Numbers with units.
    limited = lambda c: c.rlike(BOUND_WORDS) | c.rlike(rf"\d\s*\(?(?:{_WORD})?\)?\s*(?:~|-|to\s|에서|내지)\s*\d")
    none = F.array().cast(
        "array<struct<field:string,part:int,role:int,pos:int,spelling:string,digits:string,parts:int>>"
    )
    of = lambda name, ok: F.when(
        F.col(name).isNotNull() & ok & ~limited(F.col(name)), _mentions(name, F.col(name), F.col("desc"))
    ).otherwise(none)
    said = base.select(
        "row_id",
        "provider_id",
        F.xxhash64("provider_id", "desc", "weight", "age").alias("content"),
        F.explode(F.concat(of("weight", F.lit(True)), of("age", ~is_birth))).alias("m"),
    ).select("row_id", "provider_id", "content", "m.*")
    said = stored(said, "mentions")
    births = stored(births, "births")
    words = notes.select(
        F.col("provider_id").alias("n_provider"),
        F.posexplode(F.regexp_extract_all(F.lower(fold_width(F.col("note"))), F.lit(f"({_WORD})"), 1)).alias(
            "pos", "spelling"
        ),
    ).withColumn("field", F.explode(F.array(*(F.lit(f) for f in UNITS))))
    distinct = (
        said.where("spelling <> ''").select("field", "spelling").union(words.select("field", "spelling"))
        .union(births.select(F.lit("age"), "spelling")).distinct()
    )
    aliases = cut(alias_dictionary(distinct))
    of_birth = aliases.where("unit = 'birth'").select("spelling")
    birth = births.join(of_birth, "spelling", "left_semi").select("row_id", "field_name", "amount", "unit")
    aliases = aliases.where("unit <> 'birth'")
    noted = (
        words.join(aliases, ["field", "spelling"])
        .groupBy(F.col("n_provider"), F.col("field").alias("n_field"))
        .agg(F.min(F.struct("pos", "unit", "factor")).alias("n"))
    )
    found = (
        said.join(aliases, ["field", "spelling"], "left")
        .groupBy("row_id", "field", "content", "provider_id", "part", "digits", "parts")
        .agg(F.min(F.when(F.col("unit").isNotNull(), F.struct("role", "pos", "unit", "factor"))).alias("own"))
        .join(
            noted, F.col("provider_id").eqNullSafe(F.col("n_provider")) & (F.col("field") == F.col("n_field")), "left"
        )
    )
    alone = F.col("parts") == 1
    factor = F.coalesce(F.col("own.factor"), F.when(alone, F.col("n.factor")))
    unit = F.coalesce(F.col("own.unit"), F.when(alone, F.col("n.unit")))
    amount = number(F.col("digits")) * factor
    added = (
        found.groupBy("row_id", "field", "content")
        .agg(
            F.sum(amount).alias("exact"),
            F.count(F.when(amount.isNull(), 1)).alias("unclear"),
            F.array_join(F.array_sort(F.collect_set(unit)), "+").alias("unit"),
        )
        .where("unclear = 0")
        .where("field <> 'weight' OR exact > 0")
        .select("row_id", F.col("field").alias("field_name"), F.round("exact").cast("bigint").alias("amount"), "unit")
    )
    return added.unionByName(birth).distinct()
