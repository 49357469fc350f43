import pytest
from pyspark.sql import functions as F

from ranklake.operators.ngram_index import edit_distance
from ranklake.operators.quantities import alias_dictionary, common_units

NOTES = [
    ("kg", "무게는 킬로그램, 나이는 살(년)로 적습니다."),
    ("lb", "Weight is in pounds when no unit is given; age is in months."),
    ("g", "저울 값 그대로(g) 입력함. 나이는 주령(week)."),
    ("none", None),
]
WEIGHTS = [
    ("7.5(Kg)", "lb", None, 7500),
    ("7,5kg", "lb", None, 7500),
    ("7,500 g", "lb", None, 7500),
    ("９．５ｋｇ", "lb", None, 9500),
    ("3㎏", "lb", None, 3000),
    ("10", "lb", None, 4536),
    ("10", "kg", "활발함, 체중은 파운드로 잰 값", 4536),
    ("10", "kg", "활발함, 10 파운드", 10000),
    ("10", "none", None, None),
    ("10", None, None, None),
    ("6파운드 8온스", "kg", None, 2948),
    ("약 4키로", "g", None, 4000),
    ("kg 9.5", "g", None, 9500),
    ("체중: 2.5 kg", "g", None, 2500),
    ("9 kg(측정 당시)", "g", None, 9000),
    ("5 killogramms", "g", None, 5000),
    ("5-6kg", "kg", None, None),
    ("5.5~6.5(Kg)", "kg", None, None),
    ("5kg 미만", "kg", None, None),
    ("0(Kg)", "kg", None, None),
    ("소형", "kg", None, None),
    ("unknown", "kg", None, None),
    ("", "kg", None, None),
    (None, "kg", None, None),
]
AGES = [
    ("2024(년생)", "kg", "20260105", 730),
    ("'23년생", "kg", "2026.01.05", 1095),
    ("2026", "g", "2026-01-05", 0),
    ("2024(년생)", "kg", None, None),
    ("2025-03 출생", "kg", "20260105", 300),
    ("2025.11(년월생)", "kg", "20260105", 60),
    ("2025년 12월생", "kg", "20260105", 30),
    ("1살 6개월", "g", None, 545),
    ("2y 3m", "g", None, 820),
    ("1,2살", "g", None, 438),
    ("두 살", "g", None, 730),
    ("열살", "g", None, 3650),
    ("생후9개월", "g", None, 270),
    ("10", "g", None, 70),
    ("10", "lb", None, 300),
    ("60일 미만", "kg", None, None),
    ("3~4살", "kg", None, None),
    ("3살 이상", "kg", None, None),
    ("노령", "kg", None, None),
]
SCHEMA = "item_id int, weight string, age string, desc_full string, notice_start string, provider_id string, unit string, field string"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    notes = spark.createDataFrame(NOTES, "provider_id string, note string")
    c = F.col
    out = common_units(
        df, notes, row_id=c("item_id"), weight=c("weight"), age=c("age"), desc=c("desc_full"), start=c("notice_start"),
        provider=c("provider_id"),
    )
    return {(r.row_id, r.field_name): r.amount for r in out.collect()}


def test_weights_and_ages(spark):
    rows = [(i, w, None, d, None, p, "x", "y") for i, (w, p, d, _) in enumerate(WEIGHTS)]
    rows += [(100 + i, None, a, None, s, p, "x", "y") for i, (a, p, s, _) in enumerate(AGES)]
    got = run(spark, rows + rows)
    want = {(i, "weight"): x for i, (*_, x) in enumerate(WEIGHTS) if x is not None}
    want |= {(100 + i, "age"): x for i, (*_, x) in enumerate(AGES) if x is not None}
    assert got == want


def test_empty_and_long(spark):
    assert run(spark, []) == {}
    long = "5kg" + " 아주 온순함" * 20_000
    assert run(spark, [(1, long, None, long, None, "kg", "", "")]) == {(1, "weight"): 5000}


def test_dictionary(spark):
    words = ["kilogrammes", "파운드로", "pounds", "no", "in", "mo", "추정", "그램입니다", "ears", "kgg", ""]
    df = spark.createDataFrame([(f, w) for f in ("weight", "age") for w in words], "field string, spelling string")
    got = {(r.field, r.spelling): r.unit for r in alias_dictionary(df).collect()}
    assert got == {
        ("weight", "kilogrammes"): "kg", ("weight", "파운드로"): "lb", ("weight", "pounds"): "lb",
        ("weight", "그램입니다"): "g", ("age", "mo"): "month", ("age", "ears"): "year",
    }


@pytest.mark.parametrize(("a", "b", "d"), [("", "", 0), ("ab", "ba", 1), ("abb", "ab", 0.8), ("pounds", "pound", 0.1), ("가", "나", 1)])
def test_edit_distance(a, b, d):
    assert edit_distance(a, b, cheap_tail=("s",), twin=0.8) == pytest.approx(d)
