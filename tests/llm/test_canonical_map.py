import pytest
from pyspark.sql import functions as F

from ranklake.llm.canonical_map import letters_apart, map_to_list, mapped_rows, readings, reference_names

REFS = [
    ("color", "C1", "갈색", "brown", "브라운|밤색"),
    ("color", "C2", "흰색", "white", None),
    ("color", "C3", "호피무늬", "brindle", "호랑무늬"),
    ("place", "R1", "가람시", "Garam-si", None),
    ("place", "R2", "검바위군", "Geombawi-gun", None),
    ("breed", "B1", "래브라도리트리버", "labrador retriever", "라브라도"),
    ("breed", "B2", "퍼그", "pug", ""),
    (None, "X", "nothing", None, None),
]
CASES = [
    ("color", "갈색", "C1"),
    ("color", " ＢＲＯＷＮ ", "C1"),
    ("color", "갈 색", "C1"),
    ("color", "브러운", "C1"),
    ("color", "biege", "none"),
    ("color", "brwon", "C1"),
    ("color", "호라무늬", "C3"),
    ("color", "갈색(귀, 발끝은 옅음)", "C1"),
    ("color", "어두운 흰색 위주", "C2"),
    ("color", "사진 참조", "none"),
    ("color", "갈기 있음", "none"),
    ("color", "", "none"),
    ("color", "???", "none"),
    ("place", "(가람시)", "R1"),
    ("place", "가람에 살아요", "R1"),
    ("place", "garam", "R1"),
    ("place", "희망: 가람시 3구역", "R1"),
    ("place", "검바위구", "R2"),
    ("place", "Gemobawi-gun", "R2"),
    ("place", "바다 건너", "none"),
    ("breed", "[개] 라브라도", "B1"),
    ("breed", "래브라도리리트리버", "B1"),
    ("breed", "labrador retreiver", "B1"),
    ("breed", "pgu", "B2"),
    ("breed", "아마 퍼그?", "B2"),
    ("breed", "포히히켈종", "none"),
    ("unlisted", "갈색", "none"),
]


@pytest.fixture(scope="module")
def names(spark):
    refs = spark.createDataFrame(REFS, "field_name string, ref_id string, label string, label_en string, aliases string")
    return reference_names(refs.withColumn("jamo", F.lit("clash")), ("place",))


def test_mapping(spark, names):
    data = [(f, v) for f, v, _ in CASES] * 2 + [("color", None), (None, "갈색")]
    got = map_to_list(spark.createDataFrame(data, "field string, value string"), names).collect()
    assert {(r.field, r.value): r.ref_id for r in got} == {(f, v): i for f, v, i in CASES}
    assert len(got) == len(CASES)


def test_ties_mean_none(spark):
    names = reference_names(
        spark.createDataFrame(
            [("f", "1", "abcde", None, None), ("f", "2", "abcdf", None, None), ("f", "3", "abcde", None, None)],
            "field_name string, ref_id string, label string, label_en string, aliases string",
        )
    )
    values = spark.createDataFrame([("f", "abcdg"), ("f", "abcde")], "field string, value string")
    got = {r.value: r.ref_id for r in map_to_list(values, names).collect()}
    assert got == {"abcdg": "none", "abcde": "1"}


def test_empty_tables_and_long_values(spark, names):
    schema = "field string, value string"
    assert map_to_list(spark.createDataFrame([], schema), names).collect() == []
    long = "갈색 " + "아주 " * 20_000
    (row,) = map_to_list(spark.createDataFrame([("color", long)], schema), names).collect()
    assert row.ref_id == "C1"
    none = names.limit(0)
    (row,) = map_to_list(spark.createDataFrame([("color", "갈색")], schema), none).collect()
    assert row.ref_id == "none"


def test_names_of_many_words(spark):
    refs = [("f", "1", "a b c d e f g h", None, None), ("f", "2", "ij", None, None)]
    names = reference_names(spark.createDataFrame(refs, "field_name string, ref_id string, label string, label_en string, aliases string"))
    values = spark.createDataFrame([("f", "it is a b c d e f g h or so"), ("f", "z")], "field string, value string")
    assert {r.value[:2]: r.ref_id for r in map_to_list(values, names).collect()} == {"it": "1", "z": "none"}


def test_rows(spark, names):
    rows = spark.createDataFrame(
        [("color", 1, "갈색"), ("color", 1, "갈색"), ("color", 2, "갈색"), ("place", 1, "x")],
        "field string, row_id int, value string",
    )
    mapping = map_to_list(rows.select("field", "value"), names)
    got = sorted(tuple(r) for r in mapped_rows(rows, mapping).collect())
    assert got == [("color", 1, "C1"), ("color", 2, "C1"), ("place", 1, "none")]


def test_helpers():
    assert readings("[개] 믹스견", 9)["믹스견"] and not readings("a b c d", 9).get("bc")
    assert "abc" not in readings("x a b c", 2) and "bc" in readings("x a b c", 2)
    assert letters_apart("감정색", "검정색") == pytest.approx(0.8)
    assert letters_apart("abc", "acb") == pytest.approx(0.9)
