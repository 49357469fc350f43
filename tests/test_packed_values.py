import pytest
from pyspark.sql import functions as F

from ranklake.operators.packed_values import URL_PACKING, color_packing, packed_values, unpacked

NAMES = ["갈색", "흰색", "black", "은색", "cream", "삼색"]

CASES = [
    (None, []),
    ("", []),
    (" 　", []),
    ("N/A", []),
    ("갈색", ["갈색"]),
    ("갈색 /", ["갈색"]),
    ("갈색,,흰색, 갈색", ["갈색", "흰색", "갈색"]),
    ('"흰색"', ["흰색"]),
    ('"밝은 흰색/은색 혼합",옅은 은색', ["밝은 흰색/은색 혼합", "옅은 은색"]),
    ('"흰색 ""별"" 무늬","cream"', ['흰색 "별" 무늬', "cream"]),
    ('흰색 "별" 무늬; 갈색', ['흰색 "별" 무늬', "갈색"]),
    ('["cream", "삼색"]', ["cream", "삼색"]),
    ('["a \\"b\\", c", "d"]', ['a "b", c', "d"]),
    ("[]", []),
    ('15" 흰색, 갈색', ['15" 흰색', "갈색"]),
    ("갈색(귀, 발)、흰색", ["갈색(귀, 발)", "흰색"]),
    ("갈색(귀, 발", ["갈색(귀", "발"]),
    ("갈색 흰색 Black", ["갈색", "흰색", "Black"]),
    ("갈색 위주", ["갈색 위주"]),
    ("연한 갈색 진한 흰색 위주", ["연한 갈색", "진한 흰색 위주"]),
    ("white 및 cream", ["white", "cream"]),
    ('"갈색 흰색"', ["갈색 흰색"]),
]
URLS = [
    ("https://a/c_fit,w_640/y.jpg,https://b/x;v=1", ["https://a/c_fit,w_640/y.jpg", "https://b/x;v=1"]),
    ('https://a/1,"https://b/2","HTTP://c/3",https://d/,', ["https://a/1", "https://b/2", "HTTP://c/3", "https://d/"]),
    ("https://a/1||https://b/2\r\n\thttps://c/3 ", ["https://a/1", "https://b/2", "https://c/3"]),
    ('["https:\\/\\/a/1", "https://a/1"]', ["https://a/1", "https://a/1"]),
]


def values(spark, cases, packing):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    out = df.select("i", packed_values(F.col("t"), packing).alias("v")).orderBy("i").collect()
    return [r.v for r in out]


def test_colors(spark):
    assert values(spark, CASES, color_packing(NAMES)) == [v for _, v in CASES]


def test_urls(spark):
    assert values(spark, URLS, URL_PACKING) == [v for _, v in URLS]


def test_long_text(spark):
    text = ",".join(["갈색", '"a,b"'] * 20_000)
    (got,) = values(spark, [(text, None)], color_packing(NAMES))
    assert len(got) == 40_000 and got[1] == "a,b"


@pytest.mark.parametrize("empty", [True, False])
def test_rows_and_places(spark, empty):
    data = [] if empty else [(1, "a;b", 5), (1, "a;b", 5), (None, "c", None)]
    df = spark.createDataFrame(data, "item_no int, v string, n_values int")
    got = unpacked(df, F.col("item_no"), {"f": (F.col("v"), color_packing(NAMES))}).collect()
    want = [] if empty else [(1, "f", 1, "a", 2), (1, "f", 2, "b", 2)] * 2 + [(None, "f", 1, "c", 1)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
