import unicodedata

import pytest
from pyspark.sql import functions as F

from ranklake.llm.truncation import MEASURES, _single_stops, bare_of, cut_rates, ending_of, endings, hidden_limits, measured_sizes, read_texts, words

SENTENCES = ["밥을 잘 먹고 있습니다", "다른 개와 잘 지냅니다", "산책을 아주 좋아합니다"]
SCHEMA = "doc_id int, source string, text string, is_cut boolean, size int"
CASES = [
    ("밥을 잘 먹고 있습니다.", False),
    ("밥을 잘 먹고 있습니다", False),
    ("밥을 잘 먹고 있습", True),
    ("밥을 잘 먹고", True),
    ("밥을 잘 먹고...", True),
    ("밥을 잘 먹고 있습니다…", False),
    ("밥을 잘 먹고 있습니다 . . .", False),
    ("다른 개와 잘 지냅�", True),
    ("다른 개와 잘 지냅니다.<br", True),
    ("다른 개와 잘 지냅니다.</p>", False),
    ("다른 개와 잘 지냅&nbs", True),
    ("다른 개와,", True),
    ("산책을 X-", True),
    (unicodedata.normalize("NFD", "산책을 아주 좋아합"), True),
    (unicodedata.normalize("NFD", "산책을 아주 좋아합니다"), False),
    (unicodedata.normalize("NFD", "산책을 아주 좋아합니다")[:-1], True),
    ("산책을 아주 좋아합니다. (끝)", False),
    ("산책을 아주 좋아합니다. ♥", False),
    ("산책을 아주 좋아합니다. #가족", False),
    ("", False),
    (None, False),
    ("-", False),
    ("?", False),
]


@pytest.fixture(scope="module")
def corpus():
    texts = [". ".join(SENTENCES[i % 3 :] + SENTENCES[: i % 3]) + "." for i in range(40)]
    return [(1000 + i, "s", t, True, 0) for i, t in enumerate(texts)]


def test_endings(spark, corpus):
    rows = [(i, "s" if i % 2 else None, t, None, None) for i, (t, _) in enumerate(CASES)]
    got = {r.doc_id: r.is_cut for r in endings(spark.createDataFrame(corpus + rows, SCHEMA)).collect()}
    assert {i: got[i] for i in range(len(CASES))} == {i: c for i, (_, c) in enumerate(CASES)}
    assert not any(v for k, v in got.items() if k >= 1000)
    rates = {r.source: r for r in cut_rates(endings(spark.createDataFrame(corpus + rows, SCHEMA))).collect()}
    assert rates[None].n_docs == 12 and rates[None].n_cut == sum(c for i, (_, c) in enumerate(CASES) if i % 2 == 0)


def test_texts_at_a_limit_need_less_evidence(spark, corpus):
    whole = " ".join(s + "." for s in SENTENCES * 4)
    heap = [(i, "lim", (f"글{i}. " + whole)[:100], None, None) for i in range(12)]
    odd = [(50, "lim", "가" * 90 + ". " + "나" * 8, None, None), (51, "s", "가" * 40 + ". " + "라" * 8, None, None)]
    docs = spark.createDataFrame(corpus + heap + odd, SCHEMA)
    limits = {(r.source, r.measure): r.size_limit for r in hidden_limits(docs).collect() if r.source == "lim"}
    assert limits["lim", "characters"] == 100
    got = {r.doc_id: (r.is_cut, r.at_limit) for r in endings(docs).collect()}
    assert got[50] == (True, True) and got[51] == (False, False)


def test_every_limit_of_a_source_is_found(spark):
    sizes = [100] * 30 + [101, 102, 103, 104, 105] + [300] * 14 + [600] * 4 + [599] * 6
    docs = spark.createDataFrame([(i, "lim", "가" * n, None, None) for i, n in enumerate(sizes)], SCHEMA)
    limits = {r.size_limit for r in hidden_limits(docs).collect() if r.measure == "characters"}
    assert limits == {100, 300, 600}
    got = {r.doc_id: r.at_limit for r in endings(docs).collect()}
    assert all(got[i] == (n not in range(101, 106)) for i, n in enumerate(sizes))


@pytest.mark.parametrize("n", [1, 9, 30, 200])
def test_copies_of_a_cut_text_are_no_evidence(spark, corpus, n):
    copies = [(i, "s", "오늘도 다른 개와 잘" + " " * (i % 2), None, None) for i in range(n)]
    lone = [(500 + i, "s", "어제 본 새로운 가" * 2, None, None) for i in range(n)]
    whole = [(800, "s", "새로운 가족을 찾습니다. 새로운 가방도 있습니다. 새로운 가게가 있습니다.", None, None)]
    got = {r.doc_id: r.is_cut for r in endings(spark.createDataFrame(corpus + copies + lone + whole, SCHEMA)).collect()}
    assert all(got[i] for i in range(n)) and not got[800]
    assert len({got[500 + i] for i in range(n)}) == 1 and got[500]


def test_empty_and_long(spark, corpus):
    assert endings(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hidden_limits(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "밥을 잘 먹고 있습니다. " * 20_000
    rows = [(1, "s", long, None, None), (1, "s", long, None, None), (2, "s", long + "밥을 잘", None, None)]
    got = sorted((r.doc_id, r.is_cut) for r in endings(spark.createDataFrame(corpus + rows, SCHEMA)).collect() if r.doc_id < 9)
    assert got == [(1, False), (1, False), (2, True)]


def test_lengths(spark):
    text = '가a"&\n<b>\r\n�'
    df = spark.createDataFrame([(text,)], "t string")
    got = dict(zip(MEASURES, df.select(measured_sizes(F.col("t"))).first()[0], strict=True))
    kept = text.rstrip("�")
    assert got["characters"] == len(kept) and got["utf8_bytes"] == len(kept.encode())
    assert got["double_byte"] == len(kept.encode("cp949"))
    assert got["json_ascii"] == len(__import__("json").dumps(kept)) - 2
    assert got["entities"] == len(__import__("html").escape(kept)) - 0
    assert got["crlf"] == len(kept) + 1


def test_helpers(spark):
    assert [bare_of(t) for t in ("a b.. ", "a b.", "a… …", "나", "a. ..", "a.…", "..")] == ["a b", "a b.", "a", "나", "a", "a.", ""]
    nfd = spark.createDataFrame([(unicodedata.normalize("NFD", "각"),), ("x",), (None,)], "t string")
    assert [r[0].text for r in nfd.select(read_texts(F.col("t"))).collect()] == ["각", None, None]
    line = spark.createDataFrame([("A b, 12. c\n- d",)], "t string")
    parts = line.select(words(F.col("t")).alias("w")).select(_single_stops(F.col("w"))).first()[0]
    assert parts == ["A", "b", "\x03", "00", "\x02", "c", "\x02", "d"]


def test_whole_texts_are_inspected():
    far = "가" * 500
    assert ending_of(f"글 ({far} 나") == "markup" and ending_of(f"글 ({far}) 나") == "open"
    assert ending_of(f'글 <a href="{far}') == "markup" and ending_of(f"글 https://{far}.") == "open"


def test_limits_of_few_units(spark):
    sizes = [1] * 40 + [14] * 40 + [60] * 40 + [120] * 40 + [200] * 40 + [400] * 40
    docs = spark.createDataFrame([(i, "lim", "가" * n, None, None) for i, n in enumerate(sizes)], SCHEMA)
    limits = {r.size_limit for r in hidden_limits(docs).collect() if r.measure == "characters"}
    assert limits == {14, 60, 120, 200, 400}


def test_words_of_any_length(spark, corpus):
    rows = [
        (1, "s", "밥을 잘 " + "a" * 1_000_000, None, None), (2, "s", "밥을 잘 " + "a" * 999_999 + " 먹고 있습니다.", None, None),
        (3, "s", ". " * 50_000 + "밥을 잘", None, None), (4, "s", "밥을 잘 먹고 있습니다." + " " * 200_000, None, None),
    ]
    got = {r.doc_id: r.is_cut for r in endings(spark.createDataFrame(corpus + rows, SCHEMA)).collect() if r.doc_id < 9}
    assert got == {1: False, 2: False, 3: True, 4: False}
