import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ranklake.operators.evaluation import latest_ratings
from ranklake.sources.readers import (
    ContractError, checked_csv, file_digests, first_files_win, notices_json, paged_json, result_contract, text_blocks, zip_members,
)
from ranklake.sources.sinks import append_rating, canonical_rows, fingerprint, replaced, separate


def test_notices(spark, tmp_path):
    one = {"notice_id": "a", "species": "dog", "image_urls": ["u"], "other": 1}
    (tmp_path / "list.json").write_text(json.dumps([one, {"notice_id": "b", "species": ""}, {"notice_id": "c", "species": "cat"}]))
    (tmp_path / "wrapped.json").write_text(json.dumps({"items": {"notice_id": "d"}}))
    got = notices_json(spark, str(tmp_path), "dog").collect()
    assert sorted(r.notice_id for r in got) == ["a", "b", "d"] and all(len(r.file_sha256) == 64 for r in got)
    (tmp_path / "bad.json").write_text(json.dumps([{"notice_id": "unknown"}]))
    with pytest.raises(Exception, match="without id"):
        notices_json(spark, str(tmp_path)).collect()
    assert file_digests(spark, str(tmp_path)).count() == 3


def test_paged_source(spark, tmp_path):
    page = lambda item: json.dumps({"response": {"body": {"items": {"item": item}}}})
    (tmp_path / "page1.json").write_text(page([{"desertionNo": "1", "x": "가"}, {"x": 2}, 5]))
    (tmp_path / "page2.json").write_text(page({"desertionNo": 2}))
    (tmp_path / "page3.json").write_text(page([]))
    (tmp_path / "page4.json").write_text(page([{"desertionNo": "9"}]))
    got = paged_json(spark, str(tmp_path), "desertionNo").collect()
    assert sorted((r.page, r.id) for r in got if r.id) == [(1, "1"), (2, "2")] and len(got) == 3
    assert json.loads(next(r.payload for r in got if r.id == "1"))["x"] == "가"


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("x/p1-10.jpg", "x/p1-2.jpg", "p2-1.png", "readme.txt"):
            z.writestr(name, b"x")
    got = {r.item_id: r.members for r in zip_members(spark, str(tmp_path)).collect()}
    assert got == {"p1": ["x/p1-2.jpg", "x/p1-10.jpg"], "p2": ["p2-1.png"]}


def test_checked_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("﻿rater,item,grade\nR1,a,2\nR2,a,3\n")
    schema, rules = "rater string, item string, grade int", {"grade": F.col("grade").between(0, 3)}
    expected = spark.createDataFrame([("R1", "a"), ("R2", "a")], "rater string, item string")
    assert checked_csv(spark, str(good), schema, ["rater", "item"], rules, expected).count() == 2
    for text, why in [
        ("rater,grade\nR1,2\n", "header"),
        ("rater,item,grade\nR1,a,7\n", "rules"),
        ("rater,item,grade\nR1,a,1\nR1,a,1\n", "repeat"),
        ("rater,item,grade\nR1,a,1\n", "missing"),
        ("rater,item,grade\nR1,a,1\nR2,a,1\nR3,a,1\n", "not expected"),
    ]:
        bad = tmp_path / "bad.csv"
        bad.write_text(text)
        with pytest.raises(ContractError, match=why):
            checked_csv(spark, str(bad), schema, ["rater", "item"], rules, expected)


def test_blocks(spark, tmp_path):
    (tmp_path / "q.txt").write_text("[query]\nid=1\ntext=a = b\n[query]\r\nid=2\n\nnoise\n")
    got = text_blocks(spark, str(tmp_path / "q.txt")).orderBy("block_no").collect()
    assert [dict(r.fields) for r in got] == [{"id": "1", "text": "a = b"}, {"id": "2"}]


def test_first_files_win(spark):
    a = spark.createDataFrame([("x", 2, "a2"), ("x", 1, "a1")], "id string, pos int, v string")
    b = spark.createDataFrame([("x", 0, "b"), ("y", 0, "b")], "id string, pos int, v string")
    assert sorted((r.id, r.v) for r in first_files_win([a, b], "id", "pos").collect()) == [("x", "a1"), ("y", "b")]


def test_contract(spark):
    df = spark.createDataFrame([("p", "1"), ("p", "1")], "provider_id string, notice_id string")
    assert result_contract(df, "p", 2) == {"n": 2, "n_ids": 1}
    for args in (("q", 2), ("p", 3)):
        with pytest.raises(ContractError):
            result_contract(df, *args)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    path = f"{tmp_path}/out"
    replaced(df, path)
    replaced(spark.read.parquet(path).where("n = 1"), path)
    assert spark.read.parquet(path).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["out"]
    assert fingerprint(df) == fingerprint(df.orderBy(F.desc("n"))) != fingerprint(df.limit(1))
    assert [r.json for r in canonical_rows(df).collect()] == ['{"n":1,"s":"a"}', '{"n":2}']
    with pytest.raises(ValueError):
        separate(["/a/"], ["file:/a"])
    separate(["/a"], ["/b"])


def test_rating_log(spark, tmp_path):
    schema = "id long, rater string, pair_id string, score int, skipped boolean, updated timestamp"
    row = lambda i, s, t: (i, "R", "p", s, False, t)
    from datetime import datetime

    t = datetime(2026, 1, 1)
    append_rating(spark.createDataFrame([row(1, 1, t)], schema), f"{tmp_path}/log")
    append_rating(spark.createDataFrame([row(2, 3, t)], schema), f"{tmp_path}/log")
    (r,) = latest_ratings(spark.read.parquet(f"{tmp_path}/log")).collect()
    assert (r.id, r.score) == (2, 3)
