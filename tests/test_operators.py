"""Operators against values worked out by hand and against NumPy."""

import hashlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklake.operators import encoders, evaluation, fusion, graph, lexical, pictures, splits, statistics, sync, vectors
from ranklake.operators import notices as N


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


STATUS = [
    ("보호중", None, None, "active"),
    ("종료(입양)", "20301231", None, "closed"),
    ("입양 가능", "20251231", None, "expired"),
    ("입양대기", None, None, "active"),
    ("입양", None, None, "closed"),
    ("Active", "2026-02-14", None, "expired"),
    ("active", "2026.02.15", None, "active"),
    (None, "20260301", None, "active"),
    (None, "20260301", False, "closed"),
    (None, None, True, "active"),
    (None, "not a date", None, "unknown"),
    ("expired", "20300101", None, "expired"),
]


def test_status(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(STATUS)], "i int, s string, e string, x boolean")
    c = N.notice_status(F.col("s"), N.notice_date(F.col("e")), date(2026, 2, 15), F.col("x"))
    assert [r[0] for r in df.orderBy("i").select(c).collect()] == [r[3] for r in STATUS]


def test_small_columns(spark):
    lit = F.lit
    r = one(
        spark, N.first_number(lit("약 1,234.5 kg")), N.size_bucket(lit(8.0)), N.age_bucket(lit("2018(년생)"), 2026),
        N.breed_name(lit("[개] 믹스견 ")), N.breed_name(lit("114")), N.listed(lit("a, b;a|\n c")), N.flag(lit("No")),
        N.tokens(lit("Hi 강아지3, é")), N.first_region(lit("서울 강남"), [("b", ("부산",)), ("s", ("서울", "강남"))]),
    )
    assert list(r) == [1234.5, "small", "senior", "믹스견", None, ["a", "b", "c"], False, ["hi", "강아지3"], "s"]


def test_facets(spark):
    text = F.lit("황색 작은 미니 강아지 어린이와 사람 좋아 전신 사진 잘")
    p = N.parsed_query(text)
    r = one(spark, *(p[n].alias(n) for n in p))
    assert r.coat_color == ["tan"] and r.body_size_hint == ["tiny", "small"] and r.age_hint == []
    assert r.personality == ["사람 좋아"] and r.whole_body_visible and r.min_photo_quality == 0.65 and r.face_visible is None
    assert one(spark, N.parsed_query(F.lit("미니"))["body_size_hint"])[0] == ["tiny"]
    assert one(spark, N.parsed_query(F.lit("갈색 황갈색"))["coat_color"])[0] == ["brown", "tan"]
    assert one(spark, N.whole_word(F.lit("귀여운 푸들은 좋아"), F.lit("푸들")), N.whole_word(F.lit("푸들견"), F.lit("푸들")))[:] == (True, False)


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "개 개 산책"), (2, "산책"), (3, None), (4, "고양이")], "doc_id int, text string")
    q = spark.createDataFrame([(9, "개 개 없는말")], "query_id int, query_text string")
    (r,) = lexical.bm25(docs, F.col("doc_id"), F.col("text"), q).collect()
    idf, mean = np.log(1 + 3.5 / 1.5), 5 / 4
    assert (r.query_id, r.doc_id) == (9, 1)
    assert r.bm25 == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / mean)))


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_nearest_against_numpy(spark, metric, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (80, 5)).astype(float)
    g = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "doc_id int, vector array<double>")
    q = g.where("doc_id < 20").select(F.col("doc_id").alias("query_id"), "vector")
    got = {(r.query_id, r.rank): r.doc_id for r in vectors.nearest(q, g.repartition(5), 4, metric=metric).collect()}
    s = x @ x.T if metric == "ip" else -((x[:, None] - x[None]) ** 2).sum(-1)
    for i in range(20):
        order = sorted((j for j in range(80) if j != i), key=lambda j: (-s[i, j], j))[:4]
        assert [got[i, k + 1] for k in range(4)] == order
    assert vectors.nearest(q.limit(0), g, 4).collect() == []


def test_vectors(spark):
    r = one(
        spark, vectors.unit(F.array(F.lit(3.0), F.lit(4.0))), vectors.unit(F.array(F.lit(0.0))),
        vectors.blend(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), 0.5),
        encoders.projected(F.array(F.lit(3.0), F.lit(9.0)), [[1, 0], [0, 0]]),
    )
    assert r[0] == [0.6, 0.8] and r[1] is None and r[2] == pytest.approx([2**-0.5] * 2) and r[3] == [1, 0]
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    out = df.select(encoders.encoded(F.col("t"), lambda: lambda texts: np.array([[len(t), 0] for t in texts]))).collect()
    assert [x[0] for x in out] == [[2.0, 0.0], None]
    hits = spark.createDataFrame([(1, 1, "text", 0.8), (1, 1, "odd", 1.0), (1, 2, "odd", 1.0)], "query_id int, doc_id int, modality string, score double")
    got = {r.doc_id: (r.score, sorted(r.missing)) for r in vectors.available_mean(vectors.best_by_modality(hits)).collect()}
    assert got == {1: (0.8, ["crop_image", "full_image"]), 2: (0.0, ["crop_image", "full_image", "text"])}


def test_graph(spark):
    docs = spark.createDataFrame([(1, "M", "x"), (2, "M", "y"), (3, None, "x")], "id int, sex string, breed string")
    g = graph.edges(docs, F.col("id"), {"sex": F.col("sex"), "breed:name": F.col("breed")})
    asked = spark.createDataFrame([(7, "sex:m"), (7, "breed:name:x"), (7, "age:none")], "query_id int, feature string")
    got = {r.doc_id: (r.prior, r.match) for r in graph.candidates(asked, g).collect()}
    assert got == {1: (1.35, pytest.approx(1.35 / 2.35)), 2: (1.0, pytest.approx(1 / 2.35)), 3: (0.35, pytest.approx(0.35 / 2.35))}
    pool = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "query_id int, doc_id int")
    near = graph.neighbours(pool, spark.createDataFrame([(7, 2)], "query_id int, seed_id int"), g).collect()
    assert [(r.doc_id, r.neighbour) for r in near] == [(1, 1.0)]


def test_fusion(spark):
    runs = spark.createDataFrame(
        [("a", 1, "x", 1), ("a", 1, "x", 2), ("a", 1, "y", 3), ("b", 1, "y", 1)], "system_id string, query_id int, doc_id string, rank int"
    )
    got = {r.doc_id: r.score for r in fusion.reciprocal_ranks(runs, {"a": 1.0, "b": 0.5}).collect()}
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62 + 0.5 / 61)}
    true, none = F.lit(True), F.lit(None).cast("boolean")
    conditions = [(true, true), (true, none), (true, F.lit(False)), (F.lit(False), true)]
    c = fusion.compatibility(conditions)
    r = one(spark, fusion.condition_parts(conditions), c["compatibility"], c["evidence_coverage"], fusion.condition_parts([]))
    assert list(r) == [pytest.approx(0.4), pytest.approx(1 / 3), pytest.approx(2 / 3), 0.0]
    cand = spark.createDataFrame([(1, "a", 0.9, 0.0, None), (1, "b", 0.9, 0.0, 0.0), (1, "c", 0.7, 1.0, 1.0)], "query_id int, doc_id string, score double, compatibility double, quality double")
    assert [r.doc_id for r in fusion.profile_rerank(cand).orderBy("rank").collect()] == ["c", "b", "a"]


def test_ranking_metrics(spark):
    run = spark.createDataFrame([("s", "q", f"d{i}", i) for i in range(1, 7)], "system_id string, query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "d2", 1.0), ("q", "d4", 1.0), ("q", "zz", 1.0), ("q", "d1", 0.0)], "query_id string, doc_id string, grade double")
    r = evaluation.ranking_metrics(run, qrels).first()
    ideal = 1 + 1 / np.log2(3) + 1 / np.log2(4)
    assert (r.precision_5, r.recall_5, r.reciprocal_rank, r.hit_5) == (0.4, 0.666667, 0.5, 1)
    assert r.ndcg_5 == pytest.approx((1 / np.log2(3) + 1 / np.log2(5)) / ideal, abs=1e-6)
    assert evaluation.average_precision(run, qrels, 10).first().ap == pytest.approx((1 / 2 + 2 / 4) / 3, abs=1e-6)
    scored = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 0, 0.1), ("b", 1, 0.3)], "g string, label int, score double")
    assert {r.g: r.auc for r in evaluation.roc_auc(scored, ["g"]).collect()} == {"a": 0.75, "b": None}


def test_overlap(spark):
    run = spark.createDataFrame(
        [("l", "q", d, i) for i, d in enumerate("abc", 1)] + [("r", "q", d, i) for i, d in enumerate("bax", 1)] + [("l", "p", "a", 1)],
        "system_id string, query_id string, doc_id string, rank int",
    )
    got = {r.query_id: r.rbo for r in evaluation.rank_biased_overlap(run, "l", "r").collect()}
    want = 0.1 * (0 + 1 * 0.9 + 2 / 3 * 0.81) + 2 / 3 * 0.729
    assert got == {"q": pytest.approx(want, abs=1e-6), "p": 0.0}
    j = {r.query_id: (r.jaccard, r.same_order) for r in evaluation.top_jaccard(run, "l", "r", 2).collect()}
    assert j == {"q": (1.0, False), "p": (0.0, False)}


def test_alpha(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 3), (2, 3), (3, 1), (3, 2), (4, 1)], "unit int, grade int")
    assert 0 < evaluation.ordinal_alpha(df).first().alpha < 1
    same = df.where("unit <= 2")
    assert evaluation.ordinal_alpha(same).first().alpha == 1.0
    assert evaluation.ordinal_alpha(df.limit(0)).first().alpha is None


def test_statistics(spark):
    p = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, name string, p double")
    assert {r.name: round(r.adjusted, 6) for r in statistics.holm(p, ["family"]).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    assert statistics.two_sided(9, 1) == pytest.approx(22 / 1024) and statistics.two_sided(0, 0) == 1.0
    sums = spark.createDataFrame([("g", i, float(i % 3), 1) for i in range(30)], "g string, cluster int, total double, n int")
    a = statistics.bootstrap_interval(sums, ["g"], 200).first()
    b = statistics.bootstrap_interval(sums.repartition(5), ["g"], 200).first()
    assert a == b and a.low < a.mean < a.high
    rows = [("g", i, 1.0) for i in range(12)] + [("h", i, (-1.0) ** i) for i in range(12)] + [("z", 1, 0.0), (None, 1, 0.5), ("g", 99, None)]
    d = spark.createDataFrame(rows, "g string, k int, d double")
    got = {r.g: r.p for r in statistics.permutation_p(d, ["g"], "k", "d", 4000).collect()}
    assert got["g"] < 0.01 and got["h"] == 1.0 and got["z"] == 1.0 and got[None] == 1.0
    n = {r.g: (r.deviation, r.mean) for r in statistics.seeds_summary(spark.createDataFrame([("a", 1.0)], "g string, d double"), ["g"], F.col("d")).collect()}
    assert n == {"a": (0.0, 1.0)}


def test_quantiles_and_parts_against_sorting(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=3000).round(2), "b": np.array([7.0]), None: rng.exponential(size=500), "c": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {(r.g, r.share): r.quantile for r in statistics.quantiles(df, ["g"], "v", shares).collect()}
    assert got == {(g, q): pytest.approx(np.quantile(vs, q)) for g, vs in values.items() for q in shares}
    p = spark.createDataFrame([(g, str(i), float(abs(v) % 1)) for g, vs in values.items() for i, v in enumerate(vs)], "f string, name string, p double")
    found = {(r.f, r.name): r.adjusted for r in statistics.holm(p, ["f"]).collect()}
    for g, vs in values.items():
        order = sorted((float(abs(v) % 1), str(i)) for i, v in enumerate(vs))
        so_far = 0.0
        for k, (x, name) in enumerate(order):
            so_far = max(so_far, min(1.0, (len(order) - k) * x))
            assert found[g, name] == pytest.approx(so_far)
    assert statistics.quantiles(df.limit(0), ["g"], "v", [0.5]).collect() == []


def test_random_precision_against_permutations(spark):
    from itertools import permutations

    labels, k = [1, 1, 0, 0, 0], 3
    values = [sum(o[r] * sum(o[: r + 1]) / (r + 1) for r in range(k)) / min(k, 2) for o in permutations(labels)]
    assert one(spark, statistics.random_precision(F.lit(5), F.lit(2), k))[0] == pytest.approx(np.mean(values))


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (100, 102), (None, 5)]
    df = spark.createDataFrame(chain, "a int, b int")
    got = {r.node: r.component for r in splits.components(df).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and [got[i] for i in (100, 101, 102)] == [100] * 3
    assert splits.components(df.limit(0)).collect() == []


def test_splits(spark):
    df = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 99)], "s string, k int")
    got = splits.stratified_split(df, F.col("s"), F.col("k"), 0.15, "x").collect()
    assert sum(r.part == "validation" for r in got if r.stratum == "a") == 3 and [r.part for r in got if r.stratum == "b"] == ["train"]
    sample = splits.stratified_sample(df, F.col("s"), F.col("k"), 5, "x").collect()
    assert len(sample) == 5 and {r.stratum for r in sample} == {"a", "b"}
    parts = df.select("k", splits.split_of(F.col("k"), "seed").alias("p")).groupBy("p").count().collect()
    assert {r.p for r in parts} <= {"train", "validation", "test"}
    drawn = splits.draw_per_identity(df, F.col("s"), F.col("k"), "x").collect()
    assert sum(r.role == "gallery" for r in drawn) == 2


def test_sync(spark):
    old = spark.createDataFrame([("a", "t", "p"), ("b", "t", "p"), ("c", "t", None), ("d", "t", "p")], "k string, t string, p string")
    new = spark.createDataFrame([("a", "t", "p"), ("b", "T", "p"), ("c", "t", ""), ("e", "t", "p")], "k string, t string, p string")
    actions = sync.sync_actions(old, new, "k", ["t"], ["p"])
    assert {r.key: r.action for r in actions.collect()} == {
        "a": "retained", "b": "changed_text", "c": "changed_picture", "d": "stale", "e": "new",
    }
    g = sync.safety_gates(actions).first()
    assert (g.n_fresh, g.removed_fraction, g.passed) == (4, 0.25, True)
    m = sync.merged(old, new.withColumn("t", F.lit(" ")), "k", ["t", "p"]).collect()
    assert {r.k: r.t for r in m} == dict.fromkeys("abcd", "t")


def test_pictures(spark):
    lit = F.lit
    none = lit(None).cast("double")
    r = one(
        spark, pictures.visual_score({"quality": lit(0.8), "area": none, "centered": lit(False)}), pictures.visual_score({"quality": none}),
        pictures.area_score(lit(0.04)), pictures.area_score(lit(1.0)), pictures.quality_band(lit(0.72)),
        pictures.box_area(F.array(lit(-1.0), lit(0.5), lit(0.5), lit(2.0))), pictures.audit_flags(lit(0.4), lit(0.9), none),
        pictures.near_copies(lit(0b1111), lit(0b0001), lit(0.01)), pictures.near_copies(lit(0b11111), lit(1), lit(0.01)),
    )
    assert list(r)[:2] == [pytest.approx((0.8 * 0.42 + 0.35 * 0.12) / 0.54), 0.5]
    assert list(r)[2:6] == [pytest.approx(0.225), pytest.approx(0.65), "high", 0.25]
    assert r[6] == ["low_quality", "too_large"] and r[7] is True and r[8] is False
    assert pictures.first_json_object('x {"a": "}"} y') == '{"a": "}"}' and pictures.first_json_object("{ {}") == "{}"
    assert pictures.first_json_object(None) is None
    a = pictures.attributes(lit('{"coat_color": ["White", "blue", "white"], "dog_count": "50", "ear_shape": 7, "photo_quality_score": "2"}'))
    r = one(spark, *(v.alias(k) for k, v in a.items()))
    assert r.coat_color == ["white"] and r.dog_count == 10 and r.ear_shape == "unknown" and r.photo_quality_score == 1.0


def test_query_policy(spark):
    from ranklake.operators.query_policy import Lexicon, evidence_label, normalised_queries

    lexicon = Lexicon(("small", "white", "black", "푸들"), {"tiny": "small", "하양": "white"}, {"snow white": "white"})
    texts = ["Snow white 푸들은", "tiny blakk dog", "검정 말고 하양이 black 빼고", "whit", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, query_text string")
    got = [r for r in normalised_queries(df, lexicon).orderBy("query_id").collect()]
    assert [r.canonical for r in got] == [["white", "푸들"], ["small", "black"], ["white"], [], [], []]
    assert got[1].corrected == ["blakk"] and got[1].unknown == ["dog"] and got[3].unknown == ["whit"]
    assert got[2].removed == ["검정 말고", "black 빼고"]
    ties = Lexicon(("cat", "cot"))
    (r,) = normalised_queries(spark.createDataFrame([(1, "cut")], "query_id int, query_text string"), ties).collect()
    assert r.canonical == [] and r.unknown == ["cut"]
    label = evidence_label(F.col("t"), "좋아", "싫어")
    rows = [("산책 좋아", 1), ("산책 좋아하지 않음", -1), ("싫어", -1), ("좋아 그리고 싫어", 0), ("", 0), (None, 0)]
    out = spark.createDataFrame(rows, "t string, want int").select(label, "want").collect()
    assert [r[0] for r in out] == [r[1] for r in out]


def test_safe_links(spark):
    from ranklake.functions.urls import safe_link

    good = ["https://a.example/x?y=1#z", "HTTP://a.example", "http://172.32.0.1/"]
    bad = ["ftp://a.example", "https://u:p@a.example/", "http://localhost/", "http://x.local", "http://10.0.0.1/", "http://[::1]/",
           "http://192.168.1.1:80/x", "https://a b", "//a.example", "https://a.example/\\x", "", None, "http://127.0.0.1.", "https://" + "a" * 3000]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string")
    assert [r[0] for r in df.select(safe_link(F.col("u"))).collect()] == good + [None] * len(bad)


def test_boxes(spark):
    one_box = lambda c, s: F.struct(F.lit("dog").alias("label"), F.lit(c).alias("confidence"), F.array(*map(F.lit, (0.0, 0.0, s, 2.0))).alias("box"))
    boxes = F.array(one_box(0.9, 0.1), one_box(0.5, 0.9), one_box(0.1, 1.0))
    got = one(spark, pictures.best_boxes(boxes, 0.25, ("dog",)).alias("b")).b
    assert [x.confidence for x in got] == [0.5, 0.9] and got[0].box == [0.0, 0.0, 0.9, 1.0]
    assert one(spark, pictures.best_boxes(boxes, labels=("cat",)).alias("b")).b == []


def test_trees(spark):
    from ranklake.operators import json_tree as J

    df = spark.createDataFrame([('{"b": {"y": [1, {"z": null}], "x": ""}, "a": 2}', '{"b": {"x": "k", "y": []}, "c": 3}'), ("no tree", None), (None, None)], "a string, b string")
    cols = (J.canonical(F.col("a")), J.known_leaves(F.col("a")), J.fill_blanks(F.col("a"), F.col("b")), J.overlay(F.col("a"), F.col("b")))
    one_, bad, none = df.select(*(c.alias(str(i)) for i, c in enumerate(cols))).collect()
    assert one_[0] == '{"a":2,"b":{"x":"","y":[1,{"z":null}]}}' and one_[1] == 2
    assert one_[2] == one_[3] == '{"a":2,"b":{"x":"k","y":[1,{"z":null}]},"c":3}'
    assert tuple(bad) == tuple(none) == (None, 0, None, None)
    deep = "[" * 500 + "1" + "]" * 500
    assert len(df.select(J.leaf_values(F.lit(deep))).first()[0]) == 1


def test_best_candidates_and_rerank(spark):
    edges = spark.createDataFrame([(d, f"status:{'active' if d % 3 else 'closed'}", 1.15) for d in range(60)] + [(d, "age:puppy", 1.0) for d in range(0, 60, 7)], "doc_id int, feature string, weight double")
    asked = spark.createDataFrame([(1, "status:active"), (1, "age:puppy"), (2, "region:none")], "query_id int, feature string")
    best = graph.best_candidates(asked, edges, 5).collect()
    want = sorted(((-(1.15 * (d % 3 > 0) + (d % 7 == 0)), d) for d in range(60)))[:5]
    assert sorted((round(-r.prior, 6), r.doc_id) for r in best) == [(round(p, 6), d) for p, d in want] and {r.query_id for r in best} == {1}
    ranked = spark.createDataFrame([(1, 7, 0.5, 1), (1, 3, 0.6, 2), (2, 3, 0.4, 1)], "query_id int, doc_id int, score double, rank int")
    got = {(r.query_id, r.doc_id): r for r in graph.reranked(ranked, asked, edges, graph.best_candidates(asked, edges, 5), 1).collect()}
    assert got[1, 7].match == 1.0 and got[1, 7].seed == 1.0 and got[1, 3].match == 0.0
    assert got[1, 7].score == pytest.approx(0.82 * 0.5 + 0.18 * (0.7 + 0.2)) and got[2, 3].score == pytest.approx(0.68 * 0.4)


def test_target_ranks_and_groups_apart(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 4)).round(1)
    g = spark.createDataFrame([(i, [float(x) for x in v[i]], f"s{i % 4}") for i in range(40)], "doc_id int, vector array<double>, s string")
    q = g.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "vector", "s", (F.col("doc_id") + 3).alias("target_id"))
    for r in vectors.target_ranks(q, g, 1).collect():
        s = np.floor((v @ v[r.query_id]) * 10 + 0.5 + 1e-9)
        other = [d for d in range(40) if d not in (r.query_id, r.target_id)]
        more, same = sum(s[d] > s[r.target_id] for d in other), [d for d in other if s[d] == s[r.target_id]]
        assert (r.strict_rank, r.position, r.index_rank) == (1 + more, 1 + more + len(same), 1 + more + sum(d < r.target_id for d in same))
    near = vectors.nearest(q, g, 3, metric="ip", apart="s").collect()
    assert len(near) == 12 and all(r.doc_id % 4 != r.query_id % 4 for r in near)
    assert vectors.target_ranks(q.limit(0), g, 1).collect() == []


def test_bm25_top_by_kinds_of_queries(spark, monkeypatch):
    """The k best are those of the pairs: ties, repeated words, several blocks, and no block a query for equal words."""
    rng = np.random.default_rng(5)
    words = ["a", "b", "c", "d", "가", "나"]
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(400)] + [(400 + i, "a b") for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = [(i, " ".join(rng.choice([*words, "zz"], 1 + i % 4))) for i in range(40)] + [(90, "A a b"), (91, "b, a a"), (92, "zz"), (93, "")]
    queries = spark.createDataFrame(asked, "query_id long, query_text string")
    args = docs, F.col("doc_id"), F.col("text"), queries
    pairs = lexical.bm25(*args).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))
    want = sorted(map(tuple, lexical.top_k(pairs, "bm25", 7).select("query_id", "doc_id", "bm25", "rank").collect()))
    assert sorted(map(tuple, lexical.bm25_top(*args, 7).collect())) == want
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "CELLS", 50)
    assert sorted(map(tuple, lexical.bm25_top(*args, 7).collect())) == want
    none = spark.createDataFrame([(1, "zz")], "query_id long, query_text string")
    assert lexical.bm25_top(docs, F.col("doc_id"), F.col("text"), none, 7).collect() == []


def test_md5_flips_are_those_of_md5():
    for prefix in ("flip|q|", "flip||", "flip|" + "긴" * 13 + "abc|", "flip|" + "x" * 47 + "|", "flip|" + "y" * 90 + "|", "abc"):
        want = [hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[0] < "8" for i in range(1, 20_001)]
        assert statistics.md5_flips(prefix.encode(), 20_000).tolist() == want
