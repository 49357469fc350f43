import random

import pytest
from pyspark.sql import functions as F

from ranklake.functions.urls import picture_key
from ranklake.llm.batch_dedup import History, band, check_batch, near_sets, pivot_table, signatures

SCHEMA = "item_id long, number string, urls string, set_key string, size int"
SAME = [
    "https://img.a.example/n/2026/1.jpg",
    "HTTP://IMG.A.example:443//n/2026/1.JPG#view",
    "//img.a.example/%6E/2026/1_thumb.jpg?utm_source=x&w=320",
    "https://img.a.example/c_fit,w_640/n/2026/1_s.jpg?v=3",
    " https://img.a.example/resize-800/n/./2026/1.jpg ",
]


def test_picture_key(spark):
    other = ["https://img.a.example:8080/n/2026/1.jpg", "https://b/x?fid=1,2&w=1", "https://b/x?w=2&fid=1,2", "none", None, ""]
    df = spark.createDataFrame([(u,) for u in SAME + other], "u string")
    got = [r[0] for r in df.select(picture_key(F.col("u"))).collect()]
    assert set(got[:5]) == {"img.a.example/n/2026/1.jpg"}
    assert got[5:] == ["img.a.example:8080/n/2026/1.jpg", "b/x?fid=1,2", "b/x?fid=1,2", None, None, None]


def sig(spark, rows, stock=()):
    df = spark.createDataFrame([(i, n, u, "x", 1) for i, n, u in rows], SCHEMA)
    st = spark.createDataFrame([(s,) for s in stock], "image_url string")
    return signatures(df, F.col("item_id"), F.col("number"), F.col("urls"), st)


def urls(names):
    return ",".join(f"https://h/{n}.jpg" for n in names)


def brute(rows):
    accepted, pairs = [], set()
    for i, n, s in sorted(rows):
        hit = [a for a, m, t in accepted if (n and n == m) or (s and t and 2 * len(s & t) >= len(s | t))]
        pairs |= {(a, i) for a in hit}
        if not hit:
            accepted.append((i, n, s))
    return pairs


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1, 160):
        pool = ["hot"] + [f"p{rng.randrange(25)}" for _ in range(5)]
        pics = frozenset(rng.sample(pool, rng.choice([0, 1, 1, 2, 3, 4]))) | (frozenset(["hot"]) if i % 3 == 0 else frozenset())
        rows.append((i, rng.choice([None, "same", f"n{rng.randrange(120)}", f"m{i}"]), pics))
    want = brute(rows)
    packed = [(i, n, urls(sorted(s)) or None) for i, n, s in rows]
    got, history = set(), History.new(spark)
    for part in (packed[:90], packed[90:]):
        pairs, history = check_batch(sig(spark, part), history)
        got |= {tuple(r) for r in pairs.collect()}
        history = History.load(spark, history.folder)
    assert got == want
    assert history.items.count() == len(rows) - len({b for _, b in want})


def test_hot_number_and_copies(spark):
    rows = [(i, "n" if i % 2 else None, urls("ab" if i % 3 else "c")) for i in range(1, 301)]
    pairs, history = check_batch(sig(spark, rows + rows), History.new(spark))
    assert {r[0] for r in pairs.collect()} <= {1, 2, 6} and pairs.count() <= 2 * 300
    assert brute([(i, n, frozenset(u.split(","))) for i, n, u in rows]) == {tuple(r) for r in pairs.collect()}


def test_placeholders_nulls_and_empty(spark):
    stock = ["https://h/none.jpg?v=1", None]
    rows = [(1, None, urls(["none"])), (2, None, urls(["none"])), (3, "", "no address"), (None, "x", urls("a")), (5, None, None)]
    pairs, history = check_batch(sig(spark, rows, stock), History.new(spark))
    assert pairs.collect() == [] and history.items.count() == 4
    pairs, history = check_batch(sig(spark, [], stock), history)
    assert pairs.collect() == [] and history.items.count() == 4
    pairs, history = check_batch(sig(spark, [], stock), History.new(spark))
    assert pairs.collect() == []


def test_large_sets_meet_in_bands(spark):
    many = [f"x{k}" for k in range(300)]
    rows = [(1, None, urls(many)), (2, None, urls(many[:150])), (3, None, urls(many[:149])), (4, None, urls(many[140:]))]
    sets = sig(spark, rows).select("set_key", "pictures")
    assert near_sets(pivot_table(sets), sets, pivot_table(sets), sets).count() == 2 * 3
    pairs, _ = check_batch(sig(spark, rows), History.new(spark))
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (1, 4)}
    sizes = spark.range(1, 3000).select(F.col("id").alias("s"), band(F.col("id")).alias("b")).orderBy("s").collect()
    assert all(x.b <= y.b for x, y in zip(sizes, sizes[1:], strict=False))


def test_a_dense_group_is_not_compared_pairwise(spark):
    """Sets of two pictures all share and one of their own: all are near each other, one is accepted."""
    n = 400
    rows = [(i, None, urls(["h1", "h2", f"x{i}"])) for i in range(1, n + 1)]
    pairs, history = check_batch(sig(spark, rows), History.new(spark))
    assert pairs.count() == n - 1 and history.items.count() == 1 and history.rows.count() == 3


def test_chains_and_lower_ids_of_later_batches(spark):
    chain = [(i, None, urls([f"c{i}", f"c{i + 1}"] if i % 2 else [f"c{i}"])) for i in range(1, 30)]
    pairs, history = check_batch(sig(spark, chain), History.new(spark))
    assert {tuple(r) for r in pairs.collect()} == brute([(i, n, frozenset(u.split(","))) for i, n, u in chain])
    again, _ = check_batch(sig(spark, [(-5, None, urls(["c1", "c2"]))]), history)
    assert [tuple(r) for r in again.collect()] == [(1, -5)]


def test_pairs_leave_no_plan_behind(spark):
    """What a batch returns is made already, so plans of several batches do not meet in the driver's memory."""
    pairs, history = check_batch(sig(spark, [(1, None, urls("ab")), (2, None, urls("ab"))]), History.new(spark))
    later, _ = check_batch(sig(spark, [(3, None, urls("abc")), (4, "n", urls("x")), (5, "n", None)]), history)
    both = pairs.unionByName(later)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {tuple(r) for r in both.collect()} == {(1, 2), (1, 3), (4, 5)}
