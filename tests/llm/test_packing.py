import random

import pytest
from pyspark.sql import functions as F

from ranklake.llm.packing import fillings, knapsack, packed, packing_report

import numpy as np

SCHEMA = "doc_id long, size long, length string, bucket int, container_no int"


def rows(sizes):
    return [(i, s, "x", 1, 2) for i, s in enumerate(sizes)]


def check(spark, sizes, capacity, got):
    boxes, parts = {}, {}
    for r in got:
        boxes[r.container_no] = boxes.get(r.container_no, 0) + r.length
        parts.setdefault(r.item_id, []).append((r.part_no, r.start, r.length))
    assert all(v <= capacity for k, v in boxes.items() if k) and boxes.get(0, 0) == 0
    assert set(parts) == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        p = sorted(parts[i])
        assert sum(x[2] for x in p) == (s or 0)
        assert len(p) == max(1, -(-(s or 0) // capacity)) and [x[1] for x in p] == [k * capacity for k in range(len(p))]
    used = {k for k in boxes if k}
    assert used == set(range(1, len(used) + 1))
    return len(used)


@pytest.mark.parametrize("capacity", [1, 16, 100, 512])
def test_whole_and_full(spark, capacity):
    rng = random.Random(capacity)
    sizes = [rng.choice([0, 1, 7, 33, 33, 33, rng.randrange(1, 700)]) for _ in range(400)] + [None, 5000]
    df = spark.createDataFrame(rows(sizes), SCHEMA)
    out = packed(df, F.col("doc_id"), F.col("size"), capacity)
    n = check(spark, sizes, capacity, out.collect())
    total = sum(s or 0 for s in sizes)
    assert n <= 1.03 * total / capacity + 1
    r = packing_report(out, capacity).first()
    assert (r.n_containers, r.n_tokens, r.n_items) == (n, total, len(sizes))
    assert r.n_split == sum((s or 0) > capacity for s in sizes)


def test_hot_length_and_repeats(spark):
    data = rows([60] * 300 + [40] * 300) + rows([60])
    out = packed(spark.createDataFrame(data, SCHEMA), F.col("doc_id"), F.col("size"), 100).collect()
    assert len(out) == 601 and len({r.container_no for r in out}) == 301


def test_empty_and_bounds(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = packed(empty, F.col("doc_id"), F.col("size"), 10)
    assert out.collect() == [] and packing_report(out, 10).first().n_containers == 0
    with pytest.raises(ValueError):
        packed(empty, F.col("doc_id"), F.col("size"), 0)


def test_knapsack_against_all_fillings():
    rng = random.Random(1)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 12), 3))
        prices = [rng.random() for _ in lengths]
        most = [rng.randrange(0, 4) for _ in lengths]
        got = knapsack(np.array(lengths), np.array(prices), np.array(most), 20)
        best = max(
            sum(p * k for p, k in zip(prices, ks))
            for ks in __import__("itertools").product(*(range(m + 1) for m in most))
            if sum(n * k for n, k in zip(lengths, ks)) <= 20
        )
        assert sum(prices[lengths.index(n)] * k for n, k in got) == pytest.approx(best)
        assert sum(n * k for n, k in got) <= 20 and all(k <= most[lengths.index(n)] for n, k in got)


def test_fillings_hold_everything():
    rng = random.Random(2)
    h = {n: rng.randrange(1, 500) for n in rng.sample(range(1, 2049), 900)}
    held = {}
    for filling, times in fillings(h, 2048):
        assert sum(n * k for n, k in filling) <= 2048
        for n, k in filling:
            held[n] = held.get(n, 0) + k * times
    assert held == h
