import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklake.llm.mixing import _part, blocks, permuted, plans_of, selection, shard_draw, shares
from ranklake.llm.tokens import counter, n_tokens

DOCS = "doc_id long, source string, n_tokens long, block_no int, key string"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, "big", 5 + i % 90, 0, "") for i in range(2000)] + [(5000 + i, "small", 11, 0, "") for i in range(300)]
    data += [(9000, "big", 3000, 0, ""), (9001, "big", 0, 0, ""), (9002, None, 7, 0, ""), (9003, "free", 7, 0, "")]
    return spark.createDataFrame(data, DOCS)


def test_blocks_hold_every_token_once(spark, docs):
    got = blocks(docs, 64).collect()
    per_doc, per_block = {}, {}
    for r in got:
        per_doc.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        per_block[r.source, r.block_no] = per_block.get((r.source, r.block_no), 0) + r.n_tokens
    for d, n in ((r.doc_id, r.n_tokens) for r in docs.collect() if r.source and r.n_tokens):
        at = 0
        for start, k in sorted(per_doc[d]):
            assert start == at
            at += k
        assert at == n
    for source in ("big", "small"):
        sizes = [per_block[source, k] for k in range(sum(s == source for s, _ in per_block))]
        assert set(sizes[:-1]) == {64}
    assert sorted(map(tuple, got)) == sorted(map(tuple, blocks(docs.repartition(7), 64, buckets=64).collect()))


def test_shares_and_repeats(spark, docs):
    targets = spark.createDataFrame(
        [("m", "big", 0.6, 1), ("m", "small", 0.3, 4), ("m", "absent", 0.1, 2), ("n", "small", 1.0, 2), ("n", None, 0.5, 1)],
        TARGETS,
    )
    chosen = selection(docs, targets, block_tokens=32, shards=5).cache()
    uses = chosen.groupBy("mix_name", "source", "block_no", "doc_id", "start").agg(F.count("*").alias("n"))
    most = {(r.mix_name, r.source): r.n for r in uses.groupBy("mix_name", "source").agg(F.max("n").alias("n")).collect()}
    assert most["m", "big"] <= 1 and most["m", "small"] <= 4 and most["n", "small"] <= 2
    got = {(r.mix_name, r.source): r for r in shares(chosen, targets).collect()}
    assert got["m", "big"].actual_share == pytest.approx(2 / 3, abs=0.01)
    assert got["m", "small"].actual_share == pytest.approx(1 / 3, abs=0.01)
    assert got["m", "absent"].actual_share == 0 and got["m", "absent"].n_tokens == 0
    assert got["n", "small"].n_tokens == 2 * 300 * 11
    sizes = chosen.groupBy("mix_name", "shard_no").agg(F.countDistinct("source", "slot_no").alias("n")).collect()
    for mix in "mn":
        n = [r.n for r in sizes if r.mix_name == mix]
        assert len(n) == 5 and max(n) - min(n) <= 1
    again = selection(docs.repartition(3), targets, block_tokens=32, shards=5)
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))


def test_empty(spark, docs):
    targets = spark.createDataFrame([("m", "big", 1.0, 1)], TARGETS)
    assert selection(docs.limit(0), targets).collect() == []
    assert selection(docs, targets.limit(0)).collect() == []
    assert shares(selection(docs.limit(0), targets), targets).first().actual_share is None


@pytest.mark.parametrize("size", [1, 2, 3, 64, 1000])
def test_permutations(size):
    k = np.arange(size)
    one = permuted(k, np.full(size, size), np.full(size, 12345))
    assert sorted(one) == list(k)
    if size == 1000:
        other = permuted(k, np.full(size, size), np.full(size, -5))
        assert (one != other).mean() > 0.9 and abs(np.corrcoef(k, one)[0, 1]) < 0.2


def test_draws_meet_totals():
    ((mix, n_shards, sources),) = plans_of(
        [("m", "a", 0.5, 1), ("m", "b", 0.5, 9), ("m", "c", 0.0, 9)], {"a": 1000, "b": 300, "c": 5}, 10, 7
    )
    assert (mix, n_shards, sources) == ("m", 7, [("a", 100, 100), ("b", 100, 30)])
    slots, before = np.array([100, 100]), np.zeros(2)
    for shard in range(7):
        got, used = shard_draw(5, slots, 7, shard, 1)
        assert (used == before).all() and got.sum() in (28, 29)
        before = before + got
    assert (before == slots).all()


def test_a_million_shards_and_large_totals():
    slots = np.array([7 * 10**10, 3 * 10**10, 5])
    for shard in (0, 777_777, 1_525_878):
        got, used = shard_draw(5, slots, 1_525_879, shard, 1)
        assert got.sum() in (65_535, 65_536) and abs(got[0] / got.sum() - 0.7) < 0.01 and (used <= slots).all()
    rng = np.random.default_rng(1)
    mean = np.mean([_part(np.array([600, 300, 100]), 50, rng) for _ in range(2000)], axis=0)
    assert np.allclose(mean, [30, 15, 5], atol=0.5)


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = f"/opt/tokenizers/{name}"
    texts = ["안녕하세요 dog", "", None, "<|endoftext|>", "가" * 5000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(n_tokens(F.col("t"), path)).collect()]
    assert got == counter(path)([t or "" for t in texts]) and got[1] == got[2] == 0
