"""Records of several sources mixed so that each has a target share of all tokens.

Each source's documents, in pseudorandom order, form one stream of tokens that is packed into blocks of fixed length. A mix
has slots for blocks, in shards of equal size; for each shard a multinomial draw says how many slots each source gets. The
slots of a source are numbered through all shards, and a pseudorandom permutation of the source's block numbers maps them
to blocks, another one each time round. Slots and blocks meet by source and block number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklake.session import bounded_rows, cut

#: Most rows that the list of targets may have.
MOST_TARGETS = 10_000
BLOCK_TOKENS, SHARDS, SEED = 256, 64, 7
#: Most slots of a shard, and about as many documents are in one part of a running sum.
SLOTS_IN_SHARD, ROWS_IN_BUCKET = 65_536, 500_000


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, buckets: int = 64, seed: int = SEED) -> DataFrame:
    """``source, block_no, doc_id, start, n_tokens``: the parts of documents that each block of a source's stream holds.

    ``docs(doc_id, source, n_tokens)``. The stream's order is that of a hash. The running number of tokens is summed in
    ``buckets`` ranges of it, so that a source with a third of all documents is not gathered in one task. Documents
    without tokens are in no block; a null source is left out.
    """
    hashed = docs.where("source IS NOT NULL AND n_tokens > 0").select(
        "doc_id", "source", "n_tokens", F.xxhash64("doc_id", F.lit(seed)).alias("h")
    )
    hashed = hashed.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        hashed.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
        .join(starts, ["source", "bucket"])
        .select("source", "doc_id", "n_tokens", (F.col("own") + F.col("before")).alias("at"))
    )
    first, last = F.floor(F.col("at") / block_tokens), F.floor((F.col("at") + F.col("n_tokens") - 1) / block_tokens)
    cut_up = placed.select("*", F.explode(F.sequence(first, last)).alias("block_no"))
    low = F.greatest(F.col("at"), F.col("block_no") * block_tokens)
    high = F.least(F.col("at") + F.col("n_tokens"), (F.col("block_no") + 1) * block_tokens)
    return cut_up.select(
        "source", "block_no", "doc_id", (low - F.col("at")).alias("start"), (high - low).alias("n_tokens")
    )


def plans_of(
    targets: list[tuple[str, str, float, int]], tokens: dict[str, int], block_tokens: int, shards: int
) -> list[tuple[str, int, list[tuple[str, int, int]]]]:
    """``(mix, number of shards, [(source, slots, blocks)])``, with targets ``(mix, source, share, most repeats)``.

    A mix is as large as its scarcest source allows. Targets of sources without tokens are spread over the others in
    proportion. There are ``shards`` shards, more if they would have over SLOTS_IN_SHARD slots.
    """
    out = []
    for mix in sorted({t[0] for t in targets}):
        here = [(s, w, r) for m, s, w, r in targets if m == mix and tokens.get(s, 0) > 0 and w > 0 and r > 0]
        if not here:
            continue
        whole = sum(w for _, w, _ in here)
        total = min(r * tokens[s] * whole / w for s, w, r in here)
        n_blocks = {s: -(-tokens[s] // block_tokens) for s, _, _ in here}
        # A source's last block may be short: its tokens, not its slots, have to meet the share.
        mean = {s: tokens[s] / n_blocks[s] for s, _, _ in here}
        slots = {s: min(r * n_blocks[s], round(total * w / whole / mean[s])) for s, w, r in here}
        n_shards = max(shards, -(-sum(slots.values()) // SLOTS_IN_SHARD))
        out.append((mix, n_shards, [(s, slots[s], n_blocks[s]) for s, _, _ in here]))
    return out


def _part(left: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``size`` slots drawn from ``left`` each source gets, source by source from what is left of it."""
    out, rest = np.zeros(len(left), dtype=np.int64), int(left.sum())
    for k, have in enumerate(left.tolist()):
        others = rest - have
        if not have or not size:
            n = 0
        elif not others:
            n = size
        elif rest < 1_000_000_000:  # the bound of the exact draw; beyond it a normal one differs by less than a slot in a million
            n = int(rng.hypergeometric(have, others, size))
        else:
            share = have / rest
            spread = (size * share * (1 - share) * ((rest - size) / (rest - 1))) ** 0.5
            n = round(rng.normal(size * share, spread))
        out[k] = n = min(max(n, size - others, 0), have, size)
        rest, size = others, size - n
    return out


def shard_draw(key: int, slots: np.ndarray, n_shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of each source in a shard, and how many it has in the shards before.

    The range of shards is halved again and again; at each halving the multinomial draw, conditioned on the totals, gives
    the slots of the lower half. Each draw depends on the seed and on the range only, so every task finds the same ones,
    no shard needs the draws of the others, and all add up to the totals.
    """
    low, high, left = 0, n_shards, slots.astype(np.int64)
    used = np.zeros(len(slots), dtype=np.int64)
    every = int(slots.sum())
    upto = lambda k: every * k // n_shards
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, key, low, high]))
        lower = _part(left, upto(middle) - upto(low), rng)
        if shard < middle:
            high, left = middle, lower
        else:
            low, left, used = middle, left - lower, used + lower
    return left, used


def draws(spark: SparkSession, plans: list[tuple[str, int, list[tuple[str, int, int]]]], seed: int) -> DataFrame:
    """``mix_name, shard_no, source, n_slots, first_slot, n_blocks`` of every shard, drawn in tasks by shard number."""
    shape = "mix_name string, shard_no int, source string, n_slots long, first_slot long, n_blocks long"
    out = spark.createDataFrame([], shape)
    for mix, n_shards, sources in plans:
        key = int(hashlib.sha256(mix.encode()).hexdigest()[:8], 16)
        slots = np.array([n for _, n, _ in sources], dtype=np.int64)

        def drawn(
            batches: Iterator[pd.DataFrame], mix=mix, n_shards=n_shards, sources=sources, key=key, slots=slots
        ) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for shard in b.id.tolist():
                    left, used = shard_draw(key, slots, n_shards, shard, seed)
                    rows += [
                        (mix, shard, s, int(n), int(u), blocks_of)
                        for (s, _, blocks_of), n, u in zip(sources, left, used, strict=True)
                        if n
                    ]
                names = ["mix_name", "shard_no", "source", "n_slots", "first_slot", "n_blocks"]
                yield pd.DataFrame(rows, columns=names)

        out = out.unionByName(spark.range(n_shards).mapInPandas(drawn, shape))
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of ``0..size-1`` for each key, at each index: four Feistel rounds, walked until within the size."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
            left, right = out[todo] >> h, out[todo] & m
            for r in range(4):
                mixed = (right + k + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & m)
            out[todo] = (left << h) | right
            todo[todo] = out[todo] >= size[todo].astype(np.uint64)
    return out.astype(np.int64)


def selection(
    docs: DataFrame,
    targets: DataFrame,
    *,
    block_tokens: int = BLOCK_TOKENS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """``mix_name, shard_no, slot_no, use_no, source, block_no, doc_id, start, n_tokens``: what each mix holds.

    ``docs(doc_id, source, n_tokens)``, ``targets(mix_name, source, target_share, max_repeats)``. A block, and so any part
    of a document, is used at most ``max_repeats`` times, ``use_no`` counts from 1. Targets with a null, and sources
    without target, take no part; without documents or targets there are no rows. Repeated rows of documents are
    documents of their own.
    """
    spark = docs.sparkSession
    wanted = [
        (r.mix_name, r.source, float(r.target_share), int(r.max_repeats))
        for r in bounded_rows(targets.select("mix_name", "source", "target_share", "max_repeats"), MOST_TARGETS)
        if None not in (r.mix_name, r.source, r.target_share, r.max_repeats)
    ]
    asked = sorted({s for _, s, _, _ in wanted})
    used = cut(docs.where(F.col("source").isin(asked)).select("doc_id", "source", "n_tokens"))
    tokens = {r.source: r.n for r in used.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    drawn = draws(spark, plans_of(wanted, {s: n or 0 for s, n in tokens.items()}, block_tokens, shards), seed)

    @F.pandas_udf("long")
    def block_of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for index, size, key in batches:
            yield pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()), dtype="int64")

    slots = (
        drawn.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1)).alias("i"))
        .withColumn("k", F.col("first_slot") + F.col("i"))
        .withColumn("use_no", (F.floor(F.col("k") / F.col("n_blocks")) + 1).cast("int"))
        .withColumn("key", F.xxhash64("mix_name", "source", "use_no", F.lit(seed)))
        .withColumn("block_no", block_of(F.pmod("k", "n_blocks"), "n_blocks", "key"))
        .select("mix_name", "shard_no", F.col("i").alias("slot_no"), "use_no", "source", "block_no")
    )
    buckets = max(64, used.count() // ROWS_IN_BUCKET)
    return slots.join(blocks(used, block_tokens, buckets, seed), ["source", "block_no"]).select(
        "mix_name", "shard_no", "slot_no", "use_no", "source", "block_no", "doc_id", "start", "n_tokens"
    )


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_name, source, target_share, max_repeats, n_tokens, actual_share, most_uses`` for every target."""
    got = chosen.groupBy("mix_name", "source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.max("use_no").alias("most_uses")
    )
    every = targets.select("mix_name", "source", "target_share", "max_repeats").join(got, ["mix_name", "source"], "left")
    every = every.na.fill({"n_tokens": 0, "most_uses": 0})
    whole = F.sum("n_tokens").over(Window.partitionBy("mix_name"))
    return every.withColumn("actual_share", F.round(F.try_divide("n_tokens", whole), 6))
