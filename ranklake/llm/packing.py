"""Items of varying length put into containers of fixed capacity with little room left unused.

The lengths are gathered as a histogram, whose size is bounded by the capacity and not by the number of items. Over it the
configuration linear program (a variable for each way to fill a container) is solved by multiplicative weights: each
length has a price that falls exponentially with how much of it is already covered; in every round a knapsack dynamic
program over all lengths finds the filling of the highest price, and its variable is raised. The solution is rounded to
whole containers so that the sums stay, and what is left is filled greedily, the longest first. The items then take the
places by their rank among the items of their length.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.session import BROADCAST_ROWS, cut

#: Largest capacity; the histogram that comes to the driver has at most as many rows.
MOST_CAPACITY = 65_536
#: Rounds of the multiplicative weights, and how fast prices fall.
ROUNDS, FALL = 100, 6.0
#: About as many items are in one part of the ranks, and as many ranks of a length in one block of places.
ROWS_IN_BUCKET, RANKS_IN_BLOCK = 500_000, 65_536

Filling = list[tuple[int, int]]


def knapsack(lengths: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> Filling:
    """The filling ``[(length, number)]`` of the highest price within the capacity, with at most ``most`` of a length.

    Of the lengths over half of the capacity a container can hold one item; so these need no step of the dynamic program
    each, but are tried all at once on top of what the others fill best.
    """
    best = np.zeros(capacity + 1)
    small = np.flatnonzero(2 * lengths <= capacity)
    steps: list[tuple[int, int]] = []
    took: list[np.ndarray] = []
    for i in small.tolist():
        length, price = int(lengths[i]), float(prices[i])
        left, part = min(int(most[i]), capacity // length), 1
        while left > 0:
            n = min(part, left)
            size = n * length
            with_it = best[: capacity + 1 - size] + n * price
            better = with_it > best[size:]
            took.append(np.packbits(better))
            steps.append((i, n))
            np.maximum(best[size:], with_it, out=best[size:])
            left -= n
            part *= 2
    chosen: dict[int, int] = {}
    room, total = int(np.argmax(best)), float(best.max())
    large = np.flatnonzero((2 * lengths > capacity) & (lengths <= capacity) & (most > 0))
    if len(large):
        upto = np.maximum.accumulate(best)
        sums = prices[large] + upto[capacity - lengths[large]]
        k = int(np.argmax(sums))
        if sums[k] > total:
            length = int(lengths[large[k]])
            chosen[length] = 1
            room = int(np.argmax(best[: capacity - length + 1]))
    for (i, n), better in zip(reversed(steps), reversed(took), strict=True):
        at = room - n * int(lengths[i])
        if at >= 0 and better[at >> 3] >> (7 - (at & 7)) & 1:
            chosen[int(lengths[i])] = chosen.get(int(lengths[i]), 0) + n
            room = at
    return sorted(chosen.items(), reverse=True)


def solution(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[Filling, float]]:
    """Fillings and how much of each the configuration program uses; no length is covered beyond its need."""
    least = float((lengths * need).sum()) / capacity
    rounds = min(rounds, math.ceil(least))
    left, covered = need.astype(float), np.zeros(len(lengths))
    out: list[tuple[Filling, float]] = []
    for _ in range(rounds):
        each = least / rounds
        prices = lengths * np.exp(-FALL * covered / need)
        open_ = np.flatnonzero(left > 1e-9)
        most = np.maximum(1, np.floor(left[open_] / each)).astype(np.int64)
        filling = knapsack(lengths[open_], prices[open_], most, capacity)
        if not filling:
            break
        at, n = np.searchsorted(lengths, [x for x, _ in filling]), np.array([k for _, k in filling])
        amount = min(each, float((left[at] / n).min()))
        covered[at] += n * each
        left[at] -= n * amount
        out.append((filling, amount))
    return out


def fillings(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[Filling, int]]:
    """Fillings with the number of containers of each; together they hold exactly the histogram's items."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    rest = need.copy()
    at = {int(x): i for i, x in enumerate(lengths)}
    out: list[tuple[Filling, int]] = []

    def use(filling: Filling, times: int) -> None:
        times = min([times, *(int(rest[at[length]]) // n for length, n in filling)])
        if times > 0:
            for length, n in filling:
                rest[at[length]] -= n * times
            out.append((filling, times))

    # Rounded so that the numbers of containers so far follow the sums of the solution so far.
    so_far = used = 0.0
    for filling, amount in solution(lengths, need, capacity, rounds) if len(lengths) else []:
        so_far += amount
        times = math.ceil(so_far - 1e-9) - used
        used += times
        use(filling, int(times))
    while rest.any():
        room, filling = capacity, []
        for i in np.flatnonzero(rest)[::-1]:
            n = min(int(rest[i]), room // int(lengths[i]))
            if n:
                filling.append((int(lengths[i]), n))
                room -= n * int(lengths[i])
            if room < lengths[0]:
                break
        use(filling, int(rest.max()))
    return out


def pieces(items: DataFrame, item_id: Column, size: Column, capacity: int) -> DataFrame:
    """``item_id, part_no, start, length``: every item in one piece, or if it exceeds the capacity in full ones and a rest."""
    n = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1))
    return (
        items.select(item_id.alias("item_id"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
        .select("item_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("k"))
        .select(
            "item_id",
            (F.col("k") + 1).cast("int").alias("part_no"),
            (F.col("k") * capacity).alias("start"),
            F.least(F.lit(capacity), F.col("size") - F.col("k") * capacity).cast("int").alias("length"),
        )
    )


def packed(items: DataFrame, item_id: Column, size: Column, capacity: int, buckets: int | None = None) -> DataFrame:
    """``container_no, item_id, part_no, start, length``: every item, or every piece of a too long one, in a container.

    Containers count from 1. An item without size or of size 0 needs no room and stands in container 0. Rows that are
    repeated, also ids, are items of their own. An empty table gives no rows; a capacity must lie in 1..MOST_CAPACITY.

    The rank of an item among those of its length is counted in ``buckets`` parts by hash (64, and more so that a part has
    about ROWS_IN_BUCKET rows), so that a length which a third of all items have is not gathered in one task. The places are
    a table bounded by the fillings, whatever the number of items; items and places meet by length and block of ranks.
    """
    if not 1 <= capacity <= MOST_CAPACITY:
        raise ValueError(f"a capacity must lie in 1..{MOST_CAPACITY}")
    spark = items.sparkSession
    every = cut(pieces(items, item_id, size, capacity))
    n_pieces = every.count()
    buckets = buckets or max(64, n_pieces // ROWS_IN_BUCKET)
    every = every.withColumn("bucket", F.pmod(F.xxhash64("item_id", "part_no"), F.lit(buckets)).cast("int"))
    counts = cut(every.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = {
        r.length: r.n for r in counts.where("length > 0").groupBy("length").agg(F.sum("n").alias("n")).collect()
    }
    rows, number, offset = [], 1, dict.fromkeys(histogram, 0)
    for filling, times in fillings(histogram, capacity):
        for length, n in filling:
            rows.append((length, offset[length], offset[length] + n * times, number, n))
            offset[length] += n * times
        number += times
    places = spark.createDataFrame(
        rows, "p_length int, p_from long, p_to long, first_container long, per_container long"
    )
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("item_id", "part_no")
    ranked = (
        every.where("length > 0")
        .withColumn("own", F.row_number().over(order) - 1)
        .join(starts, ["length", "bucket"])
        .withColumn("rank", F.col("own") + F.col("before"))
    )
    block = lambda c: F.floor(c / RANKS_IN_BLOCK)
    blocks = F.sequence(block(F.col("p_from")), block(F.col("p_to") - 1))
    places = places.select("*", F.explode(blocks).alias("block")).withColumnRenamed("p_length", "length")
    is_small = len(rows) + n_pieces // RANKS_IN_BLOCK <= BROADCAST_ROWS
    placed = ranked.withColumn("block", block(F.col("rank"))).join(
        F.broadcast(places) if is_small else places, ["length", "block"]
    )
    placed = placed.where((F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")))
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("p_from")) / F.col("per_container"))
    columns = ("item_id", "part_no", "start", "length")
    return placed.select(container.cast("long").alias("container_no"), *columns).unionByName(
        every.where("length <= 0").select(F.lit(0).cast("long").alias("container_no"), *columns)
    )


def packing_report(containers: DataFrame, capacity: int) -> DataFrame:
    """``n_containers, least_containers, n_items, n_split, n_tokens, filled_share`` of what ``packed`` gives."""
    return containers.agg(
        F.coalesce(F.max("container_no"), F.lit(0)).alias("n_containers"),
        F.ceil(F.coalesce(F.sum("length"), F.lit(0)) / capacity).alias("least_containers"),
        F.count(F.when(F.col("part_no") == 1, 1)).alias("n_items"),
        F.count(F.when(F.col("part_no") == 2, 1)).alias("n_split"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens"),
        F.round(F.try_divide(F.sum("length"), F.max("container_no") * capacity), 6).alias("filled_share"),
    )
