"""New batches of items checked for repeats against everything accepted before.

Items carry a number and a set of pictures. Between sets the metric is the size of the symmetric difference; sets A and B
share at least half of all their pictures exactly if |A ^ B| <= (|A| + |B|) / 3. By the triangle inequality two sets can
only be near if their distances to every pivot differ by at most that.

The fixed pivots are the empty set, CELLS sets that part all possible pictures by hash, and the single pictures of the
space, named by 64 bits of their hash. To a single picture nearly all sets lie one further than to the empty set; only the
distances that are less are stored. So the pivot-distance table of a set has a row for each such pivot with the distances to
the empty set and the cells; the join runs within a pivot over ranges of the distance to the empty set, and the distances to
the cells prune what it finds. The pictures themselves are kept once a set and fetched for what is left, to verify.

A set asks with its rarest pictures only: if A has a pictures, and i of them are rarer than x, then x has to find sets of
no more than 2a - 3i pictures, since larger ones would have to share a rarer picture too. So a picture that a third of
all sets have is asked for only by sets that have little else.

Within a batch sets are compared with accepted ones only. In every round the sets that come first everywhere they could be
met are accepted, and whatever is near them is closed; among the sets of one pivot and size at most one is accepted a
round, so a group of n sets that are all near each other costs n comparisons, not all pairs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklake.functions.urls import picture_key
from ranklake.operators.packed_values import URL_PACKING, packed_values
from ranklake.session import bounded_rows, cut, shared_folder, stored

CELLS = 8
#: Most pictures that a list of placeholders may have.
MOST_STOCK = 1_000


#: Up to this size a set tells apart how far each of its pictures reaches; larger sets reach as far as any could.
FINE_SIZE = 16
#: A round that decides less than this share of the open items is the last before the links of the rest are made.
LEAST_DECIDED = 0.2

_ITEMS = "item_id {kind}, number string, set_key binary"
_SETS = "set_key binary, pictures array<binary>"
_ROWS = "pivot long, band int, size int, set_key binary, far array<int>"


@dataclass
class History:
    """What has been accepted, in a folder: ``items(item_id, number, set_key)``, ``sets(set_key, pictures)`` and the
    pivot-distance table ``rows(pivot, band, size, set_key, far)`` of the sets, in order of the pivot.

    Every batch adds files of its own, none is written again; a batch that is repeated after a failure replaces its files.
    """

    spark: SparkSession
    folder: str
    batches: int = 0
    kind: str = "bigint"

    @classmethod
    def new(cls, spark: SparkSession, folder: str | None = None) -> History:
        return cls(spark, folder or f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> History:
        """The history that batches of earlier sessions left in a folder."""
        items = spark.read.parquet(f"{folder}/items")
        last = items.agg(F.max("batch")).first()[0]
        return cls(spark, folder, int(last or 0) + 1, dict(items.dtypes)["item_id"])

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.batches:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema + ", batch int").parquet(f"{self.folder}/{name}")
        return found.where(F.col("batch") < self.batches).drop("batch")

    @property
    def items(self) -> DataFrame:
        return self._table("items", _ITEMS.format(kind=self.kind))

    @property
    def sets(self) -> DataFrame:
        return self._table("sets", _SETS)

    @property
    def rows(self) -> DataFrame:
        return self._table("rows", _ROWS)

    def append(self, items: DataFrame, sets: DataFrame, rows: DataFrame) -> History:
        at = lambda name: f"{self.folder}/{name}/batch={self.batches}"
        sets.write.mode("overwrite").parquet(at("sets"))
        rows.repartitionByRange("pivot", "band").sortWithinPartitions("pivot", "band").write.mode("overwrite").parquet(at("rows"))
        items.write.mode("overwrite").parquet(at("items"))
        return History(self.spark, self.folder, self.batches + 1, dict(items.dtypes)["item_id"])


def _digest(c: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(c.cast("binary")))


def signatures(
    df: DataFrame, item_id: Column, number: Column, urls: Column, stock: DataFrame, batch: Column | None = None
) -> DataFrame:
    """``item_id, batch, number, set_key, pictures`` of each item; ``stock(image_url)`` lists the pictures that do not count.

    Rows without id are left out, repeated ids count once (the least row). Without pictures ``set_key`` is null.
    """
    placeholders = [r.k for r in bounded_rows(stock.select(picture_key(F.col("image_url")).alias("k")), MOST_STOCK) if r.k]
    keys = F.transform(packed_values(urls, URL_PACKING), picture_key)
    keys = F.filter(keys, lambda k: k.isNotNull() & ~k.isin(*placeholders) if placeholders else k.isNotNull())
    rows = df.select(
        item_id.alias("item_id"),
        (F.lit(0) if batch is None else batch).alias("batch"),
        number.alias("number"),
        F.array_sort(F.array_distinct(F.transform(keys, _digest))).alias("pictures"),
    ).where("item_id IS NOT NULL")
    once = rows.groupBy("item_id").agg(F.min(F.struct("batch", "number", "pictures")).alias("r")).select("item_id", "r.*")
    return once.select(
        "item_id",
        "batch",
        "number",
        F.when(F.size("pictures") > 0, _digest(F.array_join(F.transform("pictures", F.hex), ""))).alias("set_key"),
        "pictures",
    )


def band(size: Column) -> Column:
    """The range of distances to the empty set in which a size lies: single sizes up to 16, then steps of a quarter."""
    wide = F.lit(16) + F.floor(F.log(size / F.lit(16.0)) / F.log(F.lit(1.25))).cast("int")
    return F.when(size < 16, size.cast("int")).otherwise(wide)


def pivot_table(sets: DataFrame) -> DataFrame:
    """``pivot, band, size, set_key, far``: a row per picture of a set, ``far`` the distances to the cells.

    To a cell the distance counts up to the cell's own size, which is the same for all sets.
    """
    in_cell = lambda j: F.size(
        F.filter("pictures", lambda p: F.pmod(F.xxhash64(p), F.lit(CELLS)) == j)
    )
    size = F.size("pictures")
    return sets.where(size > 0).select(
        F.explode(F.transform("pictures", lambda p: F.xxhash64(p))).alias("pivot"),
        band(size).alias("band"),
        size.alias("size"),
        "set_key",
        F.array(*(size - 2 * in_cell(j) for j in range(CELLS))).alias("far"),
    )


def _apart(a: str, b: str) -> Column:
    """The least distance that the triangle inequality leaves two sets, by their distances to the cells."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def _verified(pairs: DataFrame, asked: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(set_key, other_key)`` whose true distance is small enough; ``asked`` and ``sets`` hold the pictures."""
    others = sets.select(F.col("set_key").alias("other_key"), F.col("pictures").alias("o_pictures"))
    both = pairs.distinct().join(asked.select("set_key", "pictures"), "set_key").join(others, "other_key")
    total = F.size("pictures") + F.size("o_pictures")
    distance = total - 2 * F.size(F.array_intersect("pictures", "o_pictures"))
    return both.where(distance <= F.floor(total / 3)).select("set_key", "other_key")


def near_sets(asked_rows: DataFrame, asked: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``set_key, other_key``: the sets of ``sets`` that share at least half of all pictures with an asked set.

    ``asked_rows`` and ``rows`` are the pivot-distance tables of ``asked`` and ``sets``. A set does not find itself. Of
    ``rows`` only those of pivots that are asked for travel. Exact: the true distance of every candidate is computed.
    """
    wanted = asked_rows.select("pivot").distinct()
    there = rows.join(wanted, "pivot", "left_semi")
    counts = there.select("pivot", F.lit(1).alias("n")).unionByName(asked_rows.select("pivot", F.lit(0).alias("n")))
    rarity = counts.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("n_there"))
    rarest = Window.partitionBy("set_key").orderBy("n", "pivot")
    probes = (
        asked_rows.join(rarity, "pivot")
        .withColumn("i", F.row_number().over(rarest) - 1)
        .withColumn("low", F.ceil(F.col("size") / 2).cast("int"))
        .withColumn("high", 2 * F.col("size") - 3 * F.col("i"))
        .where((F.col("high") >= F.col("low")) & (F.col("n_there") > 0))
        .select(
            "pivot", F.explode(F.sequence(band(F.col("low")), band(F.col("high")))).alias("band"), "low", "high",
            F.col("size").alias("p_size"), F.col("set_key").alias("p_key"), F.col("far").alias("p_far"),
        )
    )
    found = (
        probes.join(there, ["pivot", "band"])
        .where((F.col("size") >= F.col("low")) & (F.col("size") <= F.col("high")) & (F.col("set_key") != F.col("p_key")))
        .where(_apart("far", "p_far") <= F.floor((F.col("size") + F.col("p_size")) / 3))
        .select(F.col("p_key").alias("set_key"), F.col("set_key").alias("other_key"))
    )
    return _verified(found, asked, sets)


_NAMES = ("item_id", "number", "set_key")


def _reaches(rows: DataFrame) -> DataFrame:
    """``pivot, size, reach, set_key, far``: the pivots by which a set can meet another one of ``rows``.

    Sets of b and a pictures meet at a pivot only if b is within the reach of the one and a within the reach of the other.
    """
    counts = rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("set_key").orderBy("n", "pivot")
    i = F.row_number().over(own) - 1
    reach = F.when(F.col("size") <= FINE_SIZE, 2 * F.col("size") - 3 * i).otherwise(2 * F.col("size"))
    met = rows.join(counts, "pivot").withColumn("reach", reach).withColumn("i", i)
    met = met.where((F.col("n") > 1) & (2 * F.col("size") - 3 * F.col("i") >= F.ceil(F.col("size") / 2)))
    return met.select("pivot", "size", "reach", "set_key", "far")


def _first(items: DataFrame, by: str, out: str) -> DataFrame:
    return items.where(F.col(by).isNotNull()).groupBy(by).agg(F.min("item_id").alias(out))


def _judged(still_open: DataFrame, first_set: DataFrame, near: DataFrame) -> DataFrame:
    """The open items and whether they come before every other open one of their number and set and before ``first_near``."""
    return (
        still_open.join(_first(still_open, "number", "first_number"), "number", "left")
        .join(first_set.join(near, "set_key", "left"), "set_key", "left")
        .withColumn(
            "wins",
            (F.col("item_id") == F.coalesce("first_number", "item_id"))
            & (F.col("item_id") == F.coalesce("first_set", "item_id"))
            & (F.col("item_id") <= F.coalesce("first_near", "item_id")),
        )
        .select(*_NAMES, "wins")
    )


def _without(judged: DataFrame, winners: DataFrame, closed: DataFrame) -> DataFrame:
    numbers = winners.where("number IS NOT NULL").select("number").distinct()
    left = judged.where("NOT wins").select(*_NAMES).join(numbers, "number", "left_anti")
    return left.join(closed.distinct(), "set_key", "left_anti").select(*_NAMES)


def _by_links(still_open: DataFrame, links: DataFrame) -> list[DataFrame]:
    """The accepted ones of ``still_open`` when all links between their sets are known, in both directions."""
    accepted = []
    while not still_open.isEmpty():
        first_set = _first(still_open, "set_key", "first_set")
        near = links.join(first_set.select(F.col("set_key").alias("other_key"), F.col("first_set").alias("f")), "other_key")
        near = near.groupBy("set_key").agg(F.min("f").alias("first_near"))
        judged = cut(_judged(still_open, first_set, near))
        winners = judged.where("wins").select(*_NAMES)
        accepted.append(winners)
        won = winners.where("set_key IS NOT NULL").select("set_key")
        closed = won.union(links.join(won, "set_key", "left_semi").select(F.col("other_key").alias("set_key")))
        still_open = cut(_without(judged, winners, closed))
    return accepted


def _accepted_in_batch(items: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The items that are accepted going through them by id, when nothing was accepted before.

    In each round those items are accepted that come before every open item of their number, of their set and of the sets
    they can meet; what they meet is compared with them and closed if near. Sets that meet without being near make rounds
    slow; when a round decides less than LEAST_DECIDED of the open items, the links among the rest are made, in which dense
    groups have been closed already. The least open item is always accepted, so the rounds end.
    """
    of_number = items.where("number IS NOT NULL").groupBy("number").agg(F.count(F.lit(1)).alias("n_same"))
    of_set = items.where("set_key IS NOT NULL").groupBy("set_key").agg(F.count(F.lit(1)).alias("n_alike"))
    live = rows.join(of_set.select("set_key"), "set_key", "left_semi")
    meets = cut(_reaches(live))
    seen = cut(
        items.join(of_number.where("n_same > 1"), "number", "left")
        .join(of_set.where("n_alike > 1"), "set_key", "left")
        .join(meets.select("set_key").distinct().withColumn("is_met", F.lit(True)), "set_key", "left")
        .withColumn("is_open", F.coalesce(F.col("n_same"), F.col("n_alike")).isNotNull() | F.col("is_met").isNotNull())
        .select(*_NAMES, "is_open")
    )
    accepted = [seen.where("NOT is_open").select(*_NAMES)]
    still_open = seen.where("is_open").select(*_NAMES)
    n_open = still_open.count()
    while n_open:
        first_set = _first(still_open, "set_key", "first_set")
        here = meets.join(first_set, "set_key")
        kinds = here.groupBy("pivot", "size", "reach").agg(F.min("first_set").alias("f"))
        other = kinds.select("pivot", F.col("size").alias("o_size"), F.col("reach").alias("o_reach"), F.col("f").alias("o_f"))
        in_reach = (F.col("o_size") <= F.col("reach")) & (F.col("size") <= F.col("o_reach"))
        kinds = kinds.join(other, "pivot").where(in_reach).groupBy("pivot", "size", "reach").agg(F.min("o_f").alias("o_f"))
        near = here.join(kinds, ["pivot", "size", "reach"]).groupBy("set_key").agg(F.min("o_f").alias("first_near"))
        judged = cut(_judged(still_open, first_set, near))
        winners = judged.where("wins").select(*_NAMES)
        accepted.append(winners)
        won = winners.where("set_key IS NOT NULL").select("set_key")
        asking = meets.join(won, "set_key", "left_semi").select(
            "pivot", F.col("size").alias("o_size"), F.col("reach").alias("o_reach"), F.col("set_key").alias("other_key"),
            F.col("far").alias("o_far"),
        )
        losers = judged.where("NOT wins AND set_key IS NOT NULL").select("set_key").distinct()
        pairs = (
            meets.join(losers, "set_key", "left_semi")
            .join(asking, "pivot")
            .where(in_reach & (F.col("set_key") != F.col("other_key")))
            .where(_apart("far", "o_far") <= F.floor((F.col("size") + F.col("o_size")) / 3))
            .select("set_key", "other_key")
        )
        closed = won.union(cut(_verified(pairs, sets, sets)).select("set_key"))
        still_open = cut(_without(judged, winners, closed))
        before, n_open = n_open, still_open.count()
        if n_open and before - n_open < LEAST_DECIDED * before:
            left = rows.join(still_open.select("set_key").distinct(), "set_key", "left_semi")
            accepted += _by_links(still_open, cut(near_sets(left, sets, left, sets)))
            break
    out = accepted[0]
    for a in accepted[1:]:
        out = out.unionByName(a)
    return out


def check_batch(batch: DataFrame, history: History) -> tuple[DataFrame, History]:
    """Which items of a batch repeat accepted items, and the history with the batch's accepted items appended.

    ``batch`` as ``signatures`` gives it; what the history holds counts as earlier than the batch, within the batch the id
    decides. Returns the pairs ``item_id_a, item_id_b`` in which b is a case and a an accepted earlier item it repeats, by
    number or pictures. Copies meet through their number and their set of pictures, each of which has at most one accepted
    item, never pairwise. Of the history only rows of the batch's pictures, numbers and sets travel; none is computed or
    written again. Links and pairs are cut, so no plan grows with the batches and the driver holds that of one step at a time.
    """
    batch = stored(batch.select(*_NAMES, "pictures"), "batch")
    sets = stored(batch.where("set_key IS NOT NULL").select("set_key", "pictures").dropDuplicates(["set_key"]), "sets")
    rows = stored(pivot_table(sets).repartitionByRange("pivot", "band"), "pivots")
    items = batch.select(*_NAMES)
    pair = (F.col("a_item_id").alias("item_id_a"), F.col("item_id").alias("item_id_b"))

    def repeats(cases: DataFrame, accepted: DataFrame, links: DataFrame) -> DataFrame:
        a = accepted.select(*(F.col(c).alias(f"a_{c}") for c in _NAMES))
        found = cases.join(a, F.col("number") == F.col("a_number")).select(*pair)
        found = found.unionByName(cases.join(a, F.col("set_key") == F.col("a_set_key")).select(*pair))
        linked = cases.join(links, "set_key").join(a, F.col("other_key") == F.col("a_set_key"))
        return found.unionByName(linked.select(*pair)).distinct()

    old, rest = None, items
    if history.batches:
        old = cut(repeats(items, history.items, cut(near_sets(rows, sets, history.rows, history.sets))))
        rest = cut(items.join(old.select(F.col("item_id_b").alias("item_id")).distinct(), "item_id", "left_anti"))
    new = stored(_accepted_in_batch(rest.select(*_NAMES), rows, sets), "accepted")
    of = lambda df: df.where("set_key IS NOT NULL").select("set_key").distinct()
    cases = cut(items.join(new.select("item_id"), "item_id", "left_anti").select(*_NAMES))
    new_rows, new_sets = rows.join(of(new), "set_key", "left_semi"), sets.join(of(new), "set_key", "left_semi")
    if cases.isEmpty():
        pairs = cases.select(F.col("item_id").alias("item_id_a"), F.col("item_id").alias("item_id_b"))
    else:
        links = cut(near_sets(rows.join(of(cases), "set_key", "left_semi"), sets, new_rows, sets))
        pairs = cut(repeats(cases, new, links).where("item_id_a < item_id_b"))
    if old is not None:
        pairs = old.unionByName(pairs)
    return pairs, history.append(new, new_sets, new_rows.select(*rows.columns))
