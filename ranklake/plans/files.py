"""Queries that write files of a source's shape into the shared folder and read them back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ranklake.operators import notices as N
from ranklake.plans.notices import REFERENCE, SQL_TYPED, sql_date, sql_trim
from ranklake.plans.records import sql_missing
from ranklake.plans.registry import Registry, table
from ranklake.sources import readers, sinks
from ranklake.functions.text import is_missing, known, trimmed
from ranklake.session import shared_folder
from ranklake.streaming import streams

FILES = Registry()
#: Items of one file or page.
IN_FILE, IN_PAGE = 10_000, 100


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@FILES.add(
    "notices_from_json",
    f"SELECT notice_id, species, color, weight FROM notice_items WHERE NOT {sql_missing('notice_id')} AND ({sql_missing('species')} OR lower(species) = 'dog')",
)
def notices_from_json(spark, sf):
    """Files that hold a list, and files that hold an object with ``items``; a blank species passes the filter."""
    items = table(spark, sf, "notice_items").where(~is_missing(F.col("notice_id")))
    fields = F.struct("notice_id", "species", "color", "weight")
    lists = items.groupBy(F.floor(F.col("item_id") / IN_FILE).alias("part")).agg(F.to_json(F.collect_list(fields)).alias("j"))
    wrapped = F.when(F.col("part") % 2 == 0, F.col("j")).otherwise(F.concat(F.lit('{"items": '), "j", F.lit("}")))
    folder = _folder(spark, "notices")
    lists.select("part", wrapped.alias("value")).repartition("part").write.partitionBy("part").text(folder)
    return readers.notices_json(spark, f"{folder}/part=*", "dog").select("notice_id", "species", "color", "weight")


def _paged(spark, sf):
    """The items as saved pages, with an empty page after the last and a page behind it that must not count."""
    items = table(spark, sf, "notice_items").select("item_id", "notice_id", "source_status", "notice_end", "image_urls")
    page = (F.floor((F.col("item_id") - 1) / IN_PAGE) + 1).cast("int")
    one = F.to_json(F.struct("notice_id", "item_id", "source_status", "notice_end", "image_urls"))
    lists = items.groupBy(page.alias("page")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("j"))
    last = lists.agg(F.max("page").alias("m"))
    ends = last.select((F.coalesce("m", F.lit(0)) + 1).alias("page"), F.lit("[]").alias("j"))
    stray = last.select((F.coalesce("m", F.lit(0)) + 2).alias("page"), F.lit('[{"notice_id": "stray"}]').alias("j"))
    pages = lists.unionByName(ends).unionByName(stray)
    body = F.concat(F.lit('{"response": {"body": {"items": {"item": '), "j", F.lit("}}}}"))
    folder = _folder(spark, "pages")
    saved = pages.select("page", body.alias("value")).repartition("page")
    saved.write.partitionBy("page").text(folder)
    return folder


def _scan(spark, sf):
    # Spark names files by itself, so the number of a page is that of its folder.
    pages = spark.read.text(_paged(spark, sf), wholetext=True).select(F.col("page").cast("int").alias("page"), "value")
    rows = readers.page_items(pages, "notice_id")
    facts = rows.select("id", "page", F.from_json("payload", "item_id long, source_status string, notice_end string, image_urls string").alias("p")).select("id", "page", "p.*")
    status = N.notice_status(known(F.col("source_status")), N.notice_date(known(F.col("notice_end"))), REFERENCE)
    return readers.scanned(facts, status.isin("closed", "expired"), ~is_missing(F.col("image_urls")), ["item_id"])


_OUTCOMES = f"""SELECT id, item_id, page, CASE WHEN bad IS NOT NULL THEN bad WHEN row_number() OVER (PARTITION BY id, bad ORDER BY item_id) > 1 THEN 'duplicate'
  ELSE 'kept' END AS outcome FROM (SELECT i.item_id, nullif(trim(notice_id), '') AS id, ((i.item_id - 1) // {IN_PAGE} + 1)::INT AS page,
  CASE WHEN nullif(trim(notice_id), '') IS NULL THEN 'no id' WHEN t.status IN ('closed', 'expired') THEN 'closed' WHEN {sql_missing("image_urls")} THEN 'no picture' END
  AS bad FROM notice_items i JOIN ({SQL_TYPED}) t ON t.item_id = i.item_id)"""


@FILES.add("scan_counts", f"SELECT outcome, count(*) AS n, count(DISTINCT page) AS n_pages FROM ({_OUTCOMES}) GROUP BY outcome")
def scan_counts(spark, sf):
    """How a scan over saved pages ends for each row: kept, closed, without picture, duplicate or without id."""
    return _scan(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("n_pages"))


@FILES.add("scan_snapshot", f"SELECT id, item_id FROM ({_OUTCOMES}) WHERE outcome = 'kept'")
def scan_snapshot(spark, sf):
    """The scan's snapshot: active rows with a picture, of each id the first, swapped into place and read again."""
    folder = _folder(spark, "snapshot")
    sinks.separate([sf], [folder])
    sinks.replaced(_scan(spark, sf).where("outcome = 'kept'").select("id", "item_id"), folder)
    return spark.read.parquet(folder)


@FILES.add(
    "latest_by_species",
    """SELECT notice_id, item_id, species FROM (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY CASE lower(trim(species)) WHEN 'dog' THEN 0
    WHEN 'cat' THEN 1 ELSE 2 END, item_id DESC) AS n FROM notice_items WHERE notice_id IN (SELECT notice_id FROM qrels)) WHERE n = 1""",
)
def latest_by_species(spark, sf):
    """The item of each id asked for: of the preferred species, of these the latest."""
    bare = F.lower(F.trim("species"))
    order = F.when(bare == "dog", 0).when(bare == "cat", 1).otherwise(2)
    asked = table(spark, sf, "qrels").select("notice_id").distinct()
    best = F.min(F.struct(order.alias("o"), (-F.col("item_id")).alias("i"), "species")).alias("b")
    rows = table(spark, sf, "notice_items").join(asked, "notice_id", "left_semi").groupBy("notice_id").agg(best)
    return rows.select("notice_id", (-F.col("b.i")).alias("item_id"), "b.species")


@FILES.add(
    "date_window",
    f"SELECT item_id, notice_id FROM notice_items WHERE {sql_date('notice_start')} BETWEEN DATE '{REFERENCE}' - INTERVAL 30 DAY AND DATE '{REFERENCE}'",
)
def date_window(spark, sf):
    """What came since the last run, from a table in folders by day, of which only those of the window are read."""
    rows = table(spark, sf, "notice_items").select("item_id", "notice_id", N.notice_date(F.col("notice_start")).alias("day"))
    folder = _folder(spark, "days")
    rows.where("day IS NOT NULL").repartition("day").write.partitionBy("day").parquet(folder)
    since = F.date_sub(F.lit(REFERENCE), 30)
    return spark.read.parquet(folder).where(F.col("day").between(since, F.lit(REFERENCE))).select("item_id", "notice_id")


@FILES.add(
    "flattened_texts",
    f"""SELECT item_id, field, {sql_trim("v")} AS text FROM (SELECT item_id, unnest(['breed', 'color', 'desc_full']) AS field, unnest([breed, color, desc_full]) AS v
    FROM notice_items) WHERE length({sql_trim("v")}) > 0""",
)
def flattened_texts(spark, sf):
    """Lists of lists of records made flat, and their text fields one below the other."""
    one = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).alias("v"))
    lists = F.array(F.array(one("breed"), one("color")), F.array(one("desc_full")))
    nested = table(spark, sf, "notice_items").select("item_id", lists.alias("lists"))
    flat = nested.select("item_id", F.explode(F.flatten("lists")).alias("x"))
    return flat.select("item_id", F.col("x.field").alias("field"), trimmed(F.col("x.v")).alias("text")).where("length(text) > 0")


@FILES.add("query_sets", "SELECT profile_id AS query_id, session_code AS query_text, profile_id % 2 = 0 AS is_object FROM appearance_profiles")
def query_sets(spark, sf):
    """Query sets of which some lines are objects and some are plain strings."""
    p = table(spark, sf, "appearance_profiles").select("profile_id", "session_code")
    line = F.when(F.col("profile_id") % 2 == 0, F.to_json(F.struct(F.col("profile_id").alias("id"), F.col("session_code").alias("query"))))
    line = line.otherwise(F.to_json(F.struct(F.concat_ws("\t", F.col("profile_id").cast("string"), "session_code").alias("s"))))
    folder = _folder(spark, "queries")
    plain = F.when(F.col("profile_id") % 2 == 0, line).otherwise(F.concat_ws("\t", F.col("profile_id").cast("string"), "session_code"))
    p.select(plain.alias("value")).write.text(folder)
    lines = spark.read.text(folder)
    is_object = F.col("value").startswith("{")
    got = F.from_json(F.when(is_object, F.col("value")), "id long, query string")
    return lines.select(
        F.coalesce(got["id"], F.substring_index("value", "\t", 1).try_cast("long")).alias("query_id"),
        F.when(is_object, got["query"]).otherwise(F.substring_index("value", "\t", -1)).alias("query_text"), is_object.alias("is_object"),
    )


@FILES.add(
    "ratings_from_csv",
    "SELECT rater, count(*) AS n, sum(score) AS total FROM (SELECT DISTINCT id, rater, pair_id, score FROM rating_log) GROUP BY rater",
)
def ratings_from_csv(spark, sf):
    """Ratings written as CSV and read under a contract: header, types, unique ids, scores of 0 to 3, exactly the keys expected."""
    log = table(spark, sf, "rating_log").select("id", "rater", "pair_id", "score").distinct()
    folder = _folder(spark, "csv")
    log.write.option("header", True).csv(folder)
    rules = {"score": F.col("score").isNull() | F.col("score").between(0, 3), "rater": F.col("rater").isNotNull()}
    got = readers.checked_csv(spark, folder, "id long, rater string, pair_id string, score int", ["id"], rules, log.select("id"))
    return got.groupBy("rater").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


@FILES.add("blocks_from_text", "SELECT DISTINCT session_code AS name, preferred_size AS size, preferred_age AS age FROM appearance_profiles")
def blocks_from_text(spark, sf):
    """Blocks of key=value lines behind a mark."""
    p = table(spark, sf, "appearance_profiles").select("session_code", "preferred_size", "preferred_age").distinct()
    block = F.concat(F.lit("[query]\nname="), "session_code", F.lit("\nsize="), "preferred_size", F.lit("\nage="), "preferred_age")
    folder = _folder(spark, "blocks")
    p.select(block.alias("value")).write.text(folder)
    f = readers.text_blocks(spark, folder)
    return f.select(*(F.try_element_at("fields", F.lit(k)).alias(k) for k in ("name", "size", "age")))


@FILES.add("written_files", "SELECT count(*) > 0 AS any_file, true AS all_hashed, count(*) AS n_rows FROM qrels")
def written_files(spark, sf):
    """A table's files with size and digest, bound to the number of rows they hold."""
    folder = _folder(spark, "manifest")
    rows = table(spark, sf, "qrels")
    rows.write.parquet(folder)
    files = readers.file_digests(spark, folder).where(F.col("path").endswith(".parquet"))
    n = spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("n_rows"))
    state = files.agg((F.count(F.lit(1)) > 0).alias("any_file"), F.min((F.length("sha256") == 64) & (F.col("length") > 0)).alias("all_hashed"))
    return state.join(F.broadcast(n), F.lit(True))


@FILES.add(
    "upserted_ratings",
    """SELECT rater, pair_id, arg_max(score, (updated, id)) FILTER (WHERE true) AS score, max(updated)::VARCHAR AS updated FROM (SELECT rater, pair_id, updated, id,
    any_value(coalesce(score, -1)) AS score FROM rating_log GROUP BY ALL) GROUP BY rater, pair_id""",
)
def upserted_ratings(spark, sf):
    """A log of ratings taken in as a stream; every batch is appended and the ratings in force are brought up to date."""
    rows = table(spark, sf, "rating_log").select("id", "rater", "pair_id", F.coalesce("score", F.lit(-1)).alias("score"), "updated")
    folder = _folder(spark, "upserts")
    rows.repartition(3).write.parquet(f"{folder}/in")
    stream = streams.file_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    streams.upserts(stream, ["rater", "pair_id"], "updated", f"{folder}/log", f"{folder}/view", f"{folder}/state").awaitTermination()
    view = streams.latest_view(spark, f"{folder}/view")
    return view.select("rater", "pair_id", "score", F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))


_LAST = """(SELECT provider_id, max(snapshot_date) AS d, max(CASE WHEN snapshot_date < m THEN snapshot_date END) AS b FROM (SELECT provider_id, snapshot_date,
  max(snapshot_date) OVER (PARTITION BY provider_id) AS m FROM notice_snapshots) GROUP BY provider_id)"""
_STATE_AT = "SELECT s.provider_id, s.notice_id, max(s.source_status) AS status FROM notice_snapshots s JOIN " + _LAST + " l ON l.provider_id = s.provider_id AND s.snapshot_date = l.{at} WHERE s.notice_id IS NOT NULL GROUP BY ALL"


@FILES.add(
    "applied_sync",
    f"""SELECT n.provider_id, n.notice_id, n.status, CASE WHEN o.notice_id IS NULL THEN 'new' WHEN o.status IS DISTINCT FROM n.status THEN 'changed' ELSE 'retained' END
    AS origin FROM ({_STATE_AT.format(at="d")}) n LEFT JOIN ({_STATE_AT.format(at="b")}) o ON o.provider_id = n.provider_id AND o.notice_id = n.notice_id""",
)
def applied_sync(spark, sf):
    """Each provider's state of its date before the last, brought to its last date: what is stale goes, what is new comes in,
    what changed is taken from the last, everything else is kept as it was; swapped into place."""
    rows = table(spark, sf, "notice_snapshots").where("notice_id IS NOT NULL").select("provider_id", "snapshot_date", "notice_id", "source_status")
    days = table(spark, sf, "notice_snapshots").groupBy("provider_id", "snapshot_date").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("provider_id").orderBy(F.desc("snapshot_date")))
    last = days.withColumn("place", place).where("place <= 2").select("provider_id", "snapshot_date", "place")
    both = rows.join(F.broadcast(last), ["provider_id", "snapshot_date"])
    key = ["provider_id", "notice_id"]
    at = lambda k: F.max(F.when(F.col("place") == k, F.struct(F.lit(1).alias("there"), F.col("source_status").alias("status"))))
    met = both.groupBy(*key).agg(at(1).alias("new"), at(2).alias("old")).where("new IS NOT NULL")
    origin = F.when(F.col("old").isNull(), "new").when(~F.col("old.status").eqNullSafe(F.col("new.status")), "changed").otherwise("retained")
    status = F.when(origin == "retained", F.col("old.status")).otherwise(F.col("new.status"))
    folder = _folder(spark, "state")
    sinks.replaced(met.select(*key, status.alias("status"), origin.alias("origin")), folder)
    return spark.read.parquet(folder)


@FILES.add(
    "serving_snapshots",
    """SELECT day, provider_id, max(snapshot_date) AS served, max(snapshot_date) < day AS is_stale FROM (SELECT DISTINCT snapshot_date AS day FROM notice_snapshots) d
    JOIN (SELECT DISTINCT provider_id, snapshot_date FROM notice_snapshots) s ON s.snapshot_date <= d.day GROUP BY day, provider_id""",
)
def serving_snapshots(spark, sf):
    """Which snapshot answers on each day: the one of the day, else the latest before it; no provider answers before its first."""
    dates = table(spark, sf, "notice_snapshots").select("provider_id", "snapshot_date").distinct()
    # A row per day of the calendar and provider, whatever the number of notices.
    calendar = dates.select(F.col("snapshot_date").alias("day")).distinct()
    span = dates.groupBy("provider_id").agg(F.min("snapshot_date").alias("first"))
    grid = calendar.join(F.broadcast(span), F.col("day") >= F.col("first"))
    own = dates.select("provider_id", F.col("snapshot_date").alias("day"), F.col("snapshot_date").alias("own"))
    filled = grid.join(own, ["provider_id", "day"], "left")
    last = F.last("own", ignorenulls=True).over(Window.partitionBy("provider_id").orderBy("day"))
    out = filled.select("day", "provider_id", last.alias("served"))
    return out.withColumn("is_stale", F.col("served") < F.col("day"))
