"""Readers with contracts: they refuse what does not keep its declared shape."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklake.functions.text import is_missing

# The fields of a provider's notice.
NOTICE_SCHEMA = (
    "notice_id string, source_status string, species string, upkind string, notice_no string, breed string, "
    "breed_source string, mixed_breed boolean, sex string, age string, weight string, neuter string, color string, "
    "desc string, image_urls array<string>, notice_start string, notice_end string, detail_url string"
)


class ContractError(ValueError):
    """A source does not keep what it declares."""


def notices_json(spark: SparkSession, path: str, species: str | None = None) -> DataFrame:
    """Notices from files that hold a list, or an object with ``items`` (a list or a single one), with ``file_sha256``.

    A blank species passes a species filter. Rows that are no objects are left out; a notice without id is refused.
    """
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "utf-8")
    items = "array<struct<" + ",".join(x.strip().replace(" ", ":", 1) for x in NOTICE_SCHEMA.split(",")) + ">>"
    wrapped = F.get_json_object(text, "$.items")
    body = F.coalesce(wrapped, text)
    listed = F.when(F.trim(body).startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    rows = files.select(
        F.sha2("content", 256).alias("file_sha256"), F.posexplode(F.from_json(listed, items)).alias("pos", "n")
    ).where("n IS NOT NULL")
    rows = rows.select("file_sha256", "pos", "n.*")
    wanted = F.lit(True) if species is None else is_missing(F.col("species")) | (F.lower("species") == species.lower())
    rows = rows.where(wanted)
    return rows.withColumn(
        "notice_id",
        F.when(is_missing(F.col("notice_id")), F.raise_error(F.lit("a notice without id"))).otherwise(F.col("notice_id")),
    )


def first_files_win(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """All rows of several frames, of each key the one of the earliest frame, in it the least by ``order``."""
    union = None
    for i, df in enumerate(frames):
        part = df.withColumn("_frame", F.lit(i))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(key).orderBy("_frame", order))
    return union.withColumn("_place", place).where("_place = 1").drop("_place", "_frame")


def checked_csv(
    spark: SparkSession, path: str, schema: str, key: list[str], rules: dict[str, Column], expected: DataFrame | None = None
) -> DataFrame:
    """A CSV whose header, types, keys and rules hold; with ``expected`` keys, exactly those.

    The header of the first file is compared here, that of every other one by Spark as it reads. Raises ContractError naming what is broken. The checks are aggregates and anti joins; no row comes to the driver.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    header = spark.read.text(path).limit(1).first()
    found = [h.strip().strip('"') for h in header.value.lstrip("﻿").split(",")] if header else []
    if found != names:
        raise ContractError(f"header {found}, declared {names}")
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    df = df.option("encoding", "UTF-8").csv(path)
    broken = df.agg(*(F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(n) for n, ok in rules.items())).first() if rules else None
    if broken and any(broken.asDict().values()):
        raise ContractError(f"rules broken: { {k: v for k, v in broken.asDict().items() if v} }")
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ContractError(f"keys {key} repeat")
    if expected is not None:
        if not expected.join(df, key, "left_anti").isEmpty():
            raise ContractError("expected keys are missing")
        if not df.join(expected, key, "left_anti").isEmpty():
            raise ContractError("keys that are not expected")
    return df


def text_blocks(spark: SparkSession, path: str, mark: str = "[query]") -> DataFrame:
    """``block_no, fields MAP``: blocks of ``key=value`` lines that start with a mark."""
    whole = spark.read.text(path, wholetext=True)
    blocks = F.filter(F.split("value", F.concat(F.lit("\\Q"), F.lit(mark), F.lit("\\E"))), lambda b: F.trim(b) != "")
    rows = whole.select(F.posexplode(blocks).alias("block_no", "block"))
    lines = F.filter(F.split("block", r"\r?\n"), lambda x: x.contains("="))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.trim(F.regexp_replace(x, r"^[^=]*=", "")))
    return rows.select("block_no", F.map_from_entries(F.transform(lines, entry)).alias("fields"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def paged_json(spark: SparkSession, path: str, id_field: str = "notice_id") -> DataFrame:
    """``page, pos, id, payload`` from the saved pages of a JSON interface, files ``...<number>.json``; see ``page_items``."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    number = F.regexp_extract("file", r"([0-9]+)[^0-9]*\.json$", 1).try_cast("int")
    return page_items(files.select(number.alias("page"), "value").where("page IS NOT NULL"), id_field)


def page_items(pages: DataFrame, id_field: str) -> DataFrame:
    """``page, pos, id, payload``: the objects of ``pages(page, value)``.

    A page is ``{"response": {"body": {"items": {"item": [...]}}}}`` with a list or a single object; pages from the first
    empty one on do not count. ``id`` is null for an object without one. One row a page, no page comes to the driver.
    """
    item = F.get_json_object("value", "$.response.body.items.item")
    listed = F.when(F.trim(item).startswith("["), item).otherwise(F.concat(F.lit("["), item, F.lit("]")))
    none = F.array().cast("array<string>")
    pages = pages.select("page", F.coalesce(F.from_json(listed, "array<string>"), none).alias("items"))
    # One row: the number of the first empty page.
    empty = pages.where(F.size("items") == 0).agg(F.min("page").alias("end"))
    pages = pages.join(F.broadcast(empty), F.lit(True)).where("end IS NULL OR page < end")
    rows = pages.select("page", F.posexplode("items").alias("pos", "payload")).where(F.col("payload").startswith("{"))
    return rows.select("page", "pos", F.nullif(F.trim(F.get_json_object("payload", f"$.{id_field}")), F.lit("")).alias("id"), "payload")


def scanned(rows: DataFrame, closed: Column, has_picture: Column, order: list[str]) -> DataFrame:
    """``rows(id, ...)`` with ``outcome``: without id, closed, no picture, duplicate of an earlier row that would be kept, or kept."""
    bad = F.when(F.col("id").isNull(), "no id").when(closed, "closed").when(~has_picture, "no picture")
    rows = rows.withColumn("bad", bad)
    place = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    good = rows.where("bad IS NULL").withColumn("outcome", F.when(place > 1, "duplicate").otherwise("kept"))
    return good.unionByName(rows.where("bad IS NOT NULL").withColumn("outcome", F.col("bad"))).drop("bad")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """``archive, item_id, members``: the files in ZIP archives named ``<item>-<number>.<ending>``, in order of the number."""

    @F.pandas_udf("array<string>")
    def names(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: zipfile.ZipFile(io.BytesIO(c)).namelist())

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.explode(names("content")).alias("name"))
    found = F.regexp_extract("name", r"([^/]+)-([0-9]+)\.[a-zA-Z0-9]+$", 1)
    number = F.regexp_extract("name", r"-([0-9]+)\.[a-zA-Z0-9]+$", 1).try_cast("int")
    rows = files.select("archive", "name", found.alias("item_id"), number.alias("k")).where("item_id <> ''")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"])
    return rows.groupBy("archive", "item_id").agg(listed.alias("members"))


def result_contract(df: DataFrame, provider: str, declared: int | None = None) -> dict:
    """Counts of a scan result; raises ContractError if it is of another provider or of another size than declared."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("notice_id").alias("n_ids"),
        F.count(F.when(F.col("provider_id").eqNullSafe(provider), None).otherwise(1)).alias("n_other"),
    ).first()
    if row.n_other:
        raise ContractError(f"{row.n_other} rows of another provider than {provider}")
    if declared is not None and declared != row.n:
        raise ContractError(f"{declared} rows declared, {row.n} found")
    return {"n": row.n, "n_ids": row.n_ids}
