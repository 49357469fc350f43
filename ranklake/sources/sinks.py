"""Sinks: whole or not at all, never over their own input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def separate(inputs: list[str], outputs: list[str]) -> None:
    """Refuse outputs that are inputs or that repeat."""
    plain = lambda p: p.removeprefix("file://").removeprefix("file:").rstrip("/")
    ins, outs = [plain(p) for p in inputs], [plain(p) for p in outputs]
    if len(set(outs)) < len(outs) or set(ins) & set(outs):
        raise ValueError("outputs must differ from each other and from the inputs")


def replaced(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write beside the target and put it in its place once the write has ended well."""
    spark = df.sparkSession
    beside, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(beside)
    jvm = spark.sparkContext._jvm
    new_path, target, old_path = (jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path, old))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(target)
    if had:
        fs.rename(target, old_path)
    if not fs.rename(new_path, target):
        if had:
            fs.rename(old_path, target)
        raise OSError(f"cannot put {beside} in place of {path}")
    if had:
        fs.delete(old_path, True)


def canonical_rows(df: DataFrame) -> DataFrame:
    """``json, sha256`` of each row with its fields in order of name; nulls are left out."""
    text = F.to_json(F.struct(*sorted(df.columns)))
    return df.select(text.alias("json"), F.sha2(text, 256).alias("sha256"))


def fingerprint(df: DataFrame) -> str:
    """One digest for the rows of a table in whatever order: the sum of the rows' 64-bit hashes, their number and schema."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(*(x for c in sorted(df.columns) for x in (F.col(c).isNull(), F.col(c)))).cast("decimal(38,0)")).alias("s"),
    ).first()
    names = ",".join(f"{n}:{t}" for n, t in sorted(df.dtypes))
    return f"{row.n}-{row.s or 0}-{names}"


def append_rating(df: DataFrame, log_path: str) -> None:
    """Ratings are only ever appended; the ratings in force are a view over the log."""
    df.write.mode("append").parquet(log_path)
