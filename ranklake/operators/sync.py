"""Bringing a table up to date: differences, merges, gates, coverage and audits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.functions.text import canonical_hash


def sync_actions(existing: DataFrame, fresh: DataFrame, key: str, text: list[str], picture: list[str]) -> DataFrame:
    """``key, action``: new, stale, changed_text, changed_picture, changed_both or retained, from a full outer join."""
    side = lambda df, p: df.select(
        F.col(key).alias(f"{p}_key"),
        canonical_hash(*(F.col(c) for c in text)).alias(f"{p}_text"),
        canonical_hash(*(F.col(c) for c in picture)).alias(f"{p}_picture"),
    )
    met = side(existing, "e").join(side(fresh, "f"), F.col("e_key") == F.col("f_key"), "full_outer")
    text_new, picture_new = F.col("e_text") != F.col("f_text"), F.col("e_picture") != F.col("f_picture")
    action = (
        F.when(F.col("e_key").isNull(), "new")
        .when(F.col("f_key").isNull(), "stale")
        .when(text_new & picture_new, "changed_both")
        .when(text_new, "changed_text")
        .when(picture_new, "changed_picture")
        .otherwise("retained")
    )
    return met.select(F.coalesce("e_key", "f_key").alias("key"), action.alias("action"))


def safety_gates(
    actions: DataFrame, least_fresh: int = 1, most_removed: float = 0.5, by: list[str] | None = None
) -> DataFrame:
    """``n_fresh, removed_fraction, passed`` of each group ``by``: whether a refresh looks whole enough to be applied."""
    by = by or []
    counts = actions.groupBy(*by).agg(
        F.count(F.when(F.col("action") != "stale", 1)).alias("n_fresh"),
        F.count(F.when(F.col("action") == "stale", 1)).alias("gone"),
        F.count(F.when(F.col("action") != "new", 1)).alias("had"),
    )
    share = F.coalesce(F.try_divide("gone", "had"), F.lit(0.0))
    passed = (F.col("n_fresh") >= least_fresh) & (share <= most_removed)
    return counts.select(*by, "n_fresh", F.round(share, 6).alias("removed_fraction"), passed.alias("passed"))


def merged(target: DataFrame, source: DataFrame, key: str, cols: list[str], fill_only: bool = False) -> DataFrame:
    """``target`` with the source's non-missing values, or with only its own blanks filled."""
    s = source.select(F.col(key).alias("s_key"), *(F.col(c).alias(f"s_{c}") for c in cols))
    met = target.join(s, F.col(key) == F.col("s_key"), "left")
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    pick = lambda c: (
        F.coalesce(full(F.col(c)), full(F.col(f"s_{c}"))) if fill_only else F.coalesce(full(F.col(f"s_{c}")), F.col(c))
    )
    return met.select(key, *(pick(c).alias(c) for c in cols))


def best_records(df: DataFrame, key: str, cols: list[str], order: Column) -> DataFrame:
    """One record per key: the one with most known fields, then by ``order``; ``n_known`` says how many."""
    known = sum((F.when(F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    best = df.groupBy(key).agg(F.min(F.struct((-known).alias("k"), order.alias("o"), *cols)).alias("r"))
    return best.select(key, (-F.col("r.k")).alias("n_known"), *(F.col(f"r.{c}").alias(c) for c in cols))


def first_known(df: DataFrame, key: str, order: Column, cols: list[str]) -> DataFrame:
    """Each field's first known value per key in the given order."""
    value = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return df.groupBy(key).agg(
        *(F.min(F.when(value(c).isNotNull(), F.struct(order.alias("o"), value(c).alias("v"))))["v"].alias(c) for c in cols)
    )


def freshness(df: DataFrame, key: str, seen: Column, reference: date, most_days: int) -> DataFrame:
    """``bucket, n``: ids by the age of their last date: missing, future, fresh or stale."""
    last = df.groupBy(key).agg(F.max(seen).alias("last"))
    days = F.datediff(F.lit(reference), "last")
    bucket = F.when(F.col("last").isNull(), "missing").when(days < 0, "future").when(days <= most_days, "fresh").otherwise("stale")
    return last.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def exposure(corpus: DataFrame, shown: DataFrame, dims: list[str]) -> DataFrame:
    """``system_id, dim, value, corpus_share, shown_share, ratio``: how a group's share of places compares with the corpus.

    ``corpus(doc_id, dims...)``, ``shown(system_id, doc_id)``; a null value is the group "unknown".
    """
    named = corpus.select("doc_id", *(F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in dims))
    long = named.unpivot(["doc_id"], dims, "dim", "value")
    in_corpus = long.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("nc"))
    all_corpus = in_corpus.groupBy("dim").agg(F.sum("nc").alias("tc"))
    seen = shown.join(long, "doc_id").groupBy("system_id", "dim", "value").agg(F.count(F.lit(1)).alias("ns"))
    all_seen = seen.groupBy("system_id", "dim").agg(F.sum("ns").alias("ts"))
    met = seen.join(all_seen, ["system_id", "dim"]).join(in_corpus, ["dim", "value"]).join(all_corpus, "dim")
    c, s = F.col("nc") / F.col("tc"), F.col("ns") / F.col("ts")
    return met.select(
        "system_id", "dim", "value", F.round(c, 6).alias("corpus_share"), F.round(s, 6).alias("shown_share"),
        F.round(s / c, 6).alias("ratio"),
    )


def exclusion_reasons(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``reason, n``: how many rows each reason excludes, the first that holds; "kept" for the others."""
    reason = F.lit("kept")
    for name, test in reversed(reasons.items()):
        reason = F.when(test, name).otherwise(reason)
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
