"""A character n-gram inverted index over a reference list, and weighted edit distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.session import cut, small_side


def char_ngrams(c: Column, sizes: tuple[int, ...]) -> Column:
    """All n-grams of ``c`` between marks for its ends; with size 1, the characters without marks."""
    marked = F.concat(F.lit("^"), c, F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(marked) - (n - 1))
        grams = F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))
        return F.when(F.length(marked) >= n, grams).otherwise(F.array().cast("array<string>"))

    grams = [of_size(n) for n in sizes if n > 1]
    if 1 in sizes:
        grams.append(F.filter(F.split(c, ""), lambda x: x != ""))
    return F.flatten(F.array(*grams))


def gram_counts(df: DataFrame, keys: list[str], grams: str) -> DataFrame:
    return (
        df.select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("tf"))
    )


def indexed_cosine(queries: DataFrame, entries: DataFrame, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weighted cosine of each query text with the entries that share an n-gram with it.

    ``queries(field, text)`` and ``entries(field, ref_id, name)``, texts already normalised; returns ``field, text,
    ref_id, name, cosine``. A gram weighs ``ln(1 + N / df)`` over the N entry names of its field, one that no entry has
    as much as the rarest. Blank and null texts have no grams and give nothing. The index is as large as the reference
    list; a query meets at most the entries of its own field, so a gram that many queries share makes no hot pair group.
    """
    named = entries.where("name <> ''").select("field", "ref_id", "name").distinct()
    tf = gram_counts(named.withColumn("grams", char_ngrams(F.col("name"), sizes)), ["field", "ref_id", "name"], "grams")
    size = named.groupBy("field").agg(F.count(F.lit(1)).alias("n_names"))
    tf, size = cut(tf), cut(size)
    idf = (
        tf.groupBy("field", "gram")
        .agg(F.count(F.lit(1)).alias("df"))
        .join(size, "field")
        .select("field", "gram", F.log1p(F.col("n_names") / F.col("df")).alias("idf"))
    )
    idf = small_side(idf)
    postings = tf.join(idf, ["field", "gram"]).select(
        "field", "gram", "ref_id", "name", (F.col("tf") * F.col("idf")).alias("w"), "idf"
    )
    norms = postings.groupBy("field", "ref_id", "name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    postings = postings.join(norms, ["field", "ref_id", "name"]).withColumn("w", F.col("w") / F.col("norm"))
    postings = small_side(postings.select("field", "gram", "ref_id", "name", "w"))

    asked = queries.where("text <> ''").select("field", "text").distinct()
    q = gram_counts(asked.withColumn("grams", char_ngrams(F.col("text"), sizes)), ["field", "text"], "grams")
    q = q.join(size, "field").join(idf.select("field", "gram", "idf"), ["field", "gram"], "left")
    q = q.withColumn("w", F.col("tf") * F.coalesce("idf", F.log1p(F.col("n_names"))))
    q = cut(q.select("field", "text", "gram", "w"))
    q_norm = q.groupBy("field", "text").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q_norm"))
    dots = (
        q.select("field", "text", "gram", F.col("w").alias("q_w"))
        .join(postings.select("field", "gram", "ref_id", "name", "w"), ["field", "gram"])
        .groupBy("field", "text", "ref_id", "name")
        .agg(F.sum(F.col("q_w") * F.col("w")).alias("dot"))
    )
    return dots.join(q_norm, ["field", "text"]).select(
        "field", "text", "ref_id", "name", (F.col("dot") / F.col("q_norm")).alias("cosine")
    )


def edit_distance(
    a: str,
    b: str,
    *,
    cheap_tail: tuple[str, ...] = (),
    swap: float = 1.0,
    twin: float = 1.0,
    differs: Callable[[str, str], float] = lambda x, y: 1.0,
) -> float:
    """Edit distance with adjacent swaps; a doubled character costs ``twin``, a cheap tail of ``a`` costs 0.1.

    ``differs`` gives the cost of one character for another.
    """
    for tail in cheap_tail:
        if a != b and a.endswith(tail) and len(a) > len(tail):
            shorter = edit_distance(a[: -len(tail)], b, swap=swap, twin=twin, differs=differs)
            return min(edit_distance(a, b, swap=swap, twin=twin, differs=differs), shorter + 0.1)
    before: list[float] = []
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [float(i)]
        for j, y in enumerate(b, 1):
            drop = twin if i > 1 and a[i - 2] == x else 1.0
            best = min(row[j - 1] + (differs(x, y) if x != y else 0.0), row[j] + drop, new[j - 1] + 1.0)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + swap)
            new.append(best)
        before, row = row, new
    return row[-1]


def with_distance(pairs: DataFrame, left: str, right: str, out: str, measure: Callable[[str, str], float]) -> DataFrame:
    """``pairs`` with ``measure`` of two text columns as ``out``; meant for pairs with a reference list."""

    @F.pandas_udf("double")
    def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(
                [None if x is None or y is None else measure(x, y) for x, y in zip(a, b, strict=True)], dtype="float64"
            )

    return pairs.withColumn(out, distance(left, right))
