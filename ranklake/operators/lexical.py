"""Inverted lists and BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.functions.vocabulary import BM25_B, BM25_K1
from ranklake.operators.notices import tokens
from ranklake.session import cut, small_side, stored

#: Most kinds of queries that one block holds, and most cells of a matrix of documents and kinds.
BLOCK, CELLS = 2_048, 2_000_000
#: Up to so many different words are looked for within a text; more are joined.
MOST_WORDS = 5_000


def postings(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """``doc_id, term, tf, doc_length``. The length is taken before terms are counted, so no second pass is needed."""
    words = docs.select(doc_id.alias("doc_id"), tokens(text).alias("words"))
    each = words.select("doc_id", F.size("words").alias("doc_length"), F.explode("words").alias("term"))
    return each.groupBy("doc_id", "doc_length", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_size(docs: DataFrame, text: Column) -> DataFrame:
    """One row ``n_docs, mean_length`` over all documents, also those without words."""
    return docs.select(F.size(tokens(text)).alias("n")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean_length")
    )


def bm25(docs: DataFrame, doc_id: Column, text: Column, queries: DataFrame, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """``query_id, doc_id, bm25`` of every document that shares a word with a query, ``queries(query_id, query_text)``.

    A word that a query repeats counts each time. The queries' words are the small side of the join with the lists; only
    the lists of words that are asked for are kept before document frequencies are counted.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query_text"))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    lists = postings(docs, doc_id, text).join(asked.select("term").distinct(), "term", "left_semi")
    df = lists.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # One row: the corpus size, joined to the words asked for, not to the lists.
    size = corpus_size(docs, text)
    weights = asked.join(df, "term").join(F.broadcast(size), F.lit(True))
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = weights.select("query_id", "term", (idf * F.col("qf")).alias("idf"), "mean_length")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (
        F.col("tf") + k1 * (1 - b + b * F.col("doc_length") / F.col("mean_length"))
    )
    scored = weights.join(lists, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("bm25"))
    return scored.where("bm25 > 0")


def bm25_top(
    docs: DataFrame, doc_id: Column, text: Column, queries: DataFrame, k: int, decimals: int = 6, k1: float = BM25_K1, b: float = BM25_B
) -> DataFrame:
    """``query_id, doc_id, bm25, rank``: the k best documents of each query, scores rounded, ties to the lower id.

    The same as the k best of ``bm25``, without its pairs. Texts are read once, and only the words asked for become rows. Queries that ask for the same words, each as often, are one kind; every task multiplies its documents with a
    block of kinds and keeps the k best of each, so what is shuffled is k rows a kind and task, and the queries meet their
    kind's k documents at the end.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query_text"))).alias("term"))
    asked = cut(asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf")))
    wanted = cut(asked.select(F.col("term").alias("word")).distinct())
    words = docs.select(doc_id.alias("doc_id"), tokens(text).alias("words"))
    few = [r.word for r in wanted.limit(MOST_WORDS + 1).collect()]
    if len(few) <= MOST_WORDS:
        found = F.filter("words", lambda w: w.isin(few))
        each = words.select("doc_id", F.size("words").alias("doc_length"), F.posexplode_outer(found).alias("i", "term"))
    else:
        each = words.select("doc_id", F.size("words").alias("doc_length"), F.posexplode_outer("words").alias("i", "word"))
        each = each.join(small_side(wanted.withColumn("term", F.col("word"))), "word", "left")
    # A document without a word that is asked for keeps a row; "own" counts each document once, for the mean length.
    own = F.count(F.when(F.coalesce("i", F.lit(0)) == 0, 1))
    counts = stored(each.groupBy("doc_id", "doc_length", "term").agg(F.count("term").alias("tf"), own.alias("own")), "counts")
    lists = counts.where("term IS NOT NULL")
    df = lists.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n_docs, n_words = docs.count(), counts.agg(F.coalesce(F.sum(F.col("doc_length") * F.col("own")), F.lit(0))).first()[0]
    idf = F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(df, "term").select("query_id", F.struct("term", "qf", (idf * F.col("qf")).alias("idf")).alias("word"))
    known = known.groupBy("query_id").agg(F.array_sort(F.collect_list("word")).alias("words"))
    name = F.array_join(F.transform("words", lambda w: F.concat_ws(":", w["term"], w["qf"].cast("string"))), " ")
    known = cut(known.select("query_id", name.alias("kind"), "words"))
    kinds = known.groupBy("kind").agg(F.first("words").alias("words"))
    n_blocks = max(1, -(-5 * kinds.count() // (4 * BLOCK)))
    blocks = kinds.groupBy(F.pmod(F.xxhash64("kind"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("kind", "words")).alias("q"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_length") / F.lit(n_words / max(1, n_docs))))
    hits = lists.groupBy("doc_id").agg(F.collect_list(F.struct("term", part.alias("part"))).alias("h"))
    hits = hits.select("doc_id", F.col("h.term").alias("terms"), F.col("h.part").alias("parts"))
    shape = f"kind string, doc_id {dict(hits.dtypes)['doc_id']}, bm25 double"
    out = docs.sparkSession.createDataFrame([], shape)
    for row in blocks.toLocalIterator():
        names = np.array([x.kind for x in row.q], dtype=object)
        at = {t: i for i, t in enumerate(sorted({w.term for x in row.q for w in x.words}))}
        weights = np.zeros((len(at), len(names)))
        for j, x in enumerate(row.q):
            for w in x.words:
                weights[at[w.term], j] = w.idf

        def best(batches: Iterator[pd.DataFrame], names=names, at=at, weights=weights) -> Iterator[pd.DataFrame]:
            step, keep = max(1, CELLS // max(weights.shape)), None
            for g in batches:
                g = g.sort_values("doc_id")
                for i in range(0, len(g), step):
                    c = g.iloc[i : i + step]
                    n = len(c)
                    each = [(r, at[t], p) for r, (ts, ps) in enumerate(zip(c.terms, c.parts)) for t, p in zip(ts, ps) if t in at]
                    if not each:
                        continue
                    r, t, p = map(np.array, zip(*each))
                    x = np.zeros((n, len(at)))
                    np.add.at(x, (r, t), p)
                    s = (x @ weights).T
                    units = np.where(s > 0, np.floor(s * 10**decimals + 0.5), -1).astype(np.int64)
                    # Documents stand in order of their ids, so of equal scores the earlier place is the better one.
                    first = np.argpartition(-(units * n + np.arange(n - 1, -1, -1)), min(k, n) - 1, axis=1)[:, : min(k, n)]
                    found = [np.take_along_axis(units, first, 1), c.doc_id.to_numpy()[first]]
                    keep = found if keep is None else [np.concatenate(two, axis=1) for two in zip(keep, found)]
                    order = np.lexsort((keep[1], -keep[0]), axis=1)[:, :k]
                    keep = [np.take_along_axis(a, order, 1) for a in keep]
            if keep is not None:
                rows = pd.DataFrame({"kind": np.repeat(names, keep[0].shape[1]), "doc_id": keep[1].ravel(), "bm25": keep[0].ravel() / 10**decimals})
                yield rows[keep[0].ravel() >= 0]

        out = out.unionByName(hits.mapInPandas(best, shape))
    found = top_k(out, "bm25", k, query="kind")
    return known.select("query_id", "kind").join(found, "kind").select("query_id", "doc_id", "bm25", "rank")


def top_k(scores: DataFrame, by: str, k: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """The k best of each query, ties to the lower key, with ``rank`` from 1; cut within tasks before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.desc(by), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
