"""A sparse text classifier: weighted words and a logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.operators.notices import tokens
from ranklake.operators.splits import hash_unit

#: Most labelled rows a fit uses; beyond, a share of the rows is drawn by hash of their key.
MOST_ROWS = 200_000


def fit_text_classifier(df: DataFrame, key: str, text: str, label: str, least_docs: int = 3, words: int = 100_000) -> PipelineModel:
    """Fit on words and pairs of words, ``label`` 0 or 1; at most about MOST_ROWS rows, drawn by hash."""
    n = df.count()
    share = min(1.0, MOST_ROWS / max(1, n))
    used = df.where(hash_unit(F.lit("fit"), F.col(key)) < share) if share < 1 else df
    used = used.select(F.col(label).cast("double").alias("label"), tokens(F.col(text)).alias("words"))
    stages = [
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="counts", minDF=float(least_docs), vocabSize=words),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(used)


def classified(model: PipelineModel, df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, score``: the probability of label 1 for every row."""
    from pyspark.ml.functions import vector_to_array

    rows = model.transform(df.select(F.col(key).alias("key"), tokens(F.col(text)).alias("words")))
    return rows.select("key", F.round(vector_to_array("probability")[1], 6).alias("score"))
