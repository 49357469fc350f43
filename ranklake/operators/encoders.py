"""Vectors from plugged-in encoders and from fixed projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def encoded(c: Column, load: Callable[[], Encoder]) -> Column:
    """A vector for each text from an encoder that is loaded once a task; null texts get none."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load()
        for texts in batches:
            known = [i for i, t in enumerate(texts) if t is not None]
            found = np.asarray(run([texts.iloc[i] for i in known]), dtype=np.float32) if known else []
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            for i, vector in zip(known, found, strict=True):
                out.iloc[i] = vector
            yield out

    return encode(c)


def projected(c: Column, matrix: list[list[float]]) -> Column:
    """The vector times a fixed matrix, given by its rows, at length 1; a matrix product for each Arrow batch.

    Null where the vector is null, is not as long as the rows or comes out as zero.
    """
    by = np.asarray(matrix, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            fits = [i for i, v in enumerate(vectors) if v is not None and len(v) == by.shape[1]]
            out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
            if fits:
                found = np.stack([vectors.iloc[i] for i in fits]).astype(np.float64) @ by.T
                norms = np.sqrt((found * found).sum(axis=1))
                for i, v, n in zip(fits, found, norms, strict=True):
                    out.iloc[i] = v / n if n > 1e-12 else None
            yield out

    return project(c)
