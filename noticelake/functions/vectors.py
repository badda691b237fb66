"""Dense vectors: cosine similarity and the default hashing vectorizer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from noticelake.functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column, unit: bool = False) -> Column:
    """Cosine of two arrays; ``unit=True`` skips the norms for unit vectors."""
    return dot(a, b) if unit else F.try_divide(dot(a, b), norm(a) * norm(b))


def hashing_vector(text: Column, dimensions: int = 64) -> Column:
    """Deterministic bag-of-words vector of a text, L2-normalized.

    Slot of a word = leading 32 bits of its MD5 modulo ``dimensions``. The slots are
    found in the JVM and counted per Arrow batch, row by row: nothing is shuffled. A
    text without words becomes a zero vector."""
    slots = F.transform(F.coalesce(tokens(text), F.array().cast("array<string>")),
                        lambda w: (F.conv(F.left(F.md5(w), F.lit(8)), 16, 10).cast("long") % dimensions).cast("int"))

    @F.pandas_udf("array<float>")
    def counted(column: pd.Series) -> pd.Series:
        def vector(row):
            n = np.bincount(row, minlength=dimensions).astype(np.float64) if len(row) else np.zeros(dimensions)
            return (n / (np.sqrt((n * n).sum()) or 1.0)).astype(np.float32)
        return column.map(vector)

    return counted(slots)


def hashing_vectors(df: DataFrame, key: str, text: str, dimensions: int = 64) -> DataFrame:
    """(key, embedding) per row."""
    return df.select(key, hashing_vector(F.col(text), dimensions).alias("embedding"))
