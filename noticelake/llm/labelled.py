"""Labelled rows for the text classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def held_out(doc_id: str, folds: int, part: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, part: int, most: int,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(t: text as bytes, y: 0 or 1) of at most ``most`` documents that have a label and
    are not in fold ``part``, by lowest hash of their id. Null labels and null ids do
    not count; of several labels of an id the largest holds."""
    y = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id, folds, part))
    y = y.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    y = y.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("t"))
    # ``y`` has at most ``most`` rows of 12 bytes; repeated ids may give more documents.
    return rows.join(F.broadcast(y), "id")
