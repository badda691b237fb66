"""Quality classifier: logistic regression over hashed word n-grams, fitted with
follow-the-regularised-leader updates, scored as a sparse dot product.

Words enter twice, in lower case and as a shape (letters, capitals, digits and signs,
runs collapsed: ``Word,`` -> ``Aa,``), as n-grams of one and two words and one to
three shapes; a repeated word is a shape of its own. A feature's value is its share of
the text's n-grams of that kind, so a score is a mean weight per kind, at any length.

The model is fitted on at most ``most`` labelled documents, a documented bound; it is
an array of ``BUCKETS`` weights, whatever the corpus. Without labels, or with labels of
one kind, every score is the smoothed rate. Null and empty texts score by the bias."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticelake.llm import words as W
from noticelake.llm.common import slices
from noticelake.llm.labelled import held_out, sample

BUCKETS = 1 << 19
MOST = 6000
KINDS = ((0, 1), (0, 2), (1, 1), (1, 2), (1, 3))  # (lower case or shape, words)
SCALE = 10.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")


class Model(NamedTuple):
    bias: float
    weights: np.ndarray


def features(text: bytes | None) -> list[np.ndarray]:
    """Buckets of the text's n-grams, by kind, repeats included."""
    raw = np.frombuffer(text or b"", np.uint8)
    lower = np.frombuffer((text or b"").lower(), np.uint8)
    starts, ends = W.spans(lower)
    if not len(starts):
        return [np.empty(0, np.int64)] * len(KINDS)
    words = W.word_hashes(lower, starts, ends)
    shape = _SHAPE[raw]
    shape = shape[np.concatenate(([True], (shape[1:] != shape[:-1]) | W.SPACE[shape[1:]]))]
    shapes = W.word_hashes(shape, *W.spans(shape), 1)
    shapes[1:][words[1:] == words[:-1]] ^= np.uint64(0x9E3779B97F4A7C15)
    both = (words, shapes)
    return [(W.window_hashes(both[which], n, which) ^ np.uint64(7919 * k)) % np.uint64(BUCKETS) if len(words) >= n
            else np.empty(0, np.uint64) for k, (which, n) in enumerate(KINDS)]


def vector(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their values."""
    grams = features(text)
    values = [np.full(len(g), SCALE / max(1, len(g)), np.float64) for g in grams]
    buckets, at = np.unique(np.concatenate(grams).astype(np.int64), return_inverse=True)
    return buckets, np.bincount(at, np.concatenate(values), len(buckets))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.05) -> Model:
    """Per-coordinate FTRL-proximal over (buckets, values, label), in a fixed random order."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rng = np.random.default_rng(7)
    order = [i for _ in range(epochs) for i in rng.permutation(len(rows))]

    def weights(at):
        sign = np.sign(z[at])
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - sign * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for i in order:
        buckets, values, y = rows[i]
        at = np.append(buckets, BUCKETS)  # the last is the bias
        x = np.append(values, 1.0)
        w = weights(at)
        g = (_logistic(float(w @ x)) - y) * x
        z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
        n[at] += g * g
    all_ = weights(np.arange(BUCKETS + 1))
    return Model(float(all_[-1]), all_[:-1].astype(np.float32))


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, part: int = 1, most: int = MOST,
        doc_id: str = "doc_id", text: str = "text", **how) -> Model:
    """The model of a bounded sample of labelled documents outside the held-out fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            vectors = [vector(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([v[0].astype(np.int32).tobytes() for v in vectors], pa.binary()),
                 pa.array([v[1].astype(np.float32).tobytes() for v in vectors], pa.binary()), b.column(2)],
                names=["id", "buckets", "x", "y"])

    chosen = sample(docs, labels, label, folds, part, most, doc_id, text).select("id", "t", "y")
    found = chosen.mapInArrow(run, "id long, buckets binary, x binary, y int")
    rows = [(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.x, np.float32), r.y)
            for r in found.orderBy(F.xxhash64("id", "buckets")).limit(most).toLocalIterator()]
    good = sum(y for *_, y in rows)
    if not 0 < good < len(rows):
        return Model(float(np.log((good + 1) / (len(rows) - good + 1))), np.zeros(BUCKETS, np.float32))
    return ftrl(rows, **how)


def score(text: bytes | None, model: Model) -> float:
    total = model.bias
    for grams in features(text):
        if len(grams):
            total += SCALE * float(model.weights[grams].mean(dtype=np.float64))
    return _logistic(total)


def scores(docs: DataFrame, model: Model, folds: int = 3, part: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [score(t, known.value) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64())],
                                             names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id, folds, part).alias("held_out"),
                       F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    return scores(docs, fit(docs, labels, **how))
