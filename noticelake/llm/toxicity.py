"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its hashed terms: words in lower case without outer punctuation,
and their first bytes (``STEMS`` of them), so that inflected words share terms. The
score is a logistic function of a bias, a weight per term and, for every pair of
terms, the product of their factor vectors: terms that are harmless alone, such as the
name of a group and an ambiguous word, can weigh together, also when neither says
anything alone. Terms whose frequency differs between the classes (likelihood ratio) have
weights and factors, so long texts do not gather noise. What these leave unexplained is left
to further factors, which all terms of at least ``PAIRED`` labelled documents have (a pair
of rarer terms could not be told from chance): they start near zero, grow only where pairs
keep explaining errors, and are kept only if they lower the loss on a tenth of the labelled
documents that they have not seen.

The model is fitted on at most ``most`` labelled documents, a documented bound; it is
an array of ``BUCKETS`` rows at most, whatever the corpus. Without labels, or with
labels of one kind, every score is the smoothed rate. Null and empty texts score by
the bias. Texts are read whole, however long. Repeated rows are scored alike, and each of
them that has a label is a labelled document; columns other than id and text are not
read, and an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticelake.llm import words as W
from noticelake.llm.common import slices
from noticelake.llm.labelled import held_out, sample

BUCKETS = 1 << 20
MOST = 12_000
FACTORS = 8
#: Documents of a term that has factors without differing between the classes.
PAIRED = 20
#: First spread of the factors: thousands of terms of it sum up to nothing.
SPREAD = 0.003
STEMS = (4, 5, 6)

_OUTER = np.zeros(256, bool)  # punctuation that may stand around a term
_OUTER[list(b".,;:!?\"'()[]{}<>*#$%&|_-/\\")] = True


class Model(NamedTuple):
    bias: float
    place: np.ndarray  # bucket -> row of the arrays below, the last row is of no term
    weights: np.ndarray
    factors: np.ndarray


def terms(text: bytes | None) -> np.ndarray:
    """The distinct buckets of a text's terms."""
    lower = np.frombuffer((text or b"").lower(), np.uint8).copy()
    lower[_OUTER[lower]] = 0x20
    starts, ends = W.spans(lower)
    found = [W.word_hashes(lower, starts, ends, 3)]
    for size in STEMS:
        longer = ends - starts > size
        found.append(W.word_hashes(lower, starts[longer], starts[longer] + size, 3) ^ np.uint64(size))
    return np.unique((np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64))


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def informative(rows: list[tuple[np.ndarray, int]], least: float = 8.0, one_in: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """The buckets in two documents, and one in ``one_in``, or more, whose likelihood ratio
    passes ``least``; and those together with all of ``PAIRED`` documents."""
    least_rows = max(2, len(rows) // one_in)
    y = np.array([label for _, label in rows])
    seen = np.zeros((2, BUCKETS))
    for buckets, label in rows:
        seen[label][buckets] += 1
    total = np.array([(y == 0).sum(), (y == 1).sum()], float)[:, None]
    both = seen.sum(0)
    share = both / total.sum()
    ratio = np.zeros(BUCKETS)
    with np.errstate(divide="ignore", invalid="ignore"):
        for got, expected in ((seen, total * share), (total - seen, total * (1 - share))):
            ratio += 2 * np.where(got > 0, got * np.log(got / expected), 0).sum(0)
    alone = (ratio > least) & (both >= least_rows)
    return np.flatnonzero(alone), np.flatnonzero(alone | (both >= max(PAIRED, least_rows)))


def train(rows: list[tuple[np.ndarray, int]], epochs: int = 12, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Adaptive gradient descent on the logistic loss, in a fixed random order: first the
    weights and factors of the terms that differ, then the further factors of all."""
    alone, chosen = informative(rows)
    k = len(chosen)
    place = np.full(BUCKETS, k, np.int32)
    place[chosen] = np.arange(k)
    known = [(p[p < k], y) for p, y in ((place[t], y) for t, y in rows)]
    differs = np.zeros(k + 1, bool)
    differs[place[alone]] = True
    rng = np.random.default_rng(11)
    good = sum(y for _, y in rows)
    bias = float(np.log((good + 1) / (len(rows) - good + 1)))
    w, v = np.zeros(k + 1), np.zeros((k + 1, FACTORS))
    v[place[alone]] = rng.normal(0, 0.02, (len(alone) + 1, FACTORS))[:-1]
    gw, gv, gb = np.full(k + 1, 1e-8), np.full((k + 1, FACTORS), 1e-8), 1e-8
    telling = [(at[differs[at]], y) for at, y in known]
    for _ in range(epochs):
        for i in rng.permutation(len(known)):
            at, y = telling[i]
            f = v[at]
            total = f.sum(0)
            error = _logistic(bias + w[at].sum() + _pairs(f)) - y
            gb += error * error
            bias -= rate * error / gb ** 0.5
            step = error + decay * w[at]
            gw[at] += step ** 2
            w[at] -= rate * step / np.sqrt(gw[at])
            step = error * (total - f) + decay * f
            gv[at] += step ** 2
            v[at] -= rate * step / np.sqrt(gv[at])
    base = [bias + float(w[at].sum()) + _pairs(v[at]) for at, _ in telling]
    more = _further(known, base, k, epochs, rate, decay, rng)
    return Model(bias, place, w.astype(np.float32), (v if more is None else np.hstack([v, more])).astype(np.float32))


def _further(known: list[tuple[np.ndarray, int]], base: list[float], k: int, epochs: int, rate: float, decay: float,
             rng: np.random.Generator) -> np.ndarray | None:
    """Factors of all terms for what ``base`` leaves unexplained; none if they explain
    nothing on the rows held back."""
    order = rng.permutation(len(known))
    back, seen = order[:len(known) // 10], order[len(known) // 10:]
    if not len(back):
        return None
    v = rng.normal(0, SPREAD, (k + 1, FACTORS))
    v[k] = 0
    gv = np.ones((k + 1, FACTORS))  # first steps are as small as their gradients
    for _ in range(epochs):
        for i in rng.permutation(seen):
            at, y = known[i]
            f = v[at]
            step = (_logistic(base[i] + _pairs(f)) - y) * (f.sum(0) - f) + decay * f
            gv[at] += step ** 2
            v[at] -= rate * step / np.sqrt(gv[at])
    gain = np.array([_loss(base[i], known[i][1]) - _loss(base[i] + _pairs(v[known[i][0]]), known[i][1]) for i in back])
    return v if gain.mean() > 2 * gain.std() / len(gain) ** 0.5 else None


def _pairs(f: np.ndarray) -> float:
    """The sum of the products of all pairs of factor vectors."""
    return 0.5 * float((f.sum(0) ** 2 - (f ** 2).sum(0)).sum())


def _loss(x: float, y: int) -> float:
    return float(np.logaddexp(0, -x if y else x))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, part: int = 0, most: int = MOST,
        doc_id: str = "doc_id", text: str = "text", **how) -> Model:
    """The model of a bounded sample of labelled documents outside the held-out fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [terms(t).astype(np.int32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], names=["id", "terms", "y"])

    chosen = sample(docs, labels, label, folds, part, most, doc_id, text).select("id", "t", "y")
    found = chosen.mapInArrow(run, "id long, terms binary, y int")
    rows = [(np.frombuffer(r.terms, np.int32), r.y)
            for r in found.orderBy(F.xxhash64("id", "terms")).limit(most).toLocalIterator()]
    good = sum(y for _, y in rows)
    if not 0 < good < len(rows):
        none = np.zeros(BUCKETS, np.int32)
        return Model(float(np.log((good + 1) / (len(rows) - good + 1))), none, np.zeros(1, np.float32), np.zeros((1, FACTORS), np.float32))
    return train(rows, **how)


def score(text: bytes | None, model: Model) -> float:
    at = model.place[terms(text)]
    at = at[at < len(model.weights) - 1]
    f = model.factors[at].astype(np.float64)
    return _logistic(model.bias + float(model.weights[at].sum(dtype=np.float64)) + _pairs(f))


def scores(docs: DataFrame, model: Model, folds: int = 5, part: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS ints, and rows of factors for the terms of the labelled sample

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
