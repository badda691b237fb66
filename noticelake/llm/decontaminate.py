"""Benchmark passages in documents, by latent semantic retrieval.

Terms are words in lower case without punctuation. Documents are written once as the
positions of the terms that occur in the benchmark; a passage is ``BLOCK`` words.
Document frequencies over all passages give inverse-frequency weights, and a
randomised SVD of the weighted passages, two passes that multiply by a narrow matrix
in the tasks and add up in Spark, gives the latent space. Items and sliding windows
of the documents, at several lengths, are folded into that space; pairs of high cosine
are candidates if they share ``SHARED`` of those terms. Whatever its cosine, a window is a
candidate if it holds so many of an item's rarest words that ``ALIKE`` of the item can be
in it: a subsequence of that length leaves out a known number of the item's words, so of any
more of them some are in the window. No window that would stand is lost to the rank of the space
or to the cosine. A candidate stands if the longest common subsequence of words covers
``SAME`` of the item, or ``ALIKE`` of it and the item's answer is there as well: a
paraphrase. The answer is the column ``answer`` of the benchmark, or else the last
``ANSWER`` words of the item.

What the driver holds grows with the benchmark alone, which is taken in groups of
bounded size: a matrix of terms by ``WIDTH``. Terms in more than ``STOP`` of the
passages are left out of the vectors, but for the rarest ``RAREST`` of an item; items are
compared word by word with all of their words. Items longer than the longest window
are cut into overlapping passages, of which one is enough. Items of fewer than ``LEAST``
words are no evidence and are left out, as are null items and null texts. Rows with
repeated ids are judged by their own text."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticelake.llm import words as W
from noticelake.llm.common import slices, stored

BLOCK = 64
STRIDE = 8
SCALES = (24, 40, 64, 104)  # words of a window; an item of its length less a stride lies whole in one of them
RANK, WIDTH = 64, 72
STOP = 0.005
COSINE = 0.45
HITS = 4
SHARED = 2
SAME, ALIKE = 0.8, 0.6
ANSWER = 5
LEAST = 8
RAREST = 8
LISTED = 4  # at most LEAST words less the share that may be missing; more words listed, fewer chance candidates
GROUP_WORDS = 200_000


class Passage(NamedTuple):
    item: int
    terms: np.ndarray  # numbers of all its words, in order
    answer: np.ndarray
    scale: int


class Index(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes
    passages: list[Passage]


class Lists(NamedTuple):
    """The passages that each term stands for, by its rarity in them."""
    ends: np.ndarray  # term -> the end of its part of ``passages``
    passages: np.ndarray
    need: np.ndarray  # passage -> how many of its listed words a window must hold


class Match(NamedTuple):
    item: int
    ratio: float
    cosine: float
    start: int
    answered: bool


def _hashes(text: bytes | None) -> np.ndarray:
    buf = W.folded(text)
    return W.word_hashes(buf, *W.spans(buf), 4)


def index(items: list[tuple[int, str, str | None]]) -> Index:
    """Passages (item, text, answer) of one group of benchmark items."""
    found = [(item, _hashes(text.encode()), _hashes(answer.encode()) if answer else None) for item, text, answer in items]
    vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *[h for _, h, _ in found], *[a for *_, a in found if a is not None]]))
    passages, longest = [], SCALES[-1] - STRIDE
    for item, hashes, answer in found:
        numbers = np.searchsorted(vocabulary, hashes)
        for at in range(0, max(1, len(numbers) - longest + STRIDE), longest // 2):
            part = numbers[at:at + longest]
            if len(part) >= LEAST:
                tail = np.searchsorted(vocabulary, answer) if answer is not None and len(answer) else part[-ANSWER:]
                scale = next(i for i, s in enumerate(SCALES) if len(part) <= s - STRIDE)
                passages.append(Passage(item, part, tail, scale))
    return Index(vocabulary, passages)


def encoded(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(id, key, t) -> (id, key, n_words, at, terms): positions and numbers of known words."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = known.value
        for b in slices(batches):
            counts, places, terms = [], [], []
            for text in b.column(2).to_pylist():
                hashes = _hashes(text)
                numbers = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
                at = np.flatnonzero(names[numbers] == hashes)
                counts.append(len(hashes))
                places.append(at.astype(np.int32).tobytes())
                terms.append(numbers[at].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int32()), pa.array(places, pa.binary()),
                                              pa.array(terms, pa.binary())], names=["id", "key", "n_words", "at", "terms"])

    return docs.select("id", "key", "t").mapInArrow(run, "id long, key long, n_words int, at binary, terms binary")


def _hits(batch: pa.RecordBatch, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Positions and terms of a batch's documents on one axis, ``gap`` words apart and
    aligned to strides; where each document starts; the length of the axis."""
    at = [np.frombuffer(x, np.int32) for x in batch.column("at").to_pylist()]
    lengths = np.array(batch.column("n_words").to_pylist(), np.int64)
    room = -(-lengths // gap) * gap + gap
    starts = np.concatenate(([0], np.cumsum(room)))
    terms = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32)
    return np.concatenate([np.empty(0, np.int64), *[a + s for a, s in zip(at, starts)]]), terms, starts, int(starts[-1])


def frequencies(docs: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """In how many passages each term occurs, and the number of passages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, passages = np.zeros(n_terms, np.int64), 0
        for b in slices(batches, 1024):
            at, terms, _, _ = _hits(b, BLOCK)
            passages += sum(-(-n // BLOCK) for n in b.column("n_words").to_pylist())
            pairs = np.unique(at // BLOCK * n_terms + terms)
            counts += np.bincount(pairs % n_terms, minlength=n_terms)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], passages))], names=["term", "n"])

    rows = docs.select("n_words", "at", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(n_terms + 1, np.int64)
    for term, n in rows:
        found[term] = n
    return found[:-1], int(found[-1])


def _multiplied(docs: DataFrame, weights: np.ndarray, narrow: np.ndarray) -> np.ndarray:
    """A'(A M) for the matrix A of weighted, normalised passages and a narrow M."""
    n_terms, width = narrow.shape
    sent = docs.sparkSession.sparkContext.broadcast((weights, narrow.astype(np.float32)))
    names = [f"c{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, m = sent.value
        total = np.zeros((n_terms, width))
        for b in slices(batches, 512):
            at, terms, _, _ = _hits(b, BLOCK)
            use = weight[terms] > 0
            if not use.any():
                continue
            row, terms = at[use] // BLOCK, terms[use]
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
            x = weight[terms]
            x = x / np.sqrt(np.add.reduceat(x * x, first))[of]
            projected = np.add.reduceat(m[terms] * x[:, None], first, axis=0)
            order = np.argsort(terms, kind="stable")
            back = projected[of[order]] * x[order, None]
            sorted_terms = terms[order]
            starts = np.flatnonzero(np.concatenate(([True], sorted_terms[1:] != sorted_terms[:-1])))
            total[sorted_terms[starts]] += np.add.reduceat(back, starts, axis=0)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, i]) for i in range(width)]], names=["term", *names])

    parts = docs.select("n_words", "at", "terms").mapInArrow(run, "term long, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((n_terms, width))
    for row in parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).toLocalIterator():
        out[row[0]] = row[1:]
    return out


def latent(docs: DataFrame, weights: np.ndarray) -> np.ndarray:
    """The map that folds weighted terms into the latent space (terms by at most RANK):
    right singular vectors of the passages over their singular values, from a random
    range, orthonormalised, and a Rayleigh-Ritz step on its image."""
    rng = np.random.default_rng(5)
    width = min(WIDTH, len(weights))
    q, _ = np.linalg.qr(_multiplied(docs, weights, rng.normal(size=(len(weights), width))))
    image = _multiplied(docs, weights, q)
    values, vectors = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
    best = np.argsort(-values)[:RANK]
    best = best[values[best] > 1e-9 * max(values.max(initial=0), 1e-9)]
    return q @ vectors[:, best] / np.sqrt(values[best])


def weighting(found: Index, counts: np.ndarray, passages: int) -> np.ndarray:
    """Inverse document frequencies, zero for stop terms that are not among the
    ``RAREST`` of those of an item that occur at all."""
    idf = np.log((1 + passages) / (1 + counts))
    stop = counts > STOP * passages
    for p in found.passages:
        rarest = np.unique(p.terms)
        rarest = rarest[counts[rarest] > 0]
        stop[rarest[np.argsort(counts[rarest], kind="stable")[:RAREST]]] = False
    return np.where(stop, 0, np.maximum(idf, 0.01)).astype(np.float32)


def listing(found: Index, counts: np.ndarray, passages: int) -> Lists:
    """The rarest words of each passage: so many that ``LISTED`` of them are in any window
    that holds ``ALIKE`` of it, and all that are no stop terms."""
    terms, owners, need = [np.empty(0, np.int64)], [np.empty(0, np.int32)], []
    for number, p in enumerate(found.passages):
        some, times = np.unique(p.terms, return_counts=True)
        order = np.argsort(counts[some], kind="stable")
        some, upto = some[order], np.cumsum(times[order])
        spare = len(p.terms) - next(k for k in range(len(p.terms) + 1) if k / len(p.terms) >= ALIKE)
        size = max(int(np.searchsorted(upto, spare + LISTED)) + 1, int((counts[some] <= STOP * passages).sum()))
        terms.append(some[:size])
        owners.append(np.full(size, number, np.int32))
        need.append(int(upto[size - 1]) - spare)
    every = np.concatenate(terms)
    order = np.argsort(every, kind="stable")
    return Lists(np.cumsum(np.bincount(every, minlength=len(counts))), np.concatenate(owners)[order], np.array(need, np.int64))


def lexical(lists: Lists, lengths: np.ndarray, at: np.ndarray, terms: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(passage, document, first, last): windows of the passage's length that begin, in steps of
    a stride, from ``first`` to ``last``; every window with the needed words is among them."""
    ends = lists.ends[terms]
    n = ends - np.where(terms > 0, lists.ends[terms - 1], 0)
    place = np.repeat(ends - np.cumsum(n), n) + np.arange(n.sum())
    number, pos = lists.passages[place], np.repeat(at, n)
    order = np.argsort(number, kind="stable")
    number, pos = number[order], pos[order]
    other = np.arange(len(number)) + lists.need[number] - 1
    enough = np.flatnonzero(other < len(number))
    enough = enough[number[other[enough]] == number[enough]]
    last = pos[enough] // STRIDE * STRIDE
    first = -(-(pos[other[enough]] - lengths[number[enough]] + 1) // STRIDE) * STRIDE
    within = first <= last
    number, first, last = number[enough][within], np.maximum(first[within], 0), last[within]
    if len(number):
        doc = np.searchsorted(starts, pos[enough][within], side="right") - 1  # a window touches one document
        # Windows that follow each other are looked at together, a length of them at most.
        part = last // lengths[number]
        opens = np.flatnonzero(np.concatenate((
            [True], (number[1:] != number[:-1]) | (part[1:] != part[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + STRIDE))))
        closes = np.append(opens[1:], len(number)) - 1
        yield from zip(number[opens].tolist(), doc[opens].tolist(), first[opens].tolist(), last[closes].tolist())


def masks(item: np.ndarray) -> dict[int, int]:
    """Term -> the places of the item that have it, a bit each."""
    where: dict[int, int] = {}
    for i, term in enumerate(item.tolist()):
        where[term] = where.get(term, 0) | 1 << i
    return where


def subsequence(where: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item of ``size`` words."""
    state = full = (1 << size) - 1
    for term in words:
        if mask := where.get(term):
            common = state & mask
            state = (state + common) | (state - common)
    return size - (state & full).bit_count()


def _verified(p: Passage, where: dict[int, int], at: np.ndarray, terms: np.ndarray, low: int, high: int) -> tuple[float, int, bool]:
    """Overlap with the words from ``low`` to ``high``, the first of them, the answer check."""
    first, last = np.searchsorted(at, (low, high)).tolist()
    words = terms[first:last].tolist()
    ratio = subsequence(where, len(p.terms), words) / len(p.terms)
    if ratio < ALIKE:
        return ratio, low, False
    start = next(int(at[first + i]) for i, term in enumerate(words) if term in where)
    return ratio, start, subsequence(masks(p.answer), len(p.answer), words) >= SAME * len(p.answer)


def search(docs: DataFrame, found: Index, weights: np.ndarray, vectors: np.ndarray, lists: Lists) -> DataFrame:
    """(id, key, item_id, ratio, cosine, start, paraphrase) of the documents' matches."""
    folded = (vectors * weights[:, None]).astype(np.float32)
    items = np.stack([folded[p.terms].sum(0) for p in found.passages])
    items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-12)
    sent = docs.sparkSession.sparkContext.broadcast((found, weights, folded, items.astype(np.float32), lists))
    lengths = np.array([SCALES[p.scale] for p in found.passages], np.int64)
    names = ["id", "key", "item_id", "ratio", "cosine", "start", "paraphrase"]

    def matches(b: pa.RecordBatch, wheres: list, rares: list) -> Iterator[tuple]:
        index_, weight, space, goal, listed = sent.value
        if not wheres:
            wheres.extend(masks(p.terms) for p in index_.passages)
            rares.extend({t for t in p.terms.tolist() if weight[t] > 0} for p in index_.passages)
        gap = -(-SCALES[-1] // STRIDE) * STRIDE
        at, terms, starts, size = _hits(b, gap)
        use = weight[terms] > 0
        rare_at, rare_terms = at[use], terms[use]
        cell = rare_at // STRIDE
        sums = np.zeros((size // STRIDE + 1, space.shape[1]), np.float32)
        hits = np.zeros(len(sums), np.int64)
        if use.any():
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            sums[cell[first] + 1] = np.add.reduceat(space[rare_terms], first, axis=0)
            hits[1:] = np.bincount(cell, minlength=len(hits))[:len(hits) - 1]
        best: dict[tuple[int, int], Match] = {}

        def stands(number: int, doc: int, begin: int, end: int, cosine: float) -> bool:
            """Whether the words of a document from ``begin`` to ``end``, and a stride around, are a match; the best is kept."""
            p = index_.passages[number]
            ratio, start, answered = _verified(p, wheres[number], at, terms,
                                               max(begin - STRIDE, int(starts[doc])), min(end + STRIDE, int(starts[doc + 1])))
            if ratio < SAME and not (ratio >= ALIKE and answered):
                return False
            old = best.get((doc, p.item))
            if not old or ratio > old.ratio:
                best[doc, p.item] = Match(p.item, ratio, cosine, start - int(starts[doc]), answered)
            return True

        for scale, length in enumerate(SCALES):
            mine = [i for i, p in enumerate(index_.passages) if p.scale == scale]
            cells = length // STRIDE
            if not mine or len(sums) <= cells:
                continue
            total = np.cumsum(hits)
            some = np.flatnonzero(total[cells:] - total[:-cells] >= HITS)
            # Sums over the window's cells, added up cell by cell: exact zeros stay zeros.
            for low in range(0, len(some), 8192):
                part = some[low:low + 8192]
                window = sums[part + 1].copy()
                for k in range(2, cells + 1):
                    window += sums[part + k]
                window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-12)
                cosine = window @ goal[mine].T
                column, row = np.nonzero(cosine.T >= COSINE)
                begins = part[row]
                # Neighbouring windows that are close to one item are looked at together.
                touched = rare_at[np.searchsorted(rare_at, begins * STRIDE)]  # a window touches one document
                owner = np.searchsorted(starts, touched, side="right") - 1
                apart = (column[1:] != column[:-1]) | (owner[1:] != owner[:-1]) | (begins[1:] - begins[:-1] > 2)
                opens = np.flatnonzero(np.concatenate(([True], apart))) if len(row) else []
                for k, low_ in enumerate(opens):
                    high_ = opens[k + 1] if k + 1 < len(opens) else len(row)
                    number = mine[column[low_]]
                    begin, end = int(begins[low_]) * STRIDE, int(begins[high_ - 1]) * STRIDE + length
                    near = slice(*np.searchsorted(rare_at, (begin, end)).tolist())
                    if len(rares[number].intersection(rare_terms[near].tolist())) < SHARED:
                        continue
                    stands(number, int(owner[low_]), begin, end, float(cosine[row[low_:high_], column[low_]].max()))
        for number, doc, begin, last in lexical(listed, lengths, at, terms, starts):
            length = int(lengths[number])
            if _verified(index_.passages[number], wheres[number], at, terms, max(begin - STRIDE, int(starts[doc])),
                         min(last + length + STRIDE, int(starts[doc + 1])))[0] < ALIKE:
                continue
            for low in range(begin, last + 1, STRIDE):
                window = sums[low // STRIDE + 1:low // STRIDE + 1 + length // STRIDE].sum(0)
                cosine = float(window @ goal[number] / max(float(np.linalg.norm(window)), 1e-12))
                stands(number, doc, low, low + length, cosine)
        ids, keys = b.column("id").to_pylist(), b.column("key").to_pylist()
        for (doc, _), m in sorted(best.items()):
            yield ids[doc], keys[doc], m.item, m.ratio, m.cosine, m.start, m.ratio < SAME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.int64(), pa.bool_()]
        wheres, rares = [], []
        for b in slices(batches, 256):
            rows = list(matches(b, wheres, rares))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.mapInArrow(run, "id long, key long, item_id long, ratio double, cosine double, start long, paraphrase boolean")


def _groups(benchmark: DataFrame, item_id: str, text: str, answer: str) -> Iterator[list[tuple[int, str, str | None]]]:
    """The benchmark in groups of bounded size, one at a time in the driver."""
    chosen = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("t"),
                              (F.col(answer) if answer in benchmark.columns else F.lit(None)).cast("string").alias("a"))
    group, size = [], 0
    for row in chosen.where("item IS NOT NULL AND t IS NOT NULL").distinct().orderBy("item", "t", "a").toLocalIterator():
        group.append((row.item, row.t, row.a))
        size += len(row.t.split())
        if size >= GROUP_WORDS:
            yield group
            group, size = [], 0
    if group:
        yield group


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text", answer: str = "answer") -> DataFrame:
    """(id, key, item_id, ratio, cosine, start, paraphrase): one row per document text
    and benchmark item in it; ``key`` is the XXH64 of the text. ``start`` is the first
    common word."""
    t = F.col(text).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(t, F.lit(b""))).alias("key"), t.alias("t"))
    parts = []
    for group in _groups(benchmark, item_id, item_text, answer):
        found = index(group)
        if found.passages:
            known = stored(encoded(rows, found.vocabulary))
            counts, passages = frequencies(known, len(found.vocabulary))
            weights = weighting(found, counts, passages)
            parts.append(search(known, found, weights, latent(known, weights), listing(found, counts, passages)))
    if not parts:
        return rows.limit(0).selectExpr("id", "key", "0L item_id", "0D ratio", "0D cosine", "0L start", "false paraphrase")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, ratio, cosine, start, paraphrase), a row per document and item."""
    return matches(docs, benchmark, **how).withColumnRenamed("id", "doc_id").drop("key")


def drop(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold benchmark items, all columns."""
    found = stored(matches(docs, benchmark, doc_id, text, **how).select("id", "key").distinct())
    whole = docs.select(F.struct("*").alias("doc"), F.col(doc_id).cast("long").alias("id"),
                        F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("key"))
    clean = whole.alias("d").join(found.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.key") == F.col("f.key")), "left_anti")
    return clean.select("doc.*")
