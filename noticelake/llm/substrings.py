"""Exact removal of token windows that an earlier document has as well.

A window is ``window`` consecutive words. A word goes when it lies in a window whose
word sequence also starts in a document with a smaller id. Windows are known by two
Rabin-Karp hashes (128 bits); Spark counts them, and covered windows merge into
maximal intervals.

Two lossless steps keep most windows out of the count. Texts with the same SHA-256 of
their words are the same windows, so all but those of the least id are removed whole.
And every window has an anchor, the least hash of the ``anchor_words``-word shingles in
it: equal windows have equal anchors, so a window whose anchor no other document has
is unique. Only windows under shared anchors are counted; those under anchors of many
documents are salted by document and counted in two steps.

Null texts have no words. Rows with a null id have no order: they neither cause nor
suffer a removal. Rows that share an id do not remove from each other. Repeated rows
are all kept and treated alike; columns other than id and text are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticelake.llm import words as W
from noticelake.llm.common import slices, stored

WINDOW = 50
ANCHOR_WORDS = 8
#: From this many documents on, the windows under an anchor are salted.
HOT = 2000
SALTS = 64
KEY = "id long, key long"


def _buffer(text: bytes | None) -> np.ndarray:
    return np.frombuffer(text or b"", np.uint8)


def _anchors(words: np.ndarray, window: int, anchor_words: int) -> np.ndarray:
    """The anchor of each window."""
    shingles = W.window_hashes(words, anchor_words, 2)
    return W.sliding_min(shingles, window - anchor_words + 1)


def _scan(docs: DataFrame, window: int, anchor_words: int) -> DataFrame:
    """(id, key, n_words, words_sha, anchors) of each row of (id, key, t)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_words, digests, anchors = [], [], []
            for text in b.column(2).to_pylist():
                buf = _buffer(text)
                starts, ends = W.spans(buf)
                n_words.append(len(starts))
                digests.append(hashlib.sha256(b" ".join((text or b"").split())).digest())
                found = np.empty(0, np.uint64)
                if len(starts) >= window:
                    found = np.unique(_anchors(W.word_hashes(buf, starts, ends), window, anchor_words))
                anchors.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(anchors, pa.list_(pa.int64()))], names=["id", "key", "n_words", "words_sha", "anchors"])

    return docs.mapInArrow(run, f"{KEY}, n_words long, words_sha binary, anchors array<long>")


def _windows(docs: DataFrame, window: int, anchor_words: int) -> DataFrame:
    """(h1, h2, id, key, start, salt) of the windows whose anchor is listed, of (id, key,
    t, shared: anchors, hot: those of them in many documents). Windows under hot anchors
    are salted, others have salt -1."""
    names = ["h1", "h2", "id", "key", "start", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            for doc, key, text, shared, hot in zip(*(c.to_pylist() for c in b.columns)):
                buf = _buffer(text)
                starts, ends = W.spans(buf)
                words = W.word_hashes(buf, starts, ends)
                anchors = _anchors(words, window, anchor_words)
                at = np.flatnonzero(np.isin(anchors, np.array(shared, np.int64).view(np.uint64)))
                often = np.isin(anchors[at], np.array(hot, np.int64).view(np.uint64))
                first = W.window_hashes(words, window, 0)[at].view(np.int64)
                second = W.window_hashes(W.word_hashes(buf, starts, ends, 1), window, 1)[at].view(np.int64)
                salt = np.where(often, doc % SALTS, -1).astype(np.int32)
                for i in range(0, len(at), 65536):
                    part = slice(i, i + 65536)
                    n = len(at[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(first[part]), pa.array(second[part]), pa.array(np.full(n, doc, np.int64)),
                         pa.array(np.full(n, key, np.int64)), pa.array(at[part].astype(np.int32)), pa.array(salt[part])], names=names)

    return docs.mapInArrow(run, f"h1 long, h2 long, {KEY}, start int, salt int")


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
             anchor_words: int = ANCHOR_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is to be removed, as written tables: each row of ``docs`` as (id, key,
    n_words, words_sha), where ``key`` tells texts of one id apart; the (id, key) of
    which all goes; and the others that lose words as (id, key, t: text, spans: array
    of [first, last + 1] word numbers, ordered and apart from each other)."""
    if not 0 < anchor_words <= window:
        raise ValueError("an anchor lies within the window")
    rows = keyed(docs, doc_id, text)
    seen = stored(_scan(rows, window, anchor_words))
    whole = seen.where(f"id IS NOT NULL AND n_words >= {window}")
    least, most = F.min("id").alias("least"), F.max("id").alias("most")
    full = whole.groupBy("words_sha").agg(least, most).where("least < most").drop("most")
    copies = stored(whole.select("id", "key", "words_sha").join(full, "words_sha").where("id > least").select("id", "key").distinct())
    under = whole.join(copies, ["id", "key"], "left_anti").select("id", "key", F.explode("anchors").alias("anchor"))
    shared = (under.groupBy("anchor").agg(least, most, F.count(F.lit(1)).alias("n")).where("least < most")
              .select("anchor", (F.col("n") > HOT).alias("hot")))
    affected = under.join(shared, "anchor").groupBy("id", "key").agg(
        F.collect_set("anchor").alias("shared"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    texts = stored(rows.join(affected, ["id", "key"]).select("id", "key", "t", "shared", "hot").dropDuplicates(["id", "key"]))
    # Hashed once; a window of many documents is counted per salt, and meets its rows per salt again.
    windows = stored(_windows(texts, window, anchor_words))
    counts = windows.groupBy("h1", "h2", "salt").agg(least, most)
    cold = counts.where("salt < 0 AND least < most").drop("most")
    often = (counts.where("salt >= 0").groupBy("h1", "h2").agg(F.min("least").alias("least"), F.max("most").alias("most"))
             .where("least < most").drop("most"))
    hot = often.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "least")
    hits = windows.join(cold.union(hot), ["h1", "h2", "salt"]).where("id > least").select("id", "key", "start")
    spans = hits.groupBy("id", "key").agg(F.array_sort(F.collect_set("start")).alias("starts")).select(
        "id", "key", merged(F.col("starts"), window).alias("spans"))
    return seen.drop("anchors"), copies, texts.select("id", "key", "t").join(spans, ["id", "key"])


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, key, t): the text as bytes, and a hash that tells texts of one id apart."""
    t = F.col(text).cast("binary")
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(t, F.lit(b""))).alias("key"), t.alias("t"))


def merged(starts, window: int):
    """Ordered window starts -> maximal intervals [first, last + 1]."""
    opens = F.filter(starts, lambda x, i: (i == 0) | (x - F.get(starts, i - 1) > window))
    closes = F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) - x > window))
    return F.transform(F.arrays_zip(opens.alias("a"), closes.alias("b")), lambda z: F.array(z["a"], z["b"] + window))


def remove(texts: DataFrame) -> DataFrame:
    """(id, key, t, spans) -> (id, key, n_removed, kept): the words that stay, joined by
    one blank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            removed, kept = [], []
            for body, cut in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = (body or b"").split()
                out, at = [], 0
                for first, end in cut:
                    out += words[at:first]
                    at = end
                out += words[at:]
                removed.append(len(words) - len(out))
                kept.append(b" ".join(out))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["id", "key", "n_removed", "kept"])

    return texts.select("id", "key", "t", "spans").mapInArrow(run, f"{KEY}, n_removed long, kept binary")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_words, n_removed, kept_sha256)."""
    rows, copies, texts = removals(docs, doc_id, text, **how)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    changed = remove(texts).select("id", "key", "n_removed", F.sha2("kept", 256).alias("kept_sha")).union(
        copies.select("id", "key", F.lit(None).cast("long"), none))
    return rows.join(changed, ["id", "key"], "left").select(
        F.col("id").alias("doc_id"), "n_words",
        F.when(F.col("kept_sha").isNull(), 0).otherwise(F.coalesce("n_removed", "n_words")).alias("n_removed"),
        F.coalesce("kept_sha", F.lower(F.hex("words_sha"))).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
s AS (SELECT r, doc_id, ws[i] AS word, i,
    CASE WHEN i + 49 <= len(ws) THEN array_to_string(ws[i:i + 49], ' ') END AS win FROM w),
m AS (SELECT win, min(doc_id) AS least FROM s WHERE win IS NOT NULL GROUP BY win),
h AS (SELECT s.*, coalesce(max(CASE WHEN m.least < s.doc_id THEN 1 ELSE 0 END) OVER
    (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM s LEFT JOIN m USING (win)),
k AS (SELECT r, count(*) AS n_words, sum(gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM h GROUP BY r)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""
