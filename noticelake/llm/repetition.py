"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths mark the words that lie in an
n-gram found twice or more in the text; coverage is the share of the text's word
characters in such words. Lines count that equal an earlier line. A text is kept
when it has enough words, its 8-word windows repeat little, and no coverage passes
its limit. Limits are whole per cents, so that verdicts are exact.

A null text has no words and fails. Rows are judged one by one: repeated rows, ids
and other columns do not matter, an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticelake.llm import words as W
from noticelake.llm.common import slices

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


class Rules(NamedTuple):
    """Limits in per cent. ``covered``: by n-gram length; ``lines``: characters in
    lines that equal an earlier line; ``symbols``: symbols to words."""

    least_words: int = 20
    repeat_size: int = 8
    repeat_words: int = 30
    covered: tuple[tuple[int, int], ...] = ((3, 55), (5, 45), (12, 40))
    lines: int = 30
    symbols: int = 50


def names(rules: Rules) -> list[str]:
    return ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
            *[f"dup_chars_{n}" for n, _ in rules.covered]]


def measure(text: bytes | None, rules: Rules = Rules()) -> list[int]:
    """The counts of :func:`names` for one UTF-8 text; characters are code points."""
    buf = np.frombuffer(text or b"", np.uint8)
    starts, ends = W.spans(buf)
    n = len(starts)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    of_word = chars[ends] - chars[starts]
    hashes = W.word_hashes(buf, starts, ends)

    def repeats(size: int) -> np.ndarray:
        return W.covered(W.repeated(W.window_hashes(hashes, size)), size, n)

    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in (text or b"").split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += int(((np.frombuffer(b"".join(line.split()), np.uint8) & 0xC0) != 0x80).sum())
        elif line.strip(b" \t\n\v\f\r"):
            seen.add(line)
    return [n, int(of_word.sum()), int(SYMBOLS[buf].sum()), dup_lines, int(repeats(rules.repeat_size).sum()),
            dup_line_chars, *[int(of_word[repeats(size)].sum()) for size, _ in rules.covered]]


def measured(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with one struct column ``rules`` of counts and the verdicts
    ``base_failed`` and ``kept``; a column of that name is replaced."""
    found = names(rules)
    plain = docs.drop("rules").withColumn("rules", F.struct(*[F.lit(0).cast("long").alias(c) for c in found])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [measure(t, rules) for t in b.column(b.num_columns - 1).to_pylist()]
            counts = np.array(rows, np.int64).reshape(len(rows), len(found))
            struct = pa.StructArray.from_arrays([pa.array(counts[:, i]) for i in range(len(found))], names=found)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], struct], names=plain.names)

    counted = docs.drop("rules").withColumn("rules", F.col(text).cast("binary")).mapInArrow(run, plain)

    def r(name: str):
        return F.col("rules")[name]

    base = (r("n_words") < rules.least_words) | (100 * r("n_repeat_words") > rules.repeat_words * r("n_words"))
    worse = (100 * r("dup_line_chars") > rules.lines * r("word_chars")) | (100 * r("n_symbols") > rules.symbols * r("n_words"))
    for size, limit in rules.covered:
        worse = worse | (100 * r(f"dup_chars_{size}") > limit * r("word_chars"))
    return counted.withColumn("rules", F.col("rules").withField("base_failed", base).withField("kept", ~(base | worse)))


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, counts, base_failed, kept) per row."""
    return measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), "t", rules).select("doc_id", "rules.*")


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns."""
    whole = docs.select(F.struct("*").alias("doc"), F.col(text).alias("t"))
    return measured(whole, "t", rules).where("rules.kept").select("doc.*")


def sql(rules: Rules = Rules()) -> str:
    sizes = sorted({rules.repeat_size, *[n for n, _ in rules.covered]})
    windows = ", ".join(f"CASE WHEN i + {n - 1} <= len(ws) THEN array_to_string(ws[i:i + {n - 1}], ' ') END AS g{n}" for n in sizes)
    counted = ", ".join(f"CASE WHEN g{n} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{n}) > 1 THEN 1 ELSE 0 END AS c{n}" for n in sizes)
    spread = ", ".join(f"max(c{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS x{n}" for n in sizes)
    dups = ", ".join(f"coalesce(sum(CASE WHEN x{n} = 1 THEN length(word) END), 0)::BIGINT AS dup_chars_{n}" for n, _ in rules.covered)
    worse = " OR ".join([f"100 * dup_line_chars > {rules.lines} * word_chars", f"100 * n_symbols > {rules.symbols} * n_words",
                         *[f"100 * dup_chars_{n} > {limit} * word_chars" for n, limit in rules.covered]])
    lists = ", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n, _ in rules.covered)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT r, i, ws[i] AS word, {windows} FROM w),
c AS (SELECT r, i, word, {counted} FROM g),
x AS (SELECT r, i, word, {spread} FROM c),
n AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars,
    sum(x{rules.repeat_size})::BIGINT AS n_repeat_words, {dups} FROM x GROUP BY r),
p AS (SELECT r, string_split(t, chr(10)) AS ls FROM d),
l AS (SELECT r, ls[j] AS line, j FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS j FROM p)),
q AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY j) AS k FROM l
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
e AS (SELECT r, count(*) AS n_dup_lines,
    sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')))::BIGINT AS dup_line_chars FROM q WHERE k > 1 GROUP BY r),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {lists}
  FROM d LEFT JOIN n USING (r) LEFT JOIN e USING (r)),
b AS (SELECT *, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.repeat_words} * n_words AS base_failed FROM a)
SELECT *, NOT (base_failed OR {worse}) AS kept FROM b"""
