"""Packing of tokenized documents into sequences by bin completion.

Documents are cut into pieces of at most ``capacity`` tokens; only longer documents
are cut, and then the first piece takes the remainder. How many pieces there are of
each length, at most ``capacity`` numbers whatever the corpus, decides the packing:
the search below runs over that histogram and returns patterns (the lengths that
share a sequence) with how often each is used. Every piece then finds its place
from its length and its rank among the pieces of that length. Ranks come from the
counts per task and length, so nothing is sorted or gathered.

Search: batched best-fit decreasing gives the first incumbent. If it does not meet
the lower bound, branch and bound over bin completions: the fillings around the
largest length that no other filling dominates, least waste first, each used as
often as the histogram allows; a branch is cut when its bins and the bound of what
is left reach the incumbent; best fit of what is left is tried as a new incumbent.
``nodes`` bounds the search, not the data.

Null texts are empty: one piece of the end token. Repeated rows and ids are packed
each; other columns are not read; an empty table gives an empty result."""

from __future__ import annotations

import base64
import bisect
import functools
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from noticelake.llm.common import slices, stored

CAPACITY = 2048
END = 0
#: Below this code point both tokenizer libraries split alike (tested for all of them).
PLAIN = 0x250
RUN = 1000


def default_tokenizer() -> tuple[str, str | None]:
    """Paths of the vocabulary and of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _full_tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def added_tokens(vocabulary: str) -> list[str]:
    """The strings that become one id wherever they stand in a text."""
    with open(vocabulary, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", [])]


@functools.cache
def tokenizer(vocabulary: str, ranks: str | None):
    """text -> uint32 ids, those of ``Tokenizer.encode(text, add_special_tokens=False)``. With
    ``ranks``, texts of plain characters without very long runs and without the string of
    an added token go through the faster library of the same vocabulary; ids are the same."""
    full = functools.partial(_full_tokenizer, vocabulary)  # loaded when a text needs it
    quick, added = None, added_tokens(vocabulary)
    if ranks:
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if quick and text and ord(max(text)) < PLAIN and not any(t in text for t in added):
            words = text.split()
            lengths = list(map(len, words))
            if max(lengths, default=0) < RUN and len(text) - sum(lengths) < len(words) + RUN:
                return np.array(quick.encode_ordinary(text), np.uint32)
        return np.array(full().encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth[, ids]); ``nth`` counts the
    earlier pieces of that length in the same task."""
    if vocabulary is None:
        vocabulary, ranks = default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids
    kind = "long" if docs.schema[doc_id].dataType.typeName() != "string" else "string"
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids
    types = [pa.int64() if kind == "long" else pa.string(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = tokenizer(vocabulary, ranks), Counter(), TaskContext.get().partitionId()
        for b in slices(batches):
            rows = []
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(body or ""), np.uint32(END)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[low:high]
                    row = (doc, k, low, high - low, zlib.crc32(part.tobytes()), task, seen[high - low])
                    seen[high - low] += 1
                    rows.append((*row, part.astype(np.int32)) if with_ids else row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col(doc_id).cast(kind).alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, schema)


Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing needs (the bound of Martello and Toth, over all of
    its parameters); ``counts[l]`` pieces have length l."""
    cap = len(counts) - 1
    sizes = np.arange(cap + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * sizes)
    best, half = -(-int(total[-1]) // cap), cap // 2
    large, large_total = n[cap] - n[half], total[cap] - total[half]
    for k in range(1, half + 1):
        over = n[cap] - n[cap - k]
        room = (large - over) * cap - (large_total - (total[cap] - total[cap - k]))
        small = total[half] - total[k - 1]
        best = max(best, int(large) + max(0, -(-int(small - room) // cap)))
    return best


def best_fit(counts: np.ndarray) -> Plan:
    """Best-fit decreasing over a histogram: pieces of one length are placed together."""
    cap = len(counts) - 1
    open_: dict[int, Counter] = {cap: Counter()}  # room -> patterns with that room
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        for room in sorted(r for r in open_ if size <= r < cap):
            group, k = open_[room], room // size
            while left and group:
                pattern, have = group.popitem()
                full = min(have, left // k)
                if full:
                    open_.setdefault(room - k * size, Counter())[pattern + (size,) * k] += full
                    left -= full * k
                if have > full:
                    if left and left < k:
                        open_.setdefault(room - left * size, Counter())[pattern + (size,) * left] += 1
                        left, have = 0, have - 1
                    if have > full:
                        group[pattern] = have - full
                        if not left:
                            break
            if not group:
                del open_[room]
            if not left:
                break
        if left:
            k = cap // size
            if left // k:
                open_.setdefault(cap - k * size, Counter())[(size,) * k] += left // k
            if left % k:
                open_.setdefault(cap - left % k * size, Counter())[(size,) * (left % k)] += 1
    return [(p, t) for group in open_.values() for p, t in group.items() if t]


def completions(counts: np.ndarray, largest: int, waste: int, most: int = 8, tries: int = 400) -> list[tuple[int, ...]]:
    """Undominated fillings of the room beside ``largest`` that waste at most
    ``waste``, least waste first: no piece left out could take the place of one or
    several in it and fit. ``tries`` bounds the enumeration, largest pieces first."""
    cap = len(counts) - 1
    rest = counts.copy()
    rest[largest] -= 1
    sizes = np.flatnonzero(rest[:cap - largest + 1]).tolist()
    found: list[tuple[int, ...]] = []
    left = tries

    def dominated(filling: tuple[int, ...], room: int) -> bool:
        sums = {0: 0}  # sum of a part of the filling -> the most pieces that make it
        for x in filling:
            for total, k in list(sums.items()):
                sums[total + x] = max(sums.get(total + x, 0), k + 1)
        used = Counter(filling)
        for total, k in sums.items():
            at = bisect.bisect_right(sizes, total + room) - 1
            while at >= 0 and sizes[at] >= total + (k < 2):
                if rest[sizes[at]] > used[sizes[at]]:
                    return True
                at -= 1
        return False

    def grow(filling: tuple[int, ...], room: int, at: int) -> None:
        nonlocal left
        left -= 1
        used = filling.count(sizes[at]) if at < len(sizes) and filling else 0
        at = min(at, bisect.bisect_right(sizes, room) - 1)
        ended = True
        while at >= 0 and left > 0 and len(found) < most:
            if rest[sizes[at]] > (used if filling and sizes[at] == filling[-1] else 0):
                ended = False
                grow((*filling, sizes[at]), room - sizes[at], at)
            at -= 1
        if ended and room <= waste and not dominated(filling, room):
            found.append(filling)

    grow((), cap - largest, len(sizes) - 1)
    return sorted(found, key=lambda f: (-sum(f), len(f)))


def plan(counts: np.ndarray, nodes: int = 1500) -> Plan:
    """Patterns and how often each is used, for the histogram ``counts``."""
    least = lower_bound(counts)
    best = best_fit(counts)
    fewest = sum(t for _, t in best)
    cap, sizes = len(counts) - 1, np.arange(len(counts))
    todo: list[tuple[np.ndarray, tuple, int]] = [(counts.copy(), (), 0)]  # what is left, its patterns as a chain, their bins
    while todo and nodes > 0 and fewest > least:
        left, chain, bins = todo.pop()
        nodes -= 1
        if not left.any() or bins + lower_bound(left) >= fewest:
            continue
        largest = int(np.flatnonzero(left)[-1])
        waste = (fewest - 1 - bins) * cap - int((left * sizes).sum())
        branches = []
        for at, filling in enumerate(completions(left, largest, waste)):
            need = Counter((largest, *filling))
            times = min(int(left[s]) // k for s, k in need.items())
            after = left.copy()
            for s, k in need.items():
                after[s] -= k * times
            branches.append((after, (((largest, *filling), times), chain), bins + times))
            if at == 0 and nodes % 16 == 0 or not after.any():
                rest = best_fit(after)
                total = bins + times + sum(t for _, t in rest)
                if total < fewest:
                    best, fewest, link = rest, total, branches[-1][1]
                    while link:
                        best, link = [*best, link[0]], link[1]
        todo += branches[::-1]
    return best


def pack(cut: DataFrame, capacity: int = CAPACITY, nodes: int = 1500) -> DataFrame:
    """Pieces (written or otherwise stable, from :func:`pieces`) with ``sequence_id``
    and ``offset`` in place of ``task`` and ``nth``."""
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used, first = Counter(), 0
    for pattern, times in plan(counts, nodes):
        at = 0
        for size, k in sorted(Counter(pattern).items(), reverse=True):
            slots.setdefault(size, []).append((used[size], k, first, at))
            used[size] += k * times
            at += k * size
        first += times
    table = {size: np.array(rows, np.int64) for size, rows in slots.items()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = cut.join(earlier, ["length", "task"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    fields = [f for f in cut.columns if f not in ("task", "nth")]
    schema = cut.select(*fields, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, ranks = b.column("length").to_numpy(), b.column(b.num_columns - 1).to_numpy()
            sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                mine, rows = sizes == size, table[size]
                start, k, base, at = rows[np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1].T
                sequence[mine] = base + (ranks[mine] - start) // k
                offset[mine] = at + (ranks[mine] - start) % k * size
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.select(*fields, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False,
                   nodes: int = 1500) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    return pack(stored(pieces(docs, doc_id, text, capacity, vocabulary, ranks, with_ids)), capacity, nodes)


def sequences(packed: DataFrame) -> DataFrame:
    """Pieces with ids -> (sequence_id, ids); a sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
