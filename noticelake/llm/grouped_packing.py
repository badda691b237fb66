"""Packing by first-fit decreasing in randomised groups of documents.

Rows are dealt to tasks by a hash of id and text and sorted by it, so every task reads
its documents in a random order that is the same each time. A task tokenizes them and
closes a group when ``GROUP`` documents are together; groups know nothing of each other,
so the work is one shuffle of texts and any number of tasks.

In a group, full sequences are cut off each document as it is read. What remains of the documents is placed by
first-fit decreasing: a tournament tree over the room of the bins, every inner node
holding the larger room below it, leads to the first bin with enough room in log(bins)
steps. The gaps are then closed by cutting: as many of the fullest bins as the group's
tokens can fill take the pieces of the others, in order, cut where a gap ends.
What is left then, less than one sequence, goes into sequences whose lengths are the
powers of two of its sum, so that none of them is padded. With ``close_gaps=False`` only
first fit places pieces, and bins keep their gaps.

A null text is empty: the end token alone. Null ids, repeated ids and equal rows are packed
each; further columns are not read; an empty table gives an empty result. A very long
text is tokenized whole, its full sequences leave the task as they are made, and only its last piece
waits for the group."""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from noticelake.llm.common import slices

CAPACITY = 2048
END = 1
GROUP = 4096
#: After so many words, and parts of words, a worker begins a new table.
WORDS, PARTS = 400_000, 300_000
#: Words of these characters, or of ASCII without the mark of an added token, are lower-cased
#: and split by ``_PARTS`` as the tokenizer does; all others go through it whole.
_PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """Byte value -> the letter that stands for it in a byte-level vocabulary: itself if
    it is a visible Latin-1 character, else the next free one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(seen)))}


class WordTokenizer:
    """Token ids of whole texts for a vocabulary that drops white space, by word.

    Its tokens never cross ASCII white space, so the ids of a text are those of its
    words in order; most words occur again, and their ids are kept as little-endian
    bytes in tables for words and for their lower-case parts. A full table becomes the
    old one, from which words that occur again are taken over, and an empty one begins."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocabulary)
        self.model, self.letters = self.full.model, _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return np.array(self.full.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part) or self.old_parts.get(part)
        if not ids:
            found = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
            ids = struct.pack(f"<{len(found)}I", *found)
        self.parts[part] = ids
        return ids

    def learn(self, texts: list[list[bytes]]) -> None:
        """Remembers all words of some texts."""
        if len(self.words) > WORDS:
            self.old_words, self.words = self.words, {}
        if len(self.parts) > PARTS:
            self.old_parts, self.parts = self.parts, {}
        words, old, parts = self.words, self.old_words, self.parts
        for word in set().union(*texts).difference(words):
            ids = old.get(word)
            if ids is None:
                body = word.decode("utf-8", "replace")
                if "<" not in body if body.isascii() else _PLAIN.fullmatch(body):
                    ids = b"".join([parts.get(p) or self._part(p) for p in _PARTS.findall(body.lower())])
                else:
                    ids = self._whole(body)
            words[word] = ids

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, four bytes each."""
        split = [t.split() for t in texts]
        self.learn(split)
        for words in split:
            yield b"".join(map(self.words.__getitem__, words))


@functools.cache
def tokenizer(vocabulary: str) -> WordTokenizer:
    return WordTokenizer(vocabulary)


class Tournament:
    """Rooms of bins; ``first(size)`` is the first bin with that much room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        return at - self.leaves

    def take(self, bin_: int, size: int) -> None:
        room, at = self.room, bin_ + self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            most = room[2 * at] if room[2 * at] > room[2 * at + 1] else room[2 * at + 1]
            if room[at] == most:
                break
            room[at] = most


def first_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """First-fit decreasing: the places in ``lengths`` that each bin holds."""
    tree = Tournament(max(1, len(lengths)), capacity)
    bins: list[list[int]] = []
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bin_ = tree.first(lengths[at])
        tree.take(bin_, lengths[at])
        if bin_ == len(bins):
            bins.append([])
        bins[bin_].append(at)
    return bins


def fill_gaps(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of parts (place, start in it, length) without a gap: the emptier bins
    are cut up to fill the fuller ones, and the last tokens make powers of two."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    full, rest = divmod(sum(fill), capacity)
    out = [[(i, 0, lengths[i]) for i in bins[b]] for b in order[:full]]
    wanted = [(s, capacity - fill[b]) for s, b in enumerate(order[:full]) if fill[b] < capacity]
    for power in range(rest.bit_length() - 1, -1, -1):
        if rest >> power & 1:
            wanted.append((len(out), 1 << power))
            out.append([])
    pieces = [i for b in order[full:] for i in bins[b]]
    at = used = 0
    for s, room in wanted:
        while room:
            part = min(room, lengths[pieces[at]] - used)
            out[s].append((pieces[at], used, part))
            used, room = used + part, room - part
            if used == lengths[pieces[at]]:
                at, used = at + 1, 0
    return out


def pack_group(lengths: list[int], capacity: int = CAPACITY, close_gaps: bool = True) -> list[list[tuple[int, int, int]]]:
    bins = first_fit(lengths, capacity)
    return fill_gaps(bins, lengths, capacity) if close_gaps else [[(i, 0, lengths[i]) for i in b] for b in bins]


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   vocabulary: str | None = None, group: int = GROUP, close_gaps: bool = True,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset[, ids]). ``group`` bounds the documents of a group and so a task's memory."""
    vocabulary = vocabulary or default_tokenizer()
    kind = "long" if docs.schema[doc_id].dataType.typeName() != "string" else "string"
    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + ", ids array<int>" * with_ids)
    types = [pa.int64() if kind == "long" else pa.string(), *[pa.int64()] * 6, pa.list_(pa.int32())][:7 + with_ids]
    names = [f.split()[0] for f in schema.split(", ")]
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = tokenizer(vocabulary).encode, TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []  # (doc, start, ids, tokens of the document)
        rows: list[tuple] = []

        def row(doc, start: int, ids: bytes, tokens: int, sequence_id: int, offset: int) -> None:
            out = (doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence_id, offset)
            rows.append((*out, np.frombuffer(ids, "<i4")) if with_ids else out)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            rows.clear()
            return out

        def place() -> None:
            nonlocal sequence
            for parts in pack_group([len(w[2]) // 4 for w in waiting], capacity, close_gaps):
                offset = 0
                for i, low, length in parts:
                    doc, start, ids, tokens = waiting[i]
                    row(doc, start + low, ids[4 * low:4 * (low + length)], tokens, sequence, offset)
                    offset += length
                sequence += 1
            waiting.clear()

        for b in slices(batches, 128):
            for doc, ids in zip(b.column(0).to_pylist(), encode([t or b"" for t in b.column(1).to_pylist()])):
                ids += end
                tokens = len(ids) // 4
                whole = tokens - tokens % capacity
                for low in range(0, whole, capacity):
                    row(doc, low, ids[4 * low:4 * (low + capacity)], tokens, sequence, 0)
                    sequence += 1
                if whole < tokens:
                    waiting.append((doc, whole, ids[4 * whole:], tokens))
                if len(waiting) >= group:
                    place()
                if len(rows) >= 20_000:
                    yield flush()
        place()
        if rows:
            yield flush()

    rows = docs.select(F.col(doc_id).cast(kind).alias("doc_id"), F.col(text).cast("binary").alias("t"))
    rows = rows.withColumn("deal", F.xxhash64("doc_id", "t"))
    return rows.repartition("deal").sortWithinPartitions("deal", "doc_id").select("doc_id", "t").mapInArrow(run, schema)


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequences, tokens, padding) of packed pieces: a sequence is padded to the capacity
    unless its length is a power of two."""
    length = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"))
    pad = F.when(F.bit_count("length") == 1, 0).otherwise(capacity - F.col("length"))
    return length.agg(F.count(F.lit(1)).alias("sequences"), F.sum("length").alias("tokens"), F.sum(pad).alias("padding"))
