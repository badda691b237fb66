"""Near-duplicates by SimHash: pigeonhole blocks, join on blocks, Hamming check.

A fingerprint bit is set when more than half of the XXH64 hashes (seed 42) of the
text's word shingles have it set. Words are taken after A-Z are lower-cased; a text
with fewer words than a shingle is one shingle, a text without words (also a null
text) has fingerprint zero and is linked like any other.

Two fingerprints within ``distance`` bits agree in all but ``distance`` of
``blocks`` blocks of bits, so they meet under the key of some choice of blocks.
Keys with few fingerprints are joined and checked. Keys with many are settled
exactly without pairs: every fingerprint is listed under itself and its 64 one-bit
neighbours; two fingerprints differ in at most two bits just when they meet there,
and no meeting has more than 65 guests."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from noticelake.llm.common import slices, stored
from noticelake.llm.components import components

SEED = 42
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    n = len(words) - size + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        part = words[at:min(at + CHUNK, n) + size - 1]
        joined = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:len(part) - size + 1].tolist()
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """``docs`` with a long column of fingerprints (as two's complement)."""
    schema = docs.drop(name).withColumn(name, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(b.num_columns - 1).to_pylist()
            prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints)], names=schema.names)

    return docs.drop(name).withColumn(name, F.col(text).cast("binary")).mapInArrow(run, schema)


def links(prints: DataFrame, distance: int = 2, blocks: int = 4, crowd: int = 16) -> DataFrame:
    """Distinct fingerprints (fp: long) -> links (a, b) whose closure joins exactly
    the pairs that differ in at most ``distance`` (1 or 2) bits."""
    if not 1 <= distance <= 2 or blocks <= distance:
        raise ValueError("distance is 1 or 2, and blocks are more")
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(x, y)) for x, y in itertools.pairwise(bounds)]
    masks = [sum(c) for c in itertools.combinations(block, blocks - distance)]
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(_long(m)).alias("key"))
                     for i, m in enumerate(masks)])
    listed = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.i", "k.key")
    sizes = listed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(listed.join(sizes, ["i", "key"]))
    few = met.where(F.col("n") <= crowd).drop("n")
    other = few.withColumnRenamed("fp", "other")
    pairs = few.join(other, ["i", "key"]).where(
        (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance))
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(_long(1 << b)) for b in range(64)])
    guests = (met.where(F.col("n") > crowd).select("fp").distinct()
              .select("fp", F.explode(near).alias("key"))
              .groupBy("key").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1))
    if distance == 2:
        star = guests.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b")
    else:
        star = (guests.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b"))
                .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)))
    return pairs.select(F.col("fp").alias("a"), F.col("other").alias("b")).union(star)


def classes(rows: DataFrame, distance: int = 2, blocks: int = 4, crowd: int = 16) -> DataFrame:
    """Rows (id, fp) -> (fp, class: long, component_id): the least id reachable over links.

    Null ids are left out of the least; a class of null ids only has a null id."""
    prints = stored(rows.groupBy("fp").agg(F.min("id").alias("first")))
    root = components(links(prints.select("fp"), distance, blocks, crowd))
    labelled = prints.join(root.withColumnRenamed("node", "fp"), "fp", "left")
    least = labelled.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"))
    return labelled.join(least, "root", "left").select(
        "fp", F.coalesce("root", "fp").alias("class"),
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    distance: int = 2, blocks: int = 4) -> DataFrame:
    """One row per row of ``docs``: (doc_id, fingerprint hex, component_id).

    Repeated rows and ids are kept, an empty table gives an empty result, other
    columns are not read."""
    rows = stored(with_fingerprint(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")), "t", "fp", shingle)
                  .select("id", "fp"))
    return rows.join(classes(rows, distance, blocks), "fp").select(
        F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents of ``docs``, all columns, one of each class of near-duplicates:
    the row with the least id (null last), of equal ids the one with the least hash
    of its columns; of fully equal rows one stays."""
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") if kind.startswith("map") else F.col(f"`{c}`")
                       for c, kind in docs.dtypes])
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), row.alias("row"))
    rows = stored(with_fingerprint(narrow, "t", "fp", how.pop("shingle", 3)).select("id", "row", "fp"))
    low = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    of = classes(rows, **how)
    best = rows.join(of, "fp").groupBy("class").agg(F.min(low).alias("low")).select("low.id", "low.row")
    copies = rows.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n"))
    chosen = stored(best.alias("b").join(copies.alias("c"), F.col("b.id").eqNullSafe(F.col("c.id"))
                    & (F.col("b.row") == F.col("c.row"))).select("b.id", "b.row", "n"))
    keyed = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("id"), row.alias("row"))

    def kept(some: DataFrame) -> DataFrame:
        return keyed.alias("d").join(some.alias("k"), F.col("d.id").eqNullSafe(F.col("k.id"))
                                     & (F.col("d.row") == F.col("k.row")), "left_semi")

    once, often = kept(chosen.where("n = 1")), kept(chosen.where("n > 1"))
    one = often.groupBy("id", "row").agg(F.first("doc").alias("doc"))
    return once.select("doc.*").union(one.select("doc.*"))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _long(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >= 1 << 63 else bits).cast("long")


def reachable(prints: list[int], distance: int = 2) -> list[set[int]]:
    """Brute force for tests: the sets of positions linked over close fingerprints."""
    groups = [{i} for i in range(len(prints))]
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance and groups[i] is not groups[j]:
            joined = reduce(set.union, (groups[i], groups[j]))
            for k in joined:
                groups[k] = joined
    return groups
