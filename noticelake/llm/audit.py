"""How filters interact: what each removes, alone and after the others.

Every filter has a table of the ids that fail it, written once. A left-semi and a
left-anti join with each table in turn lead every row to the set of filters it fails;
all of these joins are on the row's key, so the rows and a table are shuffled once for
all joins of a plan. Rows of a set are counted per part before anything else is moved,
and a set that meets no filter of a prefix survives it: survivors, removals, redundant
failures and label losses of all prefixes follow from at most 2**filters counts per part.

Rows: a null text is empty, a null source the part ''. Rows of an equal id are rows of
their own; the key is the id with the text's digest, so an id may stand for several
texts. A null id is no later copy of anything and has no label. Of several label rows
of an id, one is enough. Very long texts are read whole, other columns are not read, and an
empty table has no part and gives no row."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from noticelake.llm.common import stored

SPACES = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"
COPIES = "E"


def conditions(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that look at one text and its words."""
    size = F.size(words)
    return {
        "A": size < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * size,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike(MARKS),
    }


def _key(doc_id: Column, digest: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", doc_id.cast("string"), digest)))


def facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, doc_id, part, digest, fails): a row per document, its text read once and
    left behind; ``fails`` lists the conditions on the text that it meets."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("*", F.array_remove(F.split("t", SPACES), "").alias("w"))
    failed = F.array(*[F.when(c, F.lit(f)) for f, c in conditions(F.col("t"), F.col("w")).items()])
    rows = rows.select("doc_id", "part", F.sha2("t", 256).alias("digest"), F.array_compact(failed).alias("fails"))
    return rows.select(_key(F.col("doc_id"), F.col("digest")).alias("key"), "*")


def failing_ids(rows: DataFrame) -> dict[str, DataFrame]:
    """A stored table of keys per filter, from written ``facts``. A copy is a row that is
    not the first of its text, so copies are what a left-anti join with the firsts
    leaves; its key holds the id, and a text that a third of the rows share stays spread."""
    own = rows.select("key", F.explode("fails").alias("filter"))
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    first = first.select(_key(F.col("first"), F.col("digest")).alias("key"))
    copies = rows.where("doc_id is not null").select("key").join(first, "key", "left_anti")
    tables = stored(own.unionByName(copies.select("key", F.lit(COPIES).alias("filter"))), "filter")
    return {f: tables.where(F.col("filter") == f).select("key") for f in "ABCDE"}


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows with ``good`` and ``toxic`` as 0 or 1."""
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    kept = rows.select("key", "doc_id", "part").join(marks, "doc_id", "left")
    return kept.select("key", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def classes(rows: DataFrame, failing: dict[str, DataFrame], at_once: int = 2) -> DataFrame:
    """(part, mask, n, good, toxic): rows (key, part, good, toxic) counted by the set of
    filters they fail, bit k for the k-th filter. Rows that fail a filter are the
    left-semi join with its table, rows that pass it the left-anti join; after
    ``at_once`` filters the halves are written, so that rows are read 2**at_once times."""
    rows, tables = rows.withColumn("mask", F.lit(0)), list(failing.values())
    for start in range(0, len(tables), at_once):
        rows = rows if start == 0 else stored(rows)
        split = [rows]
        for bit, table in enumerate(tables[start:start + at_once], start):
            split = [half for rel in split for half in (
                rel.join(table, "key", "left_semi").withColumn("mask", F.col("mask") + (1 << bit)),
                rel.join(table, "key", "left_anti"))]
        rows = functools.reduce(DataFrame.unionByName, split)
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def steps(counts: DataFrame, filters: str) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of ``classes``."""
    k = len(filters)
    pairs = [(p, 1 << b) for p in range(1 << k) for b in range(k) if not p >> b & 1]
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(b).alias("bit")) for p, b in pairs]))
    each = counts.select("*", at.alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    here = (F.col("mask").bitwiseAND(F.col("prefix")) == 0)
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0))

    each = each.groupBy("part", "prefix", "bit").agg(
        total(here & ~fails).alias("kept"), total(here & fails).alias("removed"), total(fails & ~here).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here & fails, "good").alias("good_lost"), total(here & fails, "toxic").alias("toxic_lost"))
    # A prefix of s filters precedes its step in s! (k - s - 1)! of the orders.
    orders_of = F.element_at(F.array(*[F.lit(math.factorial(s) * math.factorial(k - s - 1)) for s in range(k)]),
                             F.bit_count("prefix") + 1)
    share = each.groupBy("part", "bit").agg(F.sum(F.col("removed") * orders_of).alias("shapley"))
    plan = []
    for order in itertools.permutations(range(k)):
        for s, b in enumerate(order):
            plan.append(("".join(filters[x] for x in order), s + 1, sum(1 << x for x in order[:s]), 1 << b))
    orders = counts.sparkSession.createDataFrame(plan, "filter_order string, step int, prefix int, bit int")
    # ``orders`` has k * k! rows, 600 for five filters.
    return each.join(share, ["part", "bit"]).join(F.broadcast(orders), ["prefix", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole documents, in all orders, per source."""
    rows = stored(facts(docs))
    failing = failing_ids(rows)
    return steps(stored(classes(labelled(rows, labels), failing)), "".join(failing))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT part,
    coalesce((SELECT max((quality = 1)::INT) FROM labels l WHERE l.doc_id = w.doc_id), 0) AS good,
    coalesce((SELECT max((toxic = 1)::INT) FROM labels l WHERE l.doc_id = w.doc_id), 0) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INT AS step, l.bit,
    coalesce((SELECT sum(p.bit) FROM l p WHERE position(p.f IN filter_order) < step), 0)::INT AS prefix
  FROM o, generate_series(1, 5) g(step) JOIN l ON l.f = substr(filter_order, step, 1)),
r AS (SELECT part, filter_order, step, s.bit,
    coalesce(sum(n) FILTER (WHERE mask & (prefix | s.bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & prefix = 0 AND mask & s.bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & prefix <> 0 AND mask & s.bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = s.bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & prefix = 0 AND mask & s.bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & prefix = 0 AND mask & s.bit <> 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, s.bit, prefix)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
