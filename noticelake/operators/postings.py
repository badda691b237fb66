"""Stored postings: search and word counts without reading or splitting any text.

A posting says where a word stands in the search document of a notice. Parts of package
and reference numbers are found by trigrams, kept in the same table. Postings lie in
buckets of their term, sorted by it, in one segment per indexed batch; a search reads the buckets
of its terms. ``indexed`` (a table in buckets of the notice key) says which content of
a notice is indexed and in which segment, so a batch adds segments for new and changed
notices only, and postings of former content are told by their digest. A segment counts
once its batch is published there; one lost on the way is overwritten by the rerun.
``compact`` folds all segments into one.

A common word has a posting per notice. They are spread over files and tasks, are
grouped by notice and never by word, and joins with words are salted."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from noticelake.functions.text import let, tokens
from noticelake.operators import search
from noticelake.session import temporary, written
from noticelake.sources import buckets
from noticelake.sources.tables import upsert

TERM_BUCKETS = 64
GRAM = 3
SALTS = 16
#: A batch is indexed by a task per megabyte, beyond so many tasks by a task per some.
TASKS, TASK_MEGABYTES = 64, 8
_NUMBERS = ("package_no", "reference_no")
_COMPACT = "compact-"


def digest() -> Column:
    """Changes when anything that is indexed changes."""
    return F.xxhash64(search.document(), *_NUMBERS)


def _grams(text: Column) -> Column:
    """Distinct trigrams of a number; marked, so that none is taken for a word."""
    low = F.lower(text)
    places = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.concat(F.lit("#"), F.substring(low, i, F.lit(GRAM)))))


def _places(words: Column) -> Column:
    """(term, positions) of the words of one text: sorted, equal words are a run."""
    each = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at"))))

    def runs(sorted_words: Column) -> Column:
        term = lambda i: F.get(sorted_words, i)["term"]
        ends = F.filter(F.sequence(F.lit(1), F.size(sorted_words)), lambda i: ~term(i).eqNullSafe(term(i - 1)))
        return let(sorted_words["at"], lambda at: let(ends, lambda e: F.transform(e, lambda end, n: let(
            F.coalesce(F.when(n > 0, F.get(e, n - 1)), F.lit(0)), lambda start: F.struct(
                term(start).alias("term"), F.slice(at, start + 1, end - start).alias("positions"))))))

    kind = "array<struct<term:string,positions:array<int>>>"
    return F.when(F.size(words) > 0, let(each, runs)).otherwise(F.array().cast(kind))


def postings(notices: DataFrame, keys: list[str]) -> DataFrame:
    """(term, keys, digest, positions) of notices; a trigram has no positions.

    All words of a notice are in one row and are grouped there: nothing is shuffled."""
    none = F.array().cast("array<int>")
    grams = [F.transform(F.coalesce(_grams(F.col(c)), F.array().cast("array<string>")), lambda g: F.struct(g.alias("term"), none.alias("positions")))
             for c in _NUMBERS]
    terms = notices.select(*keys, digest().alias("digest"), let(tokens(search.document()), _places).alias("words"),
                           F.array_distinct(F.concat(*grams)).alias("grams"))
    each = terms.select(*keys, "digest", F.explode(F.concat("words", "grams")).alias("p"))
    return each.select("p.term", *keys, "digest", "p.positions")


def _indexed_schema(notices: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([notices.schema[k] for k in keys] + [T.StructField("digest", T.LongType())])


def add(path: str, notices: DataFrame, keys: list[str], batch: str, n_buckets: int = TERM_BUCKETS) -> bool:
    """Index the notices that are new or changed; False when the batch was added already."""
    spark, table = notices.sparkSession, f"{path}/indexed"
    if buckets.has_batch(spark, table, batch):
        return False
    schema = _indexed_schema(notices, keys)
    held = buckets.read(spark, table, schema)
    with temporary(spark):
        todo = written(notices.withColumn("digest", digest()).join(held, [*keys, "digest"], "left_anti"))
        _write_segment(path, with_bucket(postings(_dealt(todo), keys), n_buckets), batch, n_buckets, keys)
        return buckets.change(table, schema, keys, todo.select(*keys, "digest"),
                              lambda old, new: upsert(old, new.withColumn("_at", F.lit(0)), keys, "_at"), batch)


def _dealt(todo: DataFrame) -> DataFrame:
    """Stored notices over as many tasks as they are megabytes; many of them over fewer, as
    each task writes a file per bucket. A notice is a twentieth of its postings."""
    size = int(str(todo._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    megabytes = max(1, -(-size // 2**20))
    return todo.repartition(min(megabytes, max(TASKS, -(-megabytes // TASK_MEGABYTES))))


def with_bucket(rows: DataFrame, n_buckets: int) -> DataFrame:
    return rows.withColumn("bucket", buckets.bucket_of(["term"], n_buckets))


def _write_segment(path: str, rows: DataFrame, segment: str, n_buckets: int, keys: list[str]) -> None:
    """The rows as they are dealt: every task sorts its own and writes its part of each bucket,
    so postings are not shuffled."""
    (rows.sortWithinPartitions("bucket", "term", *keys).write.mode("overwrite").option("compression", "zstd")
     .partitionBy("bucket").parquet(f"{path}/segments/segment={segment}"))
    buckets.create_once(rows.sparkSession, f"{path}/layout", "buckets", str(n_buckets))
    buckets.create_once(rows.sparkSession, f"{path}/layout", "schema", rows.schema.json())


def _segments(spark: SparkSession, path: str) -> list[str]:
    """Names of the published segments since the last compaction."""
    found = [r.batch for r in buckets.batches(spark, f"{path}/indexed").orderBy("version").collect()]
    last = max((i for i, b in enumerate(found) if b.startswith(_COMPACT)), default=0)
    return found[last:]


def _layout(spark: SparkSession, path: str) -> int:
    return int(buckets.read_text(spark, f"{path}/layout/buckets"))


def read(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """The postings of some terms, from the buckets of these terms only, or all."""
    segments = _segments(spark, path)
    if not segments:
        raise ValueError(f"nothing is indexed below {path}")
    folders = {s: [n for n in buckets.names(spark, f"{path}/segments/segment={s}") if n.startswith("bucket=")] for s in segments}
    if terms is not None:
        n = _layout(spark, path)
        mine = spark.createDataFrame([(t,) for t in terms], "term string").select(buckets.bucket_of(["term"], n).alias("b")).distinct()
        wanted = {f"bucket={r.b}" for r in mine.collect()}  # one row per word of a query
        folders = {s: [n for n in names if n in wanted] for s, names in folders.items()}
    schema = T.StructType.fromJson(json.loads(buckets.read_text(spark, f"{path}/layout/schema")))
    files = [f"{path}/segments/segment={s}/{n}" for s, names in folders.items() for n in names]
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows if terms is None else rows.filter(F.col("term").isin(terms))


def compact(spark: SparkSession, path: str, notices_schema: T.StructType, keys: list[str]) -> str:
    """Fold all segments into one without postings of former content; returns its name."""
    name = f"{_COMPACT}{uuid.uuid4().hex}"
    schema = T.StructType([notices_schema[k] for k in keys] + [T.StructField("digest", T.LongType())])
    held = buckets.read(spark, f"{path}/indexed", schema)
    valid = read(spark, path).dropDuplicates(["term", *keys, "digest"]).join(held, [*keys, "digest"], "left_semi")
    n = _layout(spark, path)
    # Here the postings were shuffled by notice: one more brings a bucket's together.
    _write_segment(path, with_bucket(valid, n).hint("rebalance", "bucket"), name, n, keys)
    buckets.change(f"{path}/indexed", schema, keys, held, lambda old, new: old, name)
    return name


def _phrase(found: Column, words: tuple[str, ...]) -> Column:
    """Whether the words stand side by side, from their positions."""
    at = [F.try_element_at(found, F.lit(w)) for w in words]
    if len(words) == 1:
        return at[0].isNotNull()
    following = lambda p: _all(F.array_contains(a, p + i) for i, a in enumerate(at[1:], 1))
    return F.coalesce(F.exists(at[0], following), F.lit(False))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def search_notices(path: str, notices: DataFrame, keys: list[str], q: str) -> DataFrame:
    """The notices that ``search.search_filter`` finds for the query, with ``rank``.

    Alternatives that only exclude words, and fragments shorter than a trigram, have no
    postings to start from: then the notices are scanned instead."""
    spark, groups = notices.sparkSession, search.parse_query(q)
    fragment = q.lower()
    if len(fragment) < GRAM or not all(any(not t.negated for t in g) for g in groups):
        return notices.filter(search.search_filter(q)).withColumn("rank", search.rank(tokens(search.document()), q))
    words = sorted({w for g in groups for t in g for w in t.words})
    positive = sorted({w for g in groups for t in g if not t.negated for w in t.words})
    grams = sorted({f"#{fragment[i:i + GRAM]}" for i in range(len(fragment) - GRAM + 1)})
    # At most the query's terms come together for a notice; equal postings of two segments are one.
    hits = read(spark, path, words + grams).groupBy(*keys, "digest").agg(
        F.map_from_entries(F.collect_set(F.struct("term", "positions"))).alias("found"))
    found = F.col("found")
    in_text = _any(_all(~_phrase(found, t.words) if t.negated else _phrase(found, t.words) for t in g) for g in groups)
    in_number = _all(F.map_contains_key(found, g) for g in grams)
    hits = hits.withColumn("in_text", in_text).filter(F.col("in_text") | in_number)
    score = F.lit(0)
    for w in positive:
        score = score + F.coalesce(F.size(F.try_element_at(found, F.lit(w))), F.lit(0))
    hits = hits.select(*keys, "digest", "in_text", (score * F.lit(search.OCCURRENCE_WEIGHT)).alias("rank"))
    numbers = _any(F.coalesce(search.substring(F.col(c), q), F.lit(False)) for c in _NUMBERS)
    kept = notices.withColumn("digest", digest()).join(hits, [*keys, "digest"]).filter(F.col("in_text") | numbers)
    return kept.select(*notices.columns, "rank")


def word_counts(path: str, keywords: DataFrame, notices: DataFrame, key: str = "id") -> DataFrame:
    """(notice_id, counts) as ``matching.word_counts`` gives, from stored postings: the
    words come from the index, so no text is read. ``notices`` says which notices count."""
    spark = keywords.sparkSession
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
    vocabulary = keywords.select(F.col("word").alias("term")).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = (read(spark, path).filter(~F.col("term").startswith("#"))
            .select("term", key, "digest", F.size("positions").cast("long").alias("n"), salt.alias("salt"))
            .join(vocabulary, ["term", "salt"], "left_semi"))
    now = notices.select(key, digest().alias("digest"))
    counted = rows.groupBy(key, "digest").agg(F.map_from_entries(F.collect_set(F.struct("term", "n"))).alias("counts"))
    return counted.join(now, [key, "digest"], "left_semi").select(F.col(key).alias("notice_id"), "counts")
