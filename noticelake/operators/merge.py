"""Folding repeated partial observations into current state and versions.

A list sweep sees a few fields of a notice, its detail page sees all of them,
and the two render the same field differently. The rules of the fold:

* an empty value never erases a known one;
* once a detail page has been seen, list observations only fill gaps, but for the
  fields that always follow the latest observation (status and closing date);
* a version is written only when a version-defining field really changed;
* fields learned for the first time are an enrichment, not an amendment.

The state after any prefix of a key's observations has a closed form, so the
fold is a running window rather than a loop. Call an observation *ruling* if it
is a detail, or a list sweep from before the first detail. Then, per field,

    state = coalesce(last ruling value, stored value, first other value)

taken over non-empty values only: a ruling value overrides whatever is there,
and any other value can only land in an empty field.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from noticelake.functions.records import canonical_hash, change_type, changed_fields
from noticelake.operators.skew import HOT_ROWS, split_hot
from noticelake.schemas import HASH_FIELDS, KEY, NOTICE, VALUE_FIELDS, VERSION
from noticelake.session import temporary, written
from noticelake.sources import buckets

# Fields that list sweeps may move after a detail page was seen.
ALWAYS_LATEST = ("status", "closing_at")
# The key led by its hash: most keys share their first characters, and a sort that
# tells them apart by a number compares few texts.
_KEYED = ["_k", *KEY]
STORED = ["canonical_hash", "version_no", "first_seen_at", "last_seen_at", "detail_fetched_at"]


class MergeResult(NamedTuple):
    current: DataFrame   # the touched notices, in their new state
    versions: DataFrame  # versions to append
    outcomes: DataFrame  # one row per observation: new, changed or unchanged


def known(name: str, c: Column) -> Column:
    """The value, or NULL when it is empty text or an empty list."""
    kind = VALUE_FIELDS[name]
    if isinstance(kind, T.StringType):
        return F.when(c != "", c)
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(c) > 0, c)
    if isinstance(kind, T.StructType):
        return F.when(F.coalesce(*[c[f.name] for f in kind.fields]).isNotNull(), c)
    return c


def overlay(stored: dict[str, Column], incoming: dict[str, Column],
            fill_only: bool = False) -> dict[str, Column]:
    """One observation laid over one stored row, field by field."""
    out = {}
    for name in incoming:
        old, new = known(name, stored[name]), known(name, incoming[name])
        first, second = (old, new) if fill_only else (new, old)
        out[name] = F.coalesce(first, second)
    return out


def _prepared(observations: DataFrame) -> DataFrame:
    """Typed observations."""
    typed = observations.select(
        *KEY, (F.col("kind") == "detail").alias("_detail"),
        F.col("observed_at").cast("timestamp").alias("observed_at"), "raw_document_id",
        *[known(n, F.col(n).cast(t)).alias(n) for n, t in VALUE_FIELDS.items()])
    return typed.withColumn("_k", F.xxhash64(*KEY))


def _ordered(obs: DataFrame) -> DataFrame:
    """With an order that is total and repeatable. It is made of the other columns, so it is
    added where the rows are, after they were dealt."""
    return obs.withColumn("_ord", F.struct(
        "observed_at", "_detail", F.coalesce("raw_document_id", F.lit(0)).alias("doc"),
        F.xxhash64(*VALUE_FIELDS).alias("content"), "raw_document_id")).drop("raw_document_id")


def _struct(get) -> Column:
    return F.struct(*[get(n).alias(n) for n in VALUE_FIELDS])


def _stored(current: DataFrame) -> DataFrame:
    return current.select(
        F.xxhash64(*KEY).alias("_k"), *KEY, *[known(n, F.col(n)).alias(f"b_{n}") for n in VALUE_FIELDS],
        *[F.col(c).alias(f"_st_{c}") for c in STORED], F.lit(True).alias("_exists"))


def _ruling(seen: Column) -> Column:
    """Late list and detail observations, older than what is stored, only fill."""
    late = F.coalesce(F.col("observed_at") < F.col("_st_last_seen_at"), F.lit(False))
    return (F.col("_detail") | ~seen) & ~late


def _once(obs: DataFrame, part: list[str]) -> DataFrame:
    """Observations without exact copies, which lie side by side in the order of the fold.

    ``_pos`` and ``_total`` tell `_fold` how many there were."""
    w = Window.partitionBy(*part).orderBy("_ord")
    return obs.withColumns({
        "_pos": F.row_number().over(w),
        "_total": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "_again": F.lag("_ord").over(w).eqNullSafe(F.col("_ord")),
        "_after_detail": F.coalesce(F.max("_detail").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)),
        "_min_at": F.first("observed_at").over(w)}).filter("NOT _again").drop("_again")


def _fresh(n: str, always_latest: tuple[str, ...]) -> Column:
    """The field where the observation overrides what is there."""
    rules = F.col("_ruling")
    if n in always_latest:
        rules = rules | (F.col("observed_at") >= F.coalesce("_st_last_seen_at", "observed_at"))
    return F.when(rules, F.col(n))


def _other(n: str) -> Column:
    return F.when(~F.col("_ruling"), F.col(n))


def _fold(rows: DataFrame, part: list[str], always_latest: tuple[str, ...]) -> DataFrame:
    """State, previous state, outcome and diff after every observation.

    ``rows`` come from `_once` and carry ``_ruling`` and what precedes their partition:
    the state as ``b_<field>``, ``_exists``, ``_versions``, ``_detail_at`` and
    whether the partition is the ``_end`` of its key. All windows share one ordering, so the whole fold costs one shuffle and one sort."""
    w = Window.partitionBy(*part).orderBy("_ord")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = rows.withColumns({
        **{f"s_{n}": F.coalesce(F.last(_fresh(n, always_latest), True).over(upto), F.col(f"b_{n}"),
                                F.first(_other(n), True).over(upto)) for n in VALUE_FIELDS},
        "_first": (F.col("_pos") == 1) & ~F.col("_exists"),
        "_copies": F.coalesce("_copies", (F.coalesce(F.lead("_pos").over(w), F.col("_total") + 1) - F.col("_pos")).cast("long")),
        "_detail_seen_at": F.greatest(
            F.max(F.when(F.col("_detail"), F.col("observed_at"))).over(upto), "_detail_at"),
        "_last_row": F.col("_end") & F.lead("observed_at").over(w).isNull()})
    df = df.select(
        *part, "_ord", "_detail", "observed_at",
        "_ord.raw_document_id", "_copies", "_first", "_last_row", "_detail_seen_at", "_versions",
        "_first_seen", "_st_last_seen_at",
        _struct(lambda n: F.col(f"s_{n}")).alias("_state"),
        F.struct(*[F.col(f"b_{n}").alias(n) for n in HASH_FIELDS]).alias("_before"))
    df = df.withColumn("_hash", canonical_hash(lambda n: F.col("_state")[n]))
    narrow = F.struct(*[F.col("_state")[n].alias(n) for n in HASH_FIELDS])
    df = df.withColumns({
        "_old": F.coalesce(F.lag(narrow).over(w), "_before"),
        "_old_hash": F.coalesce(F.lag("_hash").over(w),
                                canonical_hash(lambda n: F.col("_before")[n]))})
    df = df.withColumn("outcome", F.when(F.col("_first"), "new")
                       .when(F.col("_hash") != F.col("_old_hash"), "changed")
                       .otherwise("unchanged"))
    return df.withColumn("_version_no", (F.col("_versions") + F.count_if(
        F.col("outcome") != "unchanged").over(upto)).cast("int"))


def _fold_ordinary(obs: DataFrame, stored: DataFrame, always_latest) -> DataFrame:
    rows = _once(_ordered(obs.repartition(*_KEYED)), _KEYED).join(stored, _KEYED, "left").withColumns({
        "_exists": F.coalesce("_exists", F.lit(False)),
        "_versions": F.coalesce("_st_version_no", F.lit(0)),
        "_detail_at": F.col("_st_detail_fetched_at"),
        "_copies": F.lit(None).cast("long"), "_end": F.lit(True),
        "_first_seen": F.coalesce("_st_first_seen_at", "_min_at")})
    seen = F.col("_after_detail") | F.col("_st_detail_fetched_at").isNotNull()
    return _fold(rows.withColumn("_ruling", _ruling(seen)), _KEYED, always_latest).drop("_k")


def _fold_hot(obs: DataFrame, stored: DataFrame, always_latest, chunk_seconds: int) -> DataFrame:
    """The fold for keys too big for one task.

    Observations are dealt once, by time chunks. There exact copies collapse (they cannot
    change the state) as they are read. Only summaries of chunks come together per key: whether a detail was seen before
    a chunk, then the state before it. Versions are counted per chunk, see `results_of`."""
    part, chunk = [*_KEYED, "_chunk"], F.floor(F.unix_seconds("observed_at") / chunk_seconds).alias("_chunk")
    # The filter keeps the copies in both uses below, so that they share one shuffle.
    dealt = obs.select("*", chunk).repartition(*part)
    once = _once(_ordered(dealt.groupBy(*dealt.columns).agg(F.count("*").alias("_copies"))), part).filter("_copies > 0")
    by_chunk = Window.partitionBy(*_KEYED).orderBy("_chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    detail_at = F.max(F.when(F.col("_detail"), F.col("observed_at")))
    chunks = (obs.groupBy(*_KEYED, chunk).agg(detail_at.alias("_at"), F.min("observed_at").alias("_from"))
              .withColumns({"_chunk_detail_at": F.max("_at").over(before), "_key_from": F.first("_from").over(by_chunk),
                            "_later": F.row_number().over(by_chunk) > 1, "_end": F.lead("_chunk").over(by_chunk).isNull()})
              .join(stored.select(*_KEYED, "_st_detail_fetched_at", "_st_last_seen_at"), _KEYED, "left").drop("_at", "_from"))

    def ruled(rows: DataFrame) -> DataFrame:
        seen = F.col("_after_detail") | F.col("_chunk_detail_at").isNotNull() | F.col("_st_detail_fetched_at").isNotNull()
        return rows.withColumn("_ruling", _ruling(seen))

    whole = Window.partitionBy(*part).orderBy("_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = ruled(once.join(chunks, part)).withColumns(
        {f"r_{n}": F.last(_fresh(n, always_latest), True).over(whole) for n in VALUE_FIELDS}
        | {f"o_{n}": F.first(_other(n), True).over(whole) for n in VALUE_FIELDS}).filter("_pos = 1")
    lead = sums.select(
        *part, "_chunk_detail_at", "_key_from", "_later", "_end",
        *[F.last(f"r_{n}", True).over(before).alias(f"r_{n}") for n in VALUE_FIELDS],
        *[F.first(f"o_{n}", True).over(before).alias(f"o_{n}") for n in VALUE_FIELDS]).join(stored, _KEYED, "left")
    known_before = lead.withColumns({f"b_{n}": F.coalesce(f"r_{n}", f"b_{n}", f"o_{n}") for n in VALUE_FIELDS}).drop(
        *[f"{p}_{n}" for n in VALUE_FIELDS for p in "ro"])
    rows = ruled(once.join(known_before, part)).withColumns({
        "_exists": F.coalesce("_exists", F.lit(False)) | F.col("_later"),
        "_versions": F.coalesce("_st_version_no", F.lit(0)),
        "_detail_at": F.greatest("_st_detail_fetched_at", "_chunk_detail_at"),
        "_first_seen": F.coalesce("_st_first_seen_at", "_key_from")})
    return _fold(rows, part, always_latest).drop("_k")


def fold_observations(current: DataFrame, observations: DataFrame,
                      always_latest: tuple[str, ...] = ALWAYS_LATEST, hot_rows: int | None = HOT_ROWS,
                      chunk_seconds: int = 3600) -> DataFrame:
    """One row per distinct observation, its copies counted, with state, outcome
    and diff inputs; the same rows whatever ``hot_rows`` is.

    ``always_latest`` names fields that the newest observation always decides,
    list or detail, so that an extension seen only by list sweeps is not hidden
    behind an old detail page. With () the detail page is authoritative for
    every field.

    ``hot_rows=None`` skips the search for oversized keys, for batches known to
    hold few observations per key. ``_version_no`` counts within a ``_chunk`` of an
    oversized key; `results_of` counts over all."""
    obs, stored = _prepared(observations), _stored(current)
    if hot_rows is None:
        return _fold_ordinary(obs, stored, always_latest)
    if hot_rows == 0:  # every key has more
        return _fold_hot(obs, stored, always_latest, chunk_seconds)
    ordinary, hot = split_hot(obs, KEY, hot_rows)
    return _fold_ordinary(ordinary, stored, always_latest).unionByName(
        _fold_hot(hot, stored, always_latest, chunk_seconds), allowMissingColumns=True)


def _numbered(rows: DataFrame, folded: DataFrame) -> DataFrame:
    """Rows of a fold with versions counted on from the chunks before."""
    if "_chunk" not in folded.columns:
        return rows
    before = Window.partitionBy(*KEY).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    made = (folded.filter("_chunk IS NOT NULL").groupBy(*KEY, "_chunk")
            .agg(F.count_if(F.col("outcome") != "unchanged").alias("_made"))
            .select(*KEY, "_chunk", F.sum("_made").over(before).alias("_offset")))
    return rows.join(made, [*KEY, "_chunk"], "left").withColumn(
        "_version_no", (F.col("_version_no") + F.coalesce("_offset", F.lit(0))).cast("int"))


def _for_results(folded: DataFrame) -> DataFrame:
    """A fold with what `results_of` reads of it: states of rows that become a version or a
    notice, former states of changes only."""
    changed, made = F.col("outcome") == "changed", F.col("outcome") != "unchanged"
    return folded.withColumns({
        "_old": F.when(changed, F.col("_old")), "_state": F.when(made | F.col("_last_row"), F.col("_state"))}).drop(
        "_ord", "_first", "_versions", "_before", "_old_hash")


def results_of(folded: DataFrame) -> MergeResult:
    changes = changed_fields(lambda n: F.col("_old")[n], lambda n: F.col("_state")[n])
    versions = (_numbered(folded.filter("outcome <> 'unchanged'"), folded)
                .withColumn("changed_fields", F.when(
                    F.col("outcome") == "new", F.create_map().cast(VERSION["changed_fields"].dataType))
                    .otherwise(changes))
                .select(*KEY, F.col("_version_no").alias("version_no"),
                        F.when(F.col("outcome") == "new", "new").otherwise(change_type(
                            F.col("changed_fields"), F.col("_state.status"),
                            F.col("_old.closing_at"), F.col("_state.closing_at"))).alias("change_type"),
                        "observed_at", F.col("_hash").alias("canonical_hash"),
                        "changed_fields", "raw_document_id"))
    touched = _numbered(folded.filter("_last_row"), folded).select(
        *KEY, "_state.*", F.col("_hash").alias("canonical_hash"),
        F.col("_version_no").alias("version_no"), F.col("_first_seen").alias("first_seen_at"),
        F.greatest("observed_at", "_st_last_seen_at").alias("last_seen_at"),
        F.col("_detail_seen_at").alias("detail_fetched_at"))
    # Further copies of a new or changed observation changed nothing.
    outcomes = folded.select(
        *KEY, "observed_at", F.when(F.col("_detail"), "detail").otherwise("list").alias("kind"),
        F.explode(F.concat(F.array(F.struct("outcome", F.lit(1).cast("long").alias("n"))),
                           F.array(F.struct(F.lit("unchanged").alias("outcome"),
                                            (F.col("_copies") - 1).alias("n"))))).alias("_o"),
    ).select(*KEY, "observed_at", "kind", "_o.outcome", "_o.n").filter("n > 0")
    return MergeResult(touched, versions, outcomes)


def merge_observations(current: DataFrame, observations: DataFrame, **options) -> MergeResult:
    """Fold a batch of observations into the stored state."""
    return results_of(fold_observations(current, observations, **options))


def apply_merge(current: DataFrame, merged: DataFrame) -> DataFrame:
    """Full current state: touched notices replace their stored rows."""
    return current.join(merged.select(*KEY), KEY, "left_anti").unionByName(merged)


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """The current state of the merge tables below ``path``."""
    return buckets.read(spark, f"{path}/notices", NOTICE)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """Versions of published batches; those of a batch that is still being merged, or
    was lost on the way, are not seen."""
    schema = T.StructType([*VERSION.fields, T.StructField("batch", T.StringType())])
    done = buckets.batches(spark, f"{path}/notices").select("batch")
    return spark.read.schema(schema).parquet(f"{path}/versions").join(done, "batch", "left_semi").select(VERSION.fieldNames())


def read_changed(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """The notices that a batch touched, in the state it left them in."""
    return spark.read.schema(NOTICE).parquet(f"{path}/changed/batch={batch}")


def merge_into(path: str, observations: DataFrame, batch: str, n_buckets: int = buckets.BUCKETS,
               **options) -> DataFrame:
    """Merge a named batch into the tables below ``path``; returns outcome counts per source.

    Only the buckets of the batch's keys are read, healed and rewritten. The fold feeds
    three outputs, so it is written once. Versions and outcome counts go into
    directories of the batch's own before the new state is published under its name: a
    rerun after a failure overwrites them, and a batch that has been published is not
    merged again, its counts are read back."""
    spark = observations.sparkSession

    def rewrite(current: DataFrame, batch_rows: DataFrame) -> DataFrame:
        current = heal(current)
        with temporary(spark):
            result = results_of(written(_for_results(fold_observations(current, batch_rows, **options))))
            result.versions.write.mode("overwrite").parquet(f"{path}/versions/batch={batch}")
            counts = result.outcomes.groupBy("source_key", "outcome", "kind").agg(F.sum("n").alias("n"))
            counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/outcomes/batch={batch}")
            result.current.write.mode("overwrite").parquet(f"{path}/changed/batch={batch}")
        return apply_merge(current, read_changed(spark, path, batch))

    buckets.change(f"{path}/notices", NOTICE, KEY, observations, rewrite, batch, n_buckets)
    return spark.read.schema("source_key string, outcome string, kind string, n long").parquet(f"{path}/outcomes/batch={batch}")


def healed(notices: DataFrame) -> DataFrame:
    """Notices whose stored hash disagrees with their fields: to be re-hashed,
    never versioned. Empty unless another writer stored the hash."""
    right = canonical_hash(lambda n: F.col(n))
    return (notices.withColumn("expected_hash", right)
            .filter(~F.col("canonical_hash").eqNullSafe(F.col("expected_hash"))))


def heal(notices: DataFrame) -> DataFrame:
    """Notices with the hash that their fields have. No version comes of it: a wrong
    hash alone would make the next observation look like an amendment."""
    return notices.withColumn("canonical_hash", canonical_hash(lambda n: F.col(n))).select(*notices.columns)
