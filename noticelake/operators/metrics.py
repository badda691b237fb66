"""Operational and quality metrics. Undefined ratios are NULL, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from noticelake.operators.filters import timestamp
from noticelake.operators.skew import with_history

# Baseline length, alarm ratio and targets.
BASELINE_RUNS, YIELD_RATIO = 10, 0.5
PRECISION_TARGET, OPEN_RATE_TARGET, WEEK3_DAYS = 0.30, 0.40, 21


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


# -------------------------------------------------------------------- runs

def qualifying() -> Column:
    """Runs that may serve as a yardstick: complete, successful, not empty."""
    return (F.col("status") == "ok") & F.col("is_full_sweep") & (F.col("items_found") > 0)


def yield_baselines(runs: DataFrame, k: int = BASELINE_RUNS, min_runs: int = 1,
                    chunk: Column | None = None) -> DataFrame:
    """Every run with the mean yield of its last ``k`` qualifying predecessors.

    A window over "the last k qualifying rows" is the running window over the
    qualifying runs, seen by every run just before itself. Sources are cut into
    monthly chunks that start with the k qualifying runs before them."""
    chunk = chunk if chunk is not None else F.date_trunc("month", "started_at")
    ordered = runs.withColumn("_at", F.struct("started_at", "run_id"))
    rows, part = with_history(ordered, ["source_key"], "_at", chunk, k, qualifying())
    rows = rows.withColumn("_q", F.coalesce(qualifying(), F.lit(False)))
    own = Window.partitionBy(*part, "_q").orderBy("_at").rowsBetween(1 - k, 0)
    rows = rows.withColumns({
        "_mean": F.when(F.col("_q"), F.avg("items_found").over(own)),
        "_n": F.when(F.col("_q"), F.count("*").over(own))})
    before = Window.partitionBy(*part).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"baseline": F.last("_mean", True).over(before),
                             "baseline_runs": F.coalesce(F.last("_n", True).over(before), F.lit(0))})
    return (rows.filter(~F.col("_history"))
            .withColumn("baseline", F.when(F.col("baseline_runs") >= min_runs, F.col("baseline")))
            .drop("_history", "_chunk", "_at", "_q", "_mean", "_n"))


def is_anomalous(status: Column, found: Column, full: Column, baseline: Column) -> Column:
    """Failed or empty runs always; a capped run never for being small; a full
    sweep when it finds less than half its baseline."""
    return (F.when((status == "failed") | (found == 0), True)
            .when(~full | baseline.isNull(), False)
            .otherwise(found < baseline * YIELD_RATIO))


def yield_anomalies(runs: DataFrame, **options) -> DataFrame:
    return yield_baselines(runs, **options).withColumn("yield_anomaly", is_anomalous(
        F.col("status"), F.col("items_found"), F.col("is_full_sweep"), F.col("baseline")))


def trailing_yield(runs: DataFrame, k: int = BASELINE_RUNS) -> DataFrame:
    """Mean yield of the last ``k`` qualifying runs per source, as of now."""
    w = Window.partitionBy("source_key").orderBy(F.desc("started_at"), F.desc("run_id"))
    return (runs.filter(qualifying()).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= k).groupBy("source_key")
            .agg(F.avg("items_found").alias("baseline"), F.count("*").alias("runs")))


def run_report(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Found, new, changed and unchanged per run. Only list records make up the
    yield, so that detail fetches do not move the baseline."""
    n = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0))
    return outcomes.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "list", F.col("n"))), F.lit(0)).alias("items_found"),
        n("new").alias("items_new"), n("changed").alias("items_changed"),
        n("unchanged").alias("items_unchanged"))


def ingest_runs(counts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One run row per source of a batch: what the parse counted on its way
    (``parse.PAGE_COUNTS``) and what the merge made of the records."""
    runs = counts.join(run_report(outcomes, ["source_key"]), "source_key", "left")
    runs = runs.fillna(0, [c for c in runs.columns if c not in ("source_key", "started_at")])
    return runs.withColumns({
        "rows_dropped": F.col("rows_header") + F.col("rows_demonstration"),
        "status": F.when(F.col("parse_failures") > 0, "partial").otherwise("ok")}).drop("rows_kept")


def yield_verdicts(runs: DataFrame, history: DataFrame, k: int = BASELINE_RUNS) -> DataFrame:
    """New run rows with the trailing yield of their source and the verdict that
    :func:`is_anomalous` gives on it."""
    baseline = trailing_yield(history, k).select("source_key", "baseline")
    return runs.join(baseline, "source_key", "left").withColumn("yield_anomaly", is_anomalous(
        F.col("status"), F.col("items_found"), F.col("is_full_sweep"), F.col("baseline")))


def append_run(path: str, run: DataFrame) -> None:
    """Run log row of a finished job."""
    run.write.mode("append").parquet(path)


def last_success(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'ok'").groupBy("source_key").agg(
        F.max("finished_at").alias("last_success_at"))


def source_health(sources: DataFrame, notices: DataFrame, runs: DataFrame) -> DataFrame:
    """Per source: last success, live notices, newest notice. Notices are
    counted before the join, so a dominating source costs nothing extra."""
    counts = notices.groupBy("source_key").agg(
        F.count_if(F.col("status") == "live").alias("live_notices"),
        F.max("first_seen_at").alias("newest_notice"))
    return (sources.select("source_key").join(counts, "source_key", "left")
            .join(last_success(runs), "source_key", "left")
            .fillna(0, ["live_notices"]))


def recent_runs(runs: DataFrame, sources: DataFrame, limit: int = 10) -> DataFrame:
    return (runs.orderBy(F.desc("started_at"), "run_id").limit(limit)
            .join(sources.select("source_key", "name"), "source_key"))


def live_counts(notices: DataFrame) -> DataFrame:
    return notices.filter("status = 'live'").groupBy("source_key").agg(F.count("*").alias("n"))


def crawl_quality(runs: DataFrame, failures: DataFrame, as_of: str) -> DataFrame:
    """Last success, anomalies of the week, unresolved failures, as one row."""
    week = timestamp(as_of) - F.expr("INTERVAL 7 DAYS")
    one = runs.agg(
        F.max(F.when(F.col("status") == "ok", F.col("finished_at"))).alias("last_success"),
        F.count_if(F.col("yield_anomaly") & (F.col("started_at") > week)).alias("anomalies_7d"))
    open_failures = failures.agg(F.count_if(F.col("resolved_at").isNull()).alias("n"))
    return one.withColumn("unresolved_failures", open_failures.scalar())


def sweep_completeness(pages: DataFrame) -> DataFrame:
    """Pages fetched against the number each run's pages declare."""
    return pages.groupBy("source_key", "run_id").agg(
        F.count_distinct("page_no").alias("pages_seen"),
        F.max("total_pages").alias("pages_declared")).withColumn(
        "complete", F.col("pages_seen") >= F.col("pages_declared"))


# ---------------------------------------------------------------- accounts

def user_counts(users: DataFrame, as_of: str) -> DataFrame:
    week = timestamp(as_of) - F.expr("INTERVAL 7 DAYS")
    return users.agg(
        F.count("*").alias("total"), F.count("verified_at").alias("verified"),
        F.count("unsubscribed_at").alias("unsubscribed"),
        F.count_if(F.col("created_at") > week).alias("last_7d"))


def open_rates(alerts: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Open rate of e-mail digests, and of those to accounts three weeks old."""
    old = F.col("created_at") < timestamp(as_of) - F.expr(f"INTERVAL {WEEK3_DAYS} DAYS")
    sent, opened = F.col("sent_at").isNotNull(), F.col("opened_at").isNotNull()
    return (alerts.filter("channel = 'email'").select("user_id", "sent_at", "opened_at")
            .join(users.select("user_id", "created_at"), "user_id")
            .agg(F.count_if(sent).alias("sent"), F.count_if(opened).alias("opened"),
                 F.count_if(sent & old).alias("sent_week3"),
                 F.count_if(opened & old).alias("opened_week3"))
            .withColumns({"open_rate": ratio(F.col("opened"), F.col("sent")),
                          "open_rate_week3": ratio(F.col("opened_week3"), F.col("sent_week3"))}))


def match_precision(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count_if(F.col("verdict") == "up").alias("thumbs_up"),
        F.count_if(F.col("verdict") == "down").alias("thumbs_down"),
        F.count("*").alias("rated")).select(
        "*", ratio(F.col("thumbs_up"), F.col("rated")).alias("precision"),
        F.lit(PRECISION_TARGET).alias("target"))


def precision_both(verdicts: DataFrame, alerts: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Precision over rated and over sent: silence is not a rejection, so both."""
    sent = open_rates(alerts, users, as_of).select("sent")
    return (match_precision(verdicts).withColumn("alerts_sent", sent.scalar())
            .select("thumbs_up", "thumbs_down", "rated", "alerts_sent",
                    F.col("precision").alias("precision_of_rated"),
                    ratio(F.col("thumbs_up"), F.col("alerts_sent")).alias("precision_of_sent")))


def match_mix(matches: DataFrame, approximate: bool = False) -> DataFrame:
    """How matches were found. ``approximate`` trades the exact number of users
    for a sketch of fixed size."""
    by = lambda v: F.count_if(F.col("reasons.matched_by") == v).alias(v)
    users = F.approx_count_distinct("user_id") if approximate else F.count_distinct("user_id")
    return matches.agg(F.count("*").alias("total"), users.alias("users_with_matches"),
                       by("both"), by("semantic"), by("keyword"))


SKETCH_BITS = 12


def daily_match_mix(matches: DataFrame, day: Column, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """A row per day: how its matches were found, and a sketch of their users.

    Days are written once, and :func:`match_mix_of_days` adds up any of them without the
    matches. A sketch takes at most ``2 ** sketch_bits`` bytes or so however many users it has
    seen. Matches without a day are a day of their own, null users are not counted."""
    by = lambda v: F.count_if(F.col("reasons.matched_by") == v).alias(v)
    return matches.groupBy(day.alias("day")).agg(
        F.count("*").alias("total"), by("both"), by("semantic"), by("keyword"),
        F.hll_sketch_agg("user_id", F.lit(sketch_bits)).alias("users"))


def match_mix_of_days(days: DataFrame) -> DataFrame:
    """The mix over the days of ``days``. Users who matched on several days count once: the
    sketches are united. Up to some hundred users the count is exact; beyond that its standard
    error is 1.04 / sqrt(2 ** sketch_bits), 1.6 % with 12 bits. No days give zeros."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    users = F.hll_sketch_estimate(F.hll_union_agg("users"))
    return days.agg(total("total"), F.coalesce(users, F.lit(0)).alias("users_with_matches"),
                    total("both"), total("semantic"), total("keyword"))


def push_counts(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.agg(F.count_if(F.col("retired_at").isNull()).alias("active"),
                             F.count("retired_at").alias("retired"))
