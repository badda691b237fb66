"""Structured Streaming jobs.

Stateless and merging jobs run the batch operators inside ``foreachBatch``; every
sink they write is keyed by the batch id, so a batch that is replayed after a
failure overwrites its own output. Set operations and folds that Spark keeps
state for use its own streaming aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from noticelake.operators import alerts as alerting, awards, merge, metrics, postings
from noticelake.operators.accounts import MAX_FAILURES
from noticelake.schemas import KEY, PAYLOAD
from noticelake.session import cut_lineage, temporary
from noticelake.sources import archive, parse
from noticelake.sources.archive import path_exists
from noticelake.sources.buckets import BUCKETS

RUN_WINDOW = "30 minutes"


def read_payload_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", files_per_batch)
            .parquet(path))


def start(writer: DataStreamWriter, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Start with a checkpoint; without an interval, process what is there and stop."""
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def batch_name(batch: DataFrame, stream: str, batch_id: int) -> str:
    """A name that no other batch has: batch numbers start again with every checkpoint
    folder and in every stream, the id of a query is kept in its checkpoint."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{stream}-{query or 'batch'}-{batch_id}"


def ingest(payloads: DataFrame, path: str, as_of: Column, base_url: str = "", stream: str = "ingest",
           full_sweep: bool = False, n_buckets: int = BUCKETS, index: bool = True, **options) -> DataStreamWriter:
    """Archive, parse and merge payloads as they arrive, and close the run.

    The raw payload is stored before it is parsed; a batch is tokenized once and parsed
    once. New awards go into the award table. A run row per source says what the batch
    brought and did and whether its yield fell. Every output is named by the batch, and
    what the merge did is stored before it is published, so a batch that is replayed
    after any failure completes what is missing and adds nothing twice. ``full_sweep``
    says that a batch is a whole sweep: only then may it fall short, and serve later
    runs as a yardstick. ``index`` keeps the postings of the notices up to date."""
    def run(batch: DataFrame, batch_id: int) -> None:
        with temporary(batch.sparkSession):
            take(batch, batch_name(batch, stream, batch_id))

    def take(batch: DataFrame, name: str) -> None:
        archive.archive_payloads(batch, f"{path}/archive", name)
        result, counts = parse.parse_counted(batch, as_of, base_url)
        result.failures.write.mode("overwrite").parquet(f"{path}/failures/batch={name}")
        awards.insert_into(path, result.awards, name, n_buckets)
        outcomes = merge.merge_into(path, result.records, name, n_buckets, **options)
        if index:
            postings.add(f"{path}/postings", searchable(merge.read_changed(batch.sparkSession, path, name)), KEY, name, n_buckets)
        close_run(path, name, counts, outcomes, as_of, full_sweep)

    return payloads.writeStream.foreachBatch(run)


def searchable(notices: DataFrame) -> DataFrame:
    """Stored notices with the organization that searches look at."""
    return notices.withColumn("organization_path", parse.deepest(F.col("organization")))


def close_run(path: str, name: str, counts: DataFrame, outcomes: DataFrame, as_of: Column, full_sweep: bool) -> None:
    """Write the run rows of a batch; again with the same result if it is replayed."""
    rows = metrics.ingest_runs(counts, outcomes).withColumns({
        "run_id": F.xxhash64(F.lit(name), "source_key"), "finished_at": as_of, "is_full_sweep": F.lit(full_sweep)})
    history = run_log(counts.sparkSession, path).filter(F.col("batch") != name)
    metrics.yield_verdicts(rows, history).write.mode("overwrite").parquet(f"{path}/runs/batch={name}")


RUN = ("run_id long, source_key string, started_at timestamp, finished_at timestamp, status string, "
       "is_full_sweep boolean, items_found long, batch string")


def run_log(spark: SparkSession, path: str) -> DataFrame:
    folder = f"{path}/runs"
    return spark.read.schema(RUN).parquet(folder) if path_exists(spark, folder) else spark.createDataFrame([], RUN)


def merge_stream(observations: DataFrame, path: str, stream: str = "merge", **options) -> DataStreamWriter:
    """Fold observations into current state and versions, batch by batch.

    Observations older than what is stored for their notice arrive late; the
    fold lets them fill gaps and never overwrite."""
    return observations.writeStream.foreachBatch(
        lambda batch, batch_id: merge.merge_into(path, batch, batch_name(batch, stream, batch_id), **options))


def dedup(payloads: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Payloads without repeats of the same content within the horizon; state
    older than the watermark is dropped."""
    return (payloads.withColumn("content_hash", F.sha2("content", 256))
            .withWatermark("fetched_at", horizon)
            .dropDuplicatesWithinWatermark(["source_key", "content_hash"]))


def run_metrics(outcomes: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Outcome counts per source and half hour, emitted when a window closes."""
    n = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0))
    return (outcomes.withWatermark("observed_at", late)
            .groupBy(F.window("observed_at", RUN_WINDOW), "source_key")
            .agg(F.sum("n").alias("items_found"), n("new").alias("items_new"),
                 n("changed").alias("items_changed"), n("failed").alias("parse_failures"))
            .select("source_key", F.col("window.start").alias("started_at"),
                    F.col("window.end").alias("finished_at"), "items_found", "items_new",
                    "items_changed", "parse_failures"))


def latest_verdicts(feedback: DataFrame) -> DataFrame:
    """One verdict per user and notice, for update mode."""
    return feedback.groupBy("user_id", "notice_id").agg(
        F.max_by("verdict", F.struct("created_at", "verdict")).alias("verdict"),
        F.max("created_at").alias("created_at"))


def first_opens(opens: DataFrame) -> DataFrame:
    return opens.groupBy("alert_id").agg(F.min("opened_at").alias("opened_at"))


SUBSCRIBED, OK, GONE, FAILED = range(4)


def subscription_health(sends: DataFrame, idle_days: int | None = None) -> DataFrame:
    """Failure count and retirement per endpoint, kept as state across batches.

    ``sends`` has (endpoint, ts, seq, outcome). The state of an endpoint is three
    values however long its history. Its events of one micro-batch are folded chunk by
    chunk to 17 bytes each, and only those since its last subscription so far are kept.
    With ``idle_days`` the state of an endpoint ends when event time is that far beyond
    its last event; one that comes back later starts afresh, and events that come later
    than that are dropped."""
    out = "endpoint string, failure_count long, retired_at timestamp, last_success_at timestamp"
    state_schema = "failures long, retired_at timestamp, last_success_at timestamp"
    codes = {"subscribe": SUBSCRIBED, "ok": OK, "gone": GONE}

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, retired, success = state.get if state.exists else (0, None, None)
        since, last, parts = None, None, []
        for rows in batches:
            code = rows["outcome"].map(codes).fillna(FAILED).astype("int8")
            part = pd.DataFrame({"ts": rows["ts"], "seq": rows["seq"], "code": code})
            last = max([x for x in (last, part["ts"].max()) if x is not None])
            good = part.loc[code == OK, "ts"]
            if len(good):
                success = good.max() if success is None else max(success, good.max())
            new = part[code == SUBSCRIBED]
            if len(new):
                newest = max(zip(new["ts"], new["seq"]))
                since = newest if since is None else max(since, newest)
            parts.append(_after(part, since))
        events = _after(pd.concat(parts), since).sort_values(["ts", "seq"], ignore_index=True)
        if since is not None:  # a subscription starts afresh
            failures, retired = 0, None
        if retired is None and len(events):
            bad = events["code"] == FAILED
            run = (events["code"] == OK).cumsum()
            streak = bad.groupby(run).cumsum() + failures * (run == 0)
            over = events.index[(events["code"] == GONE) | bad & (streak >= MAX_FAILURES)]
            at = over[0] if len(over) else events.index[-1]
            retired = events.at[at, "ts"] if len(over) else None
            failures = int(streak.at[at])
        state.update((failures, retired, success))
        if idle_days is not None:
            # The watermark is ``idle_days`` behind: it reaches the last event when these are over.
            state.setTimeoutTimestamp(max(int(last.value // 1_000_000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({
            "endpoint": [key[0]], "failure_count": [failures],
            "retired_at": pd.to_datetime(pd.Series([retired])),
            "last_success_at": pd.to_datetime(pd.Series([success]))})

    timeout = GroupStateTimeout.NoTimeout
    if idle_days is not None:
        sends, timeout = sends.withWatermark("ts", f"{idle_days} days"), GroupStateTimeout.EventTimeTimeout
    return sends.groupBy("endpoint").applyInPandasWithState(update, out, state_schema, "update", timeout)


def _after(events: pd.DataFrame, since: tuple | None) -> pd.DataFrame:
    """The events after a (ts, seq); all of them without one."""
    if since is None:
        return events
    return events[(events["ts"] > since[0]) | (events["ts"] == since[0]) & (events["seq"] > since[1])]


def urgent_alerts(matches: DataFrame, notices: DataFrame, users: DataFrame, path: str, as_of: str,
                  stream: str = "push", **options) -> DataStreamWriter:
    """Alert rows for newly matched notices that close soon, each pair once.

    The alert log below ``path``/log and the outcomes that the sender appends to
    ``path``/outcomes tell what went out: a failed push frees its notices again. A
    replayed batch ignores its own earlier rows and rewrites them."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, batch_name(batch, stream, batch_id)
        log = alert_log(spark, path).filter(F.col("batch") != name)
        fresh = alerting.urgent_matches(batch, notices, users, log, as_of, **options)
        rows = alerting.alert_rows(alerting.group_alert_ids(fresh), "push", F.lit(as_of).cast("timestamp"))
        rows.write.mode("overwrite").parquet(f"{path}/log/batch={name}")

    return matches.writeStream.foreachBatch(run)


DUE = "user_id long, notice_id long, score double, closing_at timestamp, due_at timestamp"


def due_matches(matches: DataFrame, ticks: DataFrame, within_hours: int = alerting.URGENT_HOURS) -> DataFrame:
    """Matches at the moment their notice comes within ``within_hours`` of closing, each
    pair once, whenever it was matched.

    ``matches`` (user_id, notice_id, score, closing_at, matched_at) may come long before
    that; ``ticks`` (at) are the clock, and need rows only as often as alerts should go
    out. Event time moves with both. The state of a pair is its newest score and closing
    date; its timer is the opening of its last hours, then the closing, when the state
    ends. A notice whose closing moves before it was due takes its new time along; a pair that
    is matched after the closing is dropped."""
    window = within_hours * 3_600_000

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        score, closing, matched, fired = state.get if state.exists else (None, None, None, False)
        if state.hasTimedOut and fired:
            state.remove()
            return
        for rows in batches:
            rows = rows.dropna(subset=["closing_at"])
            for row in rows[rows["closing_at"].notna()].itertuples():
                at = int(row.at.value // 1_000_000)
                if matched is None or at >= matched:
                    score, closing, matched = float(row.score), int(row.closing_at.value // 1_000_000), at
        if closing is None:
            return
        if closing <= now:
            if state.exists:
                state.remove()
            return
        due = not fired and closing - window <= now
        state.update((score, closing, matched, fired or due))
        state.setTimeoutTimestamp(closing if fired or due else max(closing - window, now + 1))
        if due:
            yield pd.DataFrame({"user_id": [key[0]], "notice_id": [key[1]], "score": [score],
                                "closing_at": [pd.Timestamp(closing, unit="ms")], "due_at": [pd.Timestamp(now, unit="ms")]})

    none = F.lit(None)
    rows = matches.select("user_id", "notice_id", "score", "closing_at", F.col("matched_at").alias("at")).unionByName(
        ticks.select(none.cast("long").alias("user_id"), none.cast("long").alias("notice_id"), none.cast("double").alias("score"),
                     none.cast("timestamp").alias("closing_at"), "at"))
    return rows.withWatermark("at", "0 seconds").groupBy("user_id", "notice_id").applyInPandasWithState(
        update, DUE, "score double, closing long, matched long, fired boolean", "append", GroupStateTimeout.EventTimeTimeout)


def alerts_when_due(matches: DataFrame, ticks: DataFrame, notices: DataFrame, users: DataFrame, path: str,
                    stream: str = "due", **options) -> DataStreamWriter:
    """Alert rows for the matches that become due, a row per user and batch. Pairs that
    were pushed before, by this job or another, stay out; so do closed notices and
    users who left."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, batch_name(batch, stream, batch_id)
        log = alert_log(spark, path).filter(F.col("batch") != name)
        due = cut_lineage(batch)
        if due.isEmpty():
            return
        now = due.agg(F.max("due_at").cast("string")).first()[0]
        fresh = alerting.urgent_matches(due.select("user_id", "notice_id", "score"), notices, users, log, now, **options)
        rows = alerting.alert_rows(alerting.group_alert_ids(fresh), "push", F.lit(now).cast("timestamp"))
        rows.write.mode("overwrite").parquet(f"{path}/log/batch={name}")

    return due_matches(matches, ticks).writeStream.outputMode("append").foreachBatch(run)


ALERT = ("alert_id long, user_id long, channel string, notice_ids array<bigint>, created_at timestamp, batch string")
OUTCOME = "alert_id long, ts timestamp, outcome string, error string"


def alert_log(spark: SparkSession, path: str) -> DataFrame:
    """Alert rows with what became of them: sent_at, opened_at, error."""
    def table(name: str, schema: str) -> DataFrame:
        folder = f"{path}/{name}"
        return (spark.read.schema(schema).parquet(folder) if path_exists(spark, folder)
                else spark.createDataFrame([], schema))

    return alerting.alerts_with_outcome(table("log", ALERT), table("outcomes", OUTCOME))


def run_stages(stages: dict[str, Callable[[], object]]) -> dict[str, str | None]:
    """Run the stages in order; one that fails does not stop the rest.

    Returns the error of each stage, or None."""
    errors: dict[str, str | None] = {}
    for name, stage in stages.items():
        try:
            stage()
            errors[name] = None
        except Exception as exc:  # noqa: BLE001
            errors[name] = f"{type(exc).__name__}: {exc}"
    return errors


def yield_alarms(closed_windows: DataFrame, **options) -> DataFrame:
    """Yield anomalies over the windows that :func:`run_metrics` has emitted."""
    runs = closed_windows.select(
        F.xxhash64("source_key", "started_at").alias("run_id"), "source_key", "started_at",
        "finished_at", "items_found", F.lit(True).alias("is_full_sweep"),
        F.when(F.col("parse_failures") > 0, "partial").otherwise("ok").alias("status"))
    return metrics.yield_anomalies(runs, **options)
