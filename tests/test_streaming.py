"""Streams fed in several files give what the batch operators give at once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noticelake import session
from noticelake.operators import accounts, merge, postings, search
from noticelake.schemas import KEY, NOTICE, OBSERVATION, PAYLOAD
from noticelake.sources import archive, buckets, parse
from noticelake.streaming import daily as D, jobs as J
from tests.test_merge import T0, frame, random_rows
from tests.test_parse import LIST_ROW, OFFLINE_ROW, payload
from tests.test_skew import health_by_loop, random_sends


def feed(df, path, parts, by):
    """One file per batch, in order of ``by``."""
    rows = df.orderBy(by).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        piece = df.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], df.schema)
        piece.coalesce(1).write.mode("append").parquet(path)


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(writer, tmp_path, name):
    query = J.start(writer, str(tmp_path / f"cp-{name}"))
    query.awaitTermination(600)
    assert query.exception() is None


def into_memory(spark, df, name, mode, tmp_path):
    run(df.writeStream.format("memory").queryName(name).outputMode(mode), tmp_path, name)
    return spark.table(name)


def test_merge_stream_equals_one_batch(spark, tmp_path):
    rows = random_rows(21, 15)
    feed(frame(spark, rows), str(tmp_path / "in"), 2, "observed_at")
    out = str(tmp_path / "out")
    run(J.merge_stream(stream(spark, OBSERVATION, str(tmp_path / "in")), out, n_buckets=4, hot_rows=None), tmp_path, "m")
    whole = merge.merge_observations(spark.createDataFrame([], NOTICE), frame(spark, rows), hot_rows=None)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(merge.read_notices(spark, out)) == key(whole.current)
    versions = merge.read_versions(spark, out)
    assert key(versions) == key(whole.versions)


def test_batches_leave_no_intermediate_tables(spark, tmp_path):
    import os

    held = lambda: {os.path.join(d, f) for d, _, files in os.walk(session.checkpoint_folder(spark).removeprefix("file:")) for f in files}
    before = held()
    rows = [payload(LIST_ROW, url="a"), payload(OFFLINE_ROW, "offline", url="c")]
    feed(spark.createDataFrame(rows, PAYLOAD), str(tmp_path / "in"), 1, "url")
    out = str(tmp_path / "out")
    run(J.ingest(J.read_payload_stream(spark, str(tmp_path / "in")), out, F.lit(T0), n_buckets=4, hot_rows=None), tmp_path, "left")
    assert merge.read_notices(spark, out).count() == 2 and held() == before
    with session.temporary(spark):
        kept = session.written(spark.range(5))
        with pytest.raises(ZeroDivisionError), session.temporary(spark):
            session.written(spark.range(3))
            1 / 0
        assert kept.count() == 5 and len([f for f in held() - before if f.endswith(".parquet")]) == len(kept.inputFiles())
    assert held() == before


def test_stored_rows_are_not_copied_before_a_merge(spark, tmp_path, monkeypatch):
    copied, stored = [], buckets.stored
    monkeypatch.setattr(buckets, "stored", lambda df: copied.append(True) or stored(df))
    frame(spark, random_rows(3, 4)).write.parquet(str(tmp_path / "in"))
    rows = spark.read.schema(OBSERVATION).parquet(str(tmp_path / "in"))
    merge.merge_into(str(tmp_path / "a"), rows.filter("kind IS NOT NULL"), "0", 4, hot_rows=None)
    assert not copied
    merge.merge_into(str(tmp_path / "b"), rows.distinct(), "0", 4, hot_rows=None)
    key = lambda path: sorted(map(str, merge.read_notices(spark, str(tmp_path / path)).collect()))
    assert copied and key("a") == key("b")


def test_ingest_archives_parses_and_merges(spark, tmp_path):
    rows = [payload(LIST_ROW, url="a"), payload(b"\x1f\x8bxx", url="b"), payload(OFFLINE_ROW, "offline", url="c")]
    feed(spark.createDataFrame(rows, PAYLOAD), str(tmp_path / "in"), 1, "url")
    out = str(tmp_path / "out")
    source = J.read_payload_stream(spark, str(tmp_path / "in"))
    run(J.ingest(source, out, F.lit(datetime(2027, 4, 1)), n_buckets=4, hot_rows=None), tmp_path, "i")
    assert {r.external_ref for r in merge.read_notices(spark, out).collect()} == {"4400021", "5001"}
    assert [r.url for r in spark.read.parquet(f"{out}/failures").collect()] == ["b"]
    assert spark.read.parquet(f"{out}/archive/blobs").count() == 3
    runs = {r.source_key: r for r in spark.read.parquet(f"{out}/runs").collect()}
    assert (runs["etender"].pages, runs["etender"].parse_failures, runs["etender"].status) == (2, 1, "partial")
    assert (runs["offline"].items_found, runs["offline"].items_new, runs["offline"].rows_dropped) == (1, 1, 0)
    assert runs["offline"].yield_anomaly is False
    held = J.searchable(merge.read_notices(spark, out))
    found = postings.search_notices(f"{out}/postings", held, KEY, "5001")
    assert found.count() == held.filter(search.search_filter("5001")).count()
    assert postings.read(spark, f"{out}/postings").select(*KEY).distinct().count() == 2


def test_a_run_lost_after_the_merge_is_closed_by_the_replay(spark, tmp_path, monkeypatch):
    rows = [payload(LIST_ROW, url="a"), payload(OFFLINE_ROW, "offline", url="c")]
    feed(spark.createDataFrame(rows, PAYLOAD), str(tmp_path / "in"), 1, "url")
    out, close, failed = str(tmp_path / "out"), J.close_run, []

    def dies_once(*args):
        if not failed:
            failed.append(True)
            raise RuntimeError("lost")
        close(*args)

    monkeypatch.setattr(J, "close_run", dies_once)
    job = lambda: J.ingest(J.read_payload_stream(spark, str(tmp_path / "in")), out, F.lit(T0), full_sweep=True, n_buckets=4, hot_rows=None)
    query = J.start(job(), str(tmp_path / "cp"))
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination(600)
    assert merge.read_notices(spark, out).count() == 2
    assert J.start(job(), str(tmp_path / "cp")).awaitTermination(600)
    runs = {r.source_key: (r.items_found, r.items_new, r.yield_anomaly) for r in spark.read.parquet(f"{out}/runs").collect()}
    assert runs == {"etender": (1, 1, False), "offline": (1, 1, False)}
    assert buckets.head(spark, f"{out}/notices").version == 1


def test_counts_come_out_of_the_parse(spark):
    demo = LIST_ROW.replace("</p>", " This is an INVALID tender</p>", 1)
    rows = [payload(LIST_ROW + demo + "<tr><td>end</td></tr>", url="a"), payload(b"\x1f\x8bxx", url="b"),
            payload(OFFLINE_ROW, "offline", url="c"), payload("?", "elsewhere", url="d"), payload(b"\x1f\x8bxx", "elsewhere", url="e")]
    result, counts = parse.parse_counted(spark.createDataFrame(rows, PAYLOAD), F.lit(T0))
    found = {r.source_key: r for r in counts.collect()}
    assert {s: (r.pages, r.parse_failures, r.rows_kept, r.rows_header, r.rows_demonstration) for s, r in found.items()} == {
        "etender": (2, 1, 1, 1, 1), "offline": (1, 0, 1, 0, 0), "elsewhere": (2, 1, 0, 0, 0)}
    assert result.records.count() == 2 and result.failures.count() == 2


def test_blob_files_are_taken_once(spark, tmp_path):
    import gzip

    def put(day, name, body):
        folder = tmp_path / "in" / "etender" / day
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(body)

    out = str(tmp_path / "out")
    for day, name, body in (("2026/01/02", "a.gz", gzip.compress(LIST_ROW.encode())), ("2026/01/02", "b.gz", b"\x1f\x8bxx"),
                            ("2026/01/01", "c.gz", gzip.compress(LIST_ROW.replace("4400021", "4400022").encode())),
                            ("2026/01/02", "notes.txt", b"no blob")):
        put(day, name, body)
        source = archive.stream_blob_files(spark, str(tmp_path / "in"), "etender", "list")
        run(J.ingest(source, out, F.lit(datetime(2027, 4, 1)), n_buckets=4, hot_rows=None, index=False), tmp_path, "blobs")
    log = spark.read.parquet(f"{out}/archive/fetch_log").collect()
    assert sorted(r.url.rpartition("/")[2] for r in log) == ["a.gz", "b.gz", "c.gz"]
    seen = {r.external_ref: r.last_seen_at for r in merge.read_notices(spark, out).collect()}
    assert seen == {"4400021": datetime(2026, 1, 2), "4400022": datetime(2026, 1, 1)}
    assert spark.read.parquet(f"{out}/failures").count() == 1


def test_dedup_within_the_horizon(spark, tmp_path):
    rows = [payload("x", url=str(i)) for i in range(5)] + [payload("y", url="9")]
    feed(spark.createDataFrame(rows, PAYLOAD), str(tmp_path / "in"), 3, "url")
    got = into_memory(spark, J.dedup(stream(spark, PAYLOAD, str(tmp_path / "in"))), "dedup", "append", tmp_path)
    assert got.count() == 2


def test_run_metrics_close_their_windows(spark, tmp_path):
    rows = [("s", T0 + timedelta(minutes=m), o, 1) for m, o in
            [(1, "new"), (29, "changed"), (31, "unchanged"), (40, "failed"), (200, "new")]]
    df = spark.createDataFrame(rows, "source_key string, observed_at timestamp, outcome string, n long")
    feed(df, str(tmp_path / "in"), 5, "observed_at")
    got = into_memory(spark, J.run_metrics(stream(spark, df.schema, str(tmp_path / "in"))), "runs", "append", tmp_path)
    closed = {r.started_at: (r.items_found, r.items_new, r.items_changed, r.parse_failures) for r in got.collect()}
    assert closed == {T0: (2, 1, 1, 0), T0 + timedelta(minutes=30): (2, 0, 0, 1)}
    stored = spark.createDataFrame(got.collect(), got.schema)
    assert [r.yield_anomaly for r in J.yield_alarms(stored).collect()] == [False, False]


def test_subscription_state_equals_the_batch(spark, tmp_path):
    sends = random_sends(5, 120)
    df = spark.createDataFrame(sends, "endpoint string, ts timestamp, seq long, outcome string")
    feed(df.withColumn("o", F.struct("ts", "seq")), str(tmp_path / "in"), 3, "o")
    source = stream(spark, df.withColumn("o", F.struct("ts", "seq")).schema, str(tmp_path / "in")).drop("o")
    got = into_memory(spark, J.subscription_health(source), "health", "update", tmp_path)
    want = health_by_loop(sends)
    seen = {(r.endpoint, r.failure_count, r.retired_at, r.last_success_at) for r in got.collect()}
    assert {(k, *v) for k, v in want.items()} <= seen
    assert {r.endpoint: (r.failure_count, r.retired_at, r.last_success_at)
            for r in accounts.subscription_health(df).collect()} == want


def test_idle_endpoints_leave_the_state(spark, tmp_path):
    day = lambda d: T0 + timedelta(days=d)
    rows = [("a", day(0), 1, "error"), ("a", day(0), 2, "error"), ("b", day(0), 3, "error"), ("b", day(20), 4, "error"),
            ("c", day(40), 5, "ok"), ("b", day(41), 6, "error"), ("a", day(42), 7, "error"), ("c", day(43), 8, "error")]
    schema = "endpoint string, ts timestamp, seq long, outcome string"
    for row in rows:  # one micro-batch each
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counts = {}
    for idle in (30, None):
        source = stream(spark, schema, str(tmp_path / "in"))
        got = into_memory(spark, J.subscription_health(source, idle), f"idle_{idle}", "update", tmp_path)
        counts[idle] = {e: [r.failure_count for r in got.collect() if r.endpoint == e][-1] for e in "abc"}
    assert counts == {30: {"a": 1, "b": 3, "c": 1}, None: {"a": 3, "b": 3, "c": 1}}


def test_verdicts_and_opens_keep_the_right_event(spark, tmp_path):
    rows = [(1, 7, "up", T0), (1, 7, "down", T0 + timedelta(hours=1)), (2, 7, "up", T0)]
    df = spark.createDataFrame(rows, "user_id long, notice_id long, verdict string, created_at timestamp")
    feed(df, str(tmp_path / "in"), 2, "created_at")
    got = into_memory(spark, J.latest_verdicts(stream(spark, df.schema, str(tmp_path / "in"))), "v", "complete", tmp_path)
    assert {(r.user_id, r.verdict) for r in got.collect()} == {(1, "down"), (2, "up")}
    opens = df.select(F.col("notice_id").alias("alert_id"), F.col("created_at").alias("opened_at"))
    feed(opens, str(tmp_path / "in2"), 2, "opened_at")
    got = into_memory(spark, J.first_opens(stream(spark, opens.schema, str(tmp_path / "in2"))), "o", "complete", tmp_path)
    assert [r.opened_at for r in got.collect()] == [T0]


def test_urgent_alerts_go_out_once(spark, tmp_path):
    notices = spark.createDataFrame([(i, "live", f"t{i}", T0 + timedelta(hours=5 + i)) for i in range(4)],
                                    "id long, status string, title string, closing_at timestamp")
    users = spark.createDataFrame([(1, None), (2, T0)], "user_id long, unsubscribed_at timestamp")
    matches = spark.createDataFrame([(1, 0, .1), (1, 1, .9), (2, 1, .5), (1, 1, .9), (1, 2, .2)],
                                    "user_id long, notice_id long, score double")
    feed(matches.withColumn("o", F.monotonically_increasing_id()), str(tmp_path / "in"), 5, "o")
    source = stream(spark, matches.withColumn("o", F.lit(1).cast("long")).schema, str(tmp_path / "in")).drop("o")
    out = str(tmp_path / "alerts")
    run(J.urgent_alerts(source, notices, users, out, "2026-01-01 00:00:00"), tmp_path, "u")
    log = J.alert_log(spark, out)
    assert sorted((r.user_id, i) for r in log.collect() for i in r.notice_ids) == [(1, 0), (1, 1), (1, 2)]
    assert log.filter("sent_at IS NOT NULL").isEmpty()
    # One push fails: its notices are free again, in a later stream with its own checkpoint.
    failed = log.orderBy("alert_id").first()
    spark.createDataFrame([(failed.alert_id, T0, "failed", "gone")], J.OUTCOME).write.mode("append").parquet(f"{out}/outcomes")
    run(J.urgent_alerts(source, notices, users, out, "2026-01-01 00:00:01"), tmp_path, "again")
    sent = sorted((r.user_id, i) for r in J.alert_log(spark, out).collect() for i in r.notice_ids)
    assert sent == sorted([(1, 0), (1, 1), (1, 2)] + [(failed.user_id, i) for i in failed.notice_ids])


def test_a_match_made_early_is_due_once_when_its_last_hours_begin(spark, tmp_path):
    day = lambda d, h=0: T0 + timedelta(days=d, hours=h)
    matches = [(1, 1, .5, day(10), day(0)), (1, 2, .4, day(1), day(0, 1)), (2, 1, .9, day(10), day(0, 2)), (2, 3, .3, None, day(0, 3)),
               (1, 1, .6, day(10), day(9, 12)),  # matched again after it was due
               (3, 5, .2, day(3), day(9)),       # matched after the closing
               (4, 6, .1, day(12), day(1)), (4, 6, .1, day(20), day(2))]  # its closing moved
    schema = "user_id long, notice_id long, score double, closing_at timestamp, matched_at timestamp"
    ticks = [(day(d, 1),) for d in (1, 4, 8, 9, 11, 19, 21)]
    events = sorted([(m[4], 0, m) for m in matches] + [(t[0], 1, t) for t in ticks], key=lambda e: e[:2])
    for i, (_, kind, row) in enumerate(events):  # one file each, in order of time
        for k, (name, fields) in enumerate((("m", schema), ("t", "at timestamp"))):
            spark.createDataFrame([row] if k == kind else [], fields).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    source = lambda name, fields: stream(spark, fields, str(tmp_path / name))
    got = into_memory(spark, J.due_matches(source("m", schema), source("t", "at timestamp")), "due", "append", tmp_path)
    rows = {(r.user_id, r.notice_id): (r.due_at, round(r.score, 1)) for r in got.collect()}
    assert got.count() == len(rows) == 4
    assert rows[1, 1] == (day(8, 1), .5) and rows[2, 1] == (day(8, 1), .9)
    assert rows[4, 6] == (day(19, 1), .1) and (1, 2) in rows


def test_due_alerts_are_written_once(spark, tmp_path):
    schema = "user_id long, notice_id long, score double, closing_at timestamp, matched_at timestamp"
    notices = spark.createDataFrame([(i, "live", f"t{i}", T0 + timedelta(days=5)) for i in (1, 2)],
                                    "id long, status string, title string, closing_at timestamp")
    users = spark.createDataFrame([(1, None), (2, T0)], "user_id long, unsubscribed_at timestamp")
    rows = [(u, n, .5, T0 + timedelta(days=5), T0) for u in (1, 2) for n in (1, 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "m"))
    for d in (1, 4, 4.5):
        spark.createDataFrame([(T0 + timedelta(days=d),)], "at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    out = str(tmp_path / "alerts")
    for name in ("one", "two"):  # a stream that starts anew meets its own alerts
        run(J.alerts_when_due(stream(spark, schema, str(tmp_path / "m")), stream(spark, "at timestamp", str(tmp_path / "t")),
                              notices, users, out), tmp_path, name)
    log = J.alert_log(spark, out).collect()
    assert [(r.user_id, sorted(r.notice_ids)) for r in log] == [(1, [1, 2])] and log[0].created_at == T0 + timedelta(days=4)


def test_stages_fail_alone():
    done = []
    errors = J.run_stages({"a": lambda: done.append("a"), "b": lambda: 1 / 0, "c": lambda: done.append("c")})
    assert done == ["a", "c"] and errors["a"] is None and errors["b"].startswith("ZeroDivisionError")


def test_daily_chain_twice(spark, tables, tmp_path):
    corpus, profiles = tables.corpus().limit(60), tables.profiles().limit(5)
    users = profiles.select("user_id", F.lit(None).cast("timestamp").alias("unsubscribed_at"),
                            F.lit("a@b.c").alias("email"), F.lit(T0).alias("verified_at"))
    verdicts = spark.createDataFrame([], "user_id long, notice_id long, verdict string")
    path = str(tmp_path)
    log = lambda: J.alert_log(spark, f"{path}/alerts")
    for as_of in ("1998-01-01 00:00:00", "1998-01-02 00:00:00", "1998-01-03 00:00:00"):
        errors = D.daily(spark, path, corpus, profiles, users, verdicts, as_of, n_buckets=4)
        assert set(errors.values()) == {None}, errors
        fresh = log().filter(F.col("batch") == as_of[:10])
        outcome = "failed" if as_of < "1998-01-02" else "sent"
        fresh.select("alert_id", F.lit(as_of).cast("timestamp").alias("ts"), F.lit(outcome).alias("outcome"),
                     F.lit(None).cast("string").alias("error")).write.mode("append").parquet(f"{path}/alerts/outcomes")
    days = {d: {(r.user_id, i) for r in log().filter(F.col("batch") == d).collect() for i in r.notice_ids}
            for d in ("1998-01-01", "1998-01-02", "1998-01-03")}
    # The first day's mail failed and comes back, unless better matches came up; what was sent does not.
    assert days["1998-01-01"] & days["1998-01-02"] and not days["1998-01-02"] & days["1998-01-03"]


def test_a_fed_batch_is_several_files_and_batches_keep_the_order_of_time(spark, tmp_path):
    from noticelake.plans.streams import fed, updates

    rows = spark.range(0, 6000, 1, 8).select("id", F.timestamp_seconds("id").alias("at"))
    out = updates(fed(rows, str(tmp_path / "in"), "at"), str(tmp_path), "append")
    files = len(list((tmp_path / "in").glob("*.parquet")))
    spans = sorted((r.batch, r.low, r.high) for r in out.groupBy("batch").agg(
        F.min("id").alias("low"), F.max("id").alias("high")).collect())
    assert files > 3 and [s[0] for s in spans] == [0, 1, 2] and out.count() == 6000
    assert spans[0][2] < spans[1][1] and spans[1][2] < spans[2][1]


def test_blobs_are_files_of_bounded_size(spark, sf, tmp_path, monkeypatch):
    from noticelake.plans import streams as S

    monkeypatch.setattr(S, "PAGES_PER_BLOB", 5)
    monkeypatch.setattr(S, "scratch", lambda spark: str(tmp_path))
    found = S.CATALOG["blob_files"].run(S.Tables(spark, sf))
    assert found.count() == S.Tables(spark, sf).notices().count()
    blobs = spark.read.option("wholetext", True).text(str(tmp_path / "etender/1998/01/02"))
    rows = blobs.select((F.size(F.split("value", "<tr")) - 1).alias("n"))  # a page has ten
    assert rows.agg(F.max("n")).first()[0] <= 50
