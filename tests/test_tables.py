"""Snapshots, exports, embedding jobs, awards and alert rows."""

from datetime import datetime
from decimal import Decimal as D

from pyspark.sql import functions as F

from noticelake.operators import alerts, awards, browse, embedding, metrics
from noticelake.schemas import AWARD, RUN
from noticelake.sources import buckets, tables
from noticelake.session import cut_lineage

T0 = datetime(2026, 1, 1)


def test_checkpoints_go_to_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert folder in spark.sparkContext.getCheckpointDir()


def test_run_log_is_append_only(spark, tmp_path):
    run = spark.createDataFrame([(1, "s", T0, T0, "ok", 5, 1, 0, 1, 0, True, False, None)], RUN)
    for _ in range(2):
        metrics.append_run(str(tmp_path / "runs"), run)
    stored = spark.read.schema(RUN).parquet(str(tmp_path / "runs"))
    assert stored.count() == 2 and metrics.last_success(stored).first().last_success_at == T0


def test_export_writes_dated_copies_that_reconcile(spark, tmp_path):
    data = {"users": spark.range(4), "feedback": spark.range(0)}
    tables.irreplaceable_export(data, str(tmp_path), "2026-01-01")
    copies = {n: spark.read.parquet(f"{tmp_path}/2026-01-01/{n}") for n in data}
    assert {r.result for r in tables.reconcile(data, copies).collect()} == {"OK"}


def test_vectorizer_is_loaded_per_worker_and_sees_batches(spark):
    todo = spark.createDataFrame([(i, "ab" * i, "d") for i in range(1, 200)], "id long, text string, text_digest string")

    def vectorizer():
        def encode(texts):
            assert len(texts) <= embedding.BATCH
            return [[float(len(t)), 1.0] for t in texts]
        return encode

    rows = embedding.embed(todo, vectorizer, "m").collect()
    assert {(r.id, tuple(r.embedding), r.model) for r in rows} == {(i, (2.0 * i, 1.0), "m") for i in range(1, 200)}


def test_changed_text_or_model_is_embedded_again(spark):
    notices = spark.createDataFrame([(i, f"t{i}", None, "live", T0) for i in range(4)],
                                    "id long, title string, description string, status string, published_at timestamp")
    held = embedding.embed(embedding.needs_embedding(notices, spark.createDataFrame(
        [], "id long, model string, text_digest string")))
    changed = notices.withColumn("title", F.when(F.col("id") == 2, "new").otherwise(F.col("title")))
    assert [r.id for r in embedding.needs_embedding(changed, held).collect()] == [2]
    assert embedding.needs_embedding(notices, held, model="other").count() == 4
    assert embedding.needs_embedding(notices, held, model="other", limit=3).count() == 3


def test_repeated_award_pages_add_nothing(spark):
    row = lambda lot, winner: ("a", "1", lot, None, None, None, "E", None, None, winner, D("1.0"), T0, T0, None, 1)
    batch = spark.createDataFrame([row("1", "W"), row(None, "W"), row(None, "W"), row("1", "V")], AWARD)
    first = awards.new_awards(None, batch)
    assert first.count() == 3 and awards.new_awards(first, batch).isEmpty()


def test_award_table_takes_each_award_once(spark, tmp_path):
    row = lambda lot, winner: ("a", "1", lot, None, None, None, "E", None, None, winner, D("1.0"), T0, T0, None, 1)
    path = str(tmp_path)
    for name, lots in (("b1", ["1", None]), ("b2", ["1", None, "2"]), ("b2", ["1", None, "2"]), ("b3", ["2"])):
        awards.insert_into(path, spark.createDataFrame([row(x, "W") for x in lots], AWARD), name)
    held = buckets.read(spark, f"{path}/awards", AWARD)
    assert sorted(str(r.pkg_lot_id) for r in held.collect()) == ["1", "2", "None"]
    new = {r.batch: r.n for r in spark.read.parquet(f"{path}/new_awards").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert new == {"b1": 2, "b2": 1}


def test_big_alert_groups_keep_every_id(spark):
    urgent = spark.range(2500).select(F.lit(1).alias("user_id"), F.col("id").alias("notice_id"),
                                      (F.col("id") % 7).cast("double").alias("score"),
                                      F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"))
    [row] = alerts.group_alert_ids(urgent).collect()
    assert row.notice_ids == sorted(range(2500), key=lambda i: (-(i % 7), i))
    assert (row.total, row.top_notice_id, row.body) == (2500, 6, "t6")
    assert row.title == "Closing soon: 2500 tenders for you"


def test_paging_limits():
    assert browse.rows_of(browse.Request(size=5_000, page=-2)) == (0, 100)
    assert browse.rows_of(browse.Request(size=-3, page=4)) == (3, 1) and browse.rows_of(browse.Request(page=7)) == (150, 25)


def test_sitemap_of_the_newest(spark, tmp_path):
    notices = spark.range(500).select(
        "id", F.lit("live").alias("status"), F.lit("A b").alias("district"), F.lit("Org & Co").alias("organization_path"),
        F.timestamp_seconds(F.col("id") % 50).alias("first_seen_at"), F.timestamp_seconds(F.col("id")).alias("last_seen_at"))
    browse.write_sitemap(notices, str(tmp_path / "s"), limit=20)
    locs = [r["loc"] for r in spark.read.parquet(str(tmp_path / "s")).collect()]
    assert len(locs) == 25 and "/tenders/district/A%20b" in locs and "/tenders/organization/org-co" in locs
    assert {x for x in locs if x[9:].isdigit()} == {f"/tenders/{i}" for m in (49, 48) for i in range(m, 500, 50)}


def test_tasks_of_large_shuffles_stay_small(spark):
    from noticelake.session import tune

    other = tune(spark.newSession())
    other.conf.set("spark.sql.shuffle.partitions", "64")
    noise = F.concat(*[F.unhex(F.sha2(F.concat("id", F.lit(f"-{i}")), 256)) for i in range(8)])
    rows = other.range(0, 400_000, 1, 8).select("id", noise.alias("noise"))
    tasks = rows.repartition("id").select(F.length("noise").alias("n"), F.spark_partition_id().alias("task")).groupBy("task").agg(
        F.sum("n").alias("bytes")).collect()
    assert sum(t.bytes for t in tasks) == 400_000 * 256 and max(t.bytes for t in tasks) < 10e6
