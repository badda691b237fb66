"""Named queries that run the streaming jobs, the exports and the stored index over files
made from the test tables, each beside the SQL of the same result."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticelake.operators import browse, embedding, matching, merge, postings, search
from noticelake.plans.catalog import AS_OF, CATALOG, Entry, _pairs, as_of, dbl, query, stamp
from noticelake.plans.oracle import ts
from noticelake.plans.proxies import Tables
from noticelake.schemas import AWARD, PAYLOAD, TABLES
from noticelake.session import checkpoint_folder, temporary, written
from noticelake.sources import archive, buckets, parse, tables
from noticelake.streaming import jobs

C = F.col


def scratch(spark: SparkSession) -> str:
    """A new folder where all executors can write."""
    return f"{checkpoint_folder(spark)}/run-{uuid.uuid4().hex}"


def fed(df: DataFrame, folder: str, by: str, parts: int = 3) -> DataFrame:
    """The rows as a stream that gets them in ``parts`` batches, in the order of a time.

    A batch is as many files as the stream takes at a time, the same number for each, so
    that no task writes or reads a whole batch."""
    spark, at = df.sparkSession, F.col(by).cast("double")
    with temporary(spark):
        if parts == 1:  # as many files as there are
            df.write.parquet(folder)
            files = len(spark.read.schema(df.schema).parquet(folder).inputFiles())
        else:
            df = written(df)
            bounds = df.select(at.alias("at")).approxQuantile("at", [k / parts for k in range(1, parts)], 0.001)
            mine = [(F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)
                    for low, high in zip([None, *bounds], [*bounds, None])]
            sizes = df.agg(*[F.count_if(m).alias(str(i)) for i, m in enumerate(mine)]).first()
            read = df.rdd.getNumPartitions()
            # Rows are dealt in turn, and one of the partitions has its share: no file stays empty.
            files = max(1, min(read, min(sizes) // max(1, read)))
            for m in mine:
                df.filter(m).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files)).parquet(folder)


#: A blob is a file of some pages, as a fetch brings them: with more pages there are more files.
PAGES_PER_BLOB = 500


def finished(writer, folder: str) -> None:
    query_ = jobs.start(writer, f"{folder}/checkpoint")
    query_.awaitTermination()
    if query_.exception():
        raise query_.exception()


def updates(df: DataFrame, folder: str, mode: str) -> DataFrame:
    """What a stream put out, with the number of its batch."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    finished(df.writeStream.outputMode(mode).foreachBatch(keep), folder)
    return df.sparkSession.read.parquet(f"{folder}/out")


def newest(out: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in out.columns if c not in (*keys, "batch", "part")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


# --------------------------------------------------------------------- streams

def _stream_merge(t: Tables) -> DataFrame:
    folder = scratch(t.spark)
    source = fed(parse.as_observations(t.observations()), f"{folder}/in", "observed_at", 2)
    finished(jobs.merge_stream(source, f"{folder}/tables", n_buckets=8, always_latest=(), hot_rows=None), folder)
    return merge.read_notices(t.spark, f"{folder}/tables").select(
        "source_key", "external_ref", "title", "package_no", "description", "district",
        dbl("tender_security").alias("tender_security"), stamp("closing_at").alias("closing_at"),
        "status", "canonical_hash", stamp("last_seen_at").alias("last_seen_at"),
        C("version_no").cast("long").alias("version_no"))


CATALOG["stream_merge_current"] = Entry(_stream_merge, CATALOG["merge_current"].oracle)


@query("stream_ingest", """
SELECT 'notice' AS what, 'etender' AS source_key, external_ref AS ref, 1 AS n FROM notices
UNION ALL SELECT 'notice', 'offline', external_ref, 1 FROM notices
UNION ALL SELECT 'award', 'awards', l_orderkey || '/' || l_linenumber || '/' || s_name, 1
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 1)
UNION ALL SELECT 'run', 'etender', 'ok', count(*) FROM notices
UNION ALL SELECT 'run', 'offline', 'ok', count(*) FROM notices
UNION ALL SELECT 'run', 'awards', 'ok', 0""")
def _(t):
    folder = scratch(t.spark)
    pages = t.list_payloads().unionByName(t.offline_payloads()).unionByName(t.award_payloads())
    names = [f.name for f in PAYLOAD.fields]
    source = fed(pages.select(*[C(n).cast(PAYLOAD[n].dataType).alias(n) for n in names]), f"{folder}/in", "fetched_at", 1)
    finished(jobs.ingest(source, f"{folder}/tables", as_of(), n_buckets=8, hot_rows=None, index=False), folder)
    runs = t.spark.read.parquet(f"{folder}/tables/runs").groupBy("source_key").agg(
        F.sum("items_found").alias("n"), F.max("status").alias("ref"))
    held = buckets.read(t.spark, f"{folder}/tables/awards", AWARD)
    one = lambda df, what, ref, n: df.select(F.lit(what).alias("what"), "source_key", ref.alias("ref"), n.cast("long").alias("n"))
    return (one(merge.read_notices(t.spark, f"{folder}/tables"), "notice", C("external_ref"), F.lit(1))
            .unionByName(one(held, "award", F.concat_ws("/", "tender_external_ref", "pkg_lot_id", "winner"), F.lit(1)))
            .unionByName(one(runs, "run", C("ref"), C("n"))))


@query("stream_latest_verdicts", f"SELECT user_id, notice_id, verdict, {ts('created_at')} AS created_at FROM verdicts")
def _(t):
    folder = scratch(t.spark)
    out = updates(jobs.latest_verdicts(fed(t.feedback(), f"{folder}/in", "created_at")), folder, "update")
    return newest(out, ["user_id", "notice_id"]).select("user_id", "notice_id", "verdict", stamp("created_at").alias("created_at"))


@query("stream_first_opens", f"SELECT user_id % 50 AS alert_id, {ts('min(ts)')} AS opened_at FROM events WHERE event_type = 'view' GROUP BY ALL")
def _(t):
    folder = scratch(t.spark)
    opens = t.raw("events").filter("event_type = 'view'").select(
        (C("user_id") % 50).alias("alert_id"), C("ts").cast("timestamp").alias("opened_at"))
    out = updates(jobs.first_opens(fed(opens, f"{folder}/in", "opened_at")), folder, "update")
    return newest(out, ["alert_id"]).select("alert_id", stamp("opened_at").alias("opened_at"))


def _stream_health(t: Tables) -> DataFrame:
    folder = scratch(t.spark)
    out = updates(jobs.subscription_health(fed(t.sends(), f"{folder}/in", "ts")), folder, "update")
    return newest(out, ["endpoint"]).select("endpoint", "failure_count", stamp("retired_at").alias("retired_at"),
                                            stamp("last_success_at").alias("last_success_at"))


CATALOG["stream_subscription_health"] = Entry(_stream_health, CATALOG["subscription_health"].oracle)


@query("stream_run_metrics", f"""
SELECT source_key, {ts('started_at')} AS started_at, count(*) AS items_found, count(*) FILTER (outcome = 'new') AS items_new,
  count(*) FILTER (outcome = 'failed') AS parse_failures
FROM (SELECT event_type AS source_key, time_bucket(INTERVAL 30 MINUTE, ts) AS started_at,
    CASE WHEN event_id % 3 = 0 THEN 'new' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'unchanged' END AS outcome FROM events)
WHERE started_at + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE GROUP BY ALL""")
def _(t):
    folder, k = scratch(t.spark), C("event_id")
    outcomes = t.raw("events").select(
        C("event_type").alias("source_key"), C("ts").cast("timestamp").alias("observed_at"),
        F.when(k % 3 == 0, "new").when(k % 7 == 0, "failed").otherwise("unchanged").alias("outcome"), F.lit(1).cast("long").alias("n"))
    out = updates(jobs.run_metrics(fed(outcomes, f"{folder}/in", "observed_at")), folder, "append")
    return out.select("source_key", stamp("started_at").alias("started_at"), "items_found", "items_new", "parse_failures")


@query("stream_dedup", """
SELECT DISTINCT 'site' || page_id % 3 AS source_key, sha256(html) AS content_hash FROM pages""")
def _(t):
    folder, p = scratch(t.spark), t.page_payloads()
    twice = p.unionByName(p.withColumn("fetched_at", C("fetched_at") + F.expr("INTERVAL 1 SECOND")))
    out = updates(jobs.dedup(fed(twice, f"{folder}/in", "fetched_at"), "3000 days"), folder, "append")
    return out.select("source_key", "content_hash")


# ----------------------------------------------------------------- files

@query("exported_copies", """
SELECT 'feedback' AS table_name, count(*) AS left_rows, count(*) AS right_rows, 'OK' AS result FROM events
  WHERE event_type IN ('purchase', 'error')
UNION ALL SELECT 'awards', count(*), count(*), 'OK' FROM awards""")
def _(t):
    folder, data = scratch(t.spark), {"feedback": t.feedback(), "awards": t.awards()}
    tables.irreplaceable_export(data, folder, "1998-01-01")
    return tables.reconcile(data, {n: t.spark.read.parquet(f"{folder}/1998-01-01/{n}") for n in data})


@query("scan_observations", """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'offline' ELSE 'etender' END AS source_key, k AS sweep, count(*) AS n,
  count(*) FILTER ((o_orderkey + k) % 4 = 2) AS details FROM orders, range(0, 4) r(k) GROUP BY ALL""")
def _(t):
    folder = scratch(t.spark)
    parse.as_observations(t.observations()).write.parquet(f"{folder}/observations")
    rows = tables.read_table(t.spark, folder, "observations")
    if rows.schema.fieldNames() != TABLES["observations"].fieldNames():
        raise ValueError("not the declared columns")
    return rows.groupBy("source_key", (C("raw_document_id") % 4).alias("sweep")).agg(
        F.count("*").alias("n"), F.count_if(C("kind") == "detail").alias("details"))


@query("blob_files", "SELECT external_ref, '1998-01-02 00:00:00' AS observed_at FROM notices")
def _(t):
    folder = scratch(t.spark)
    pages = t.list_payloads().select(F.decode("content", "UTF-8").alias("value"))
    pages.write.option("compression", "gzip").option("maxRecordsPerFile", PAGES_PER_BLOB).text(f"{folder}/etender/1998/01/02")
    blobs = archive.read_blob_files(t.spark, folder, "etender", "list")
    records = parse.parse_payloads(blobs, as_of()).records
    return records.select("external_ref", stamp("observed_at").alias("observed_at"))


@query("stream_blob_files", """
SELECT external_ref, '1998-01-0' || (2 + id // 10 % 2) || ' 00:00:00' AS last_seen_at, 1 AS version_no FROM notices""")
def _(t):
    folder, pages = scratch(t.spark), t.list_payloads()
    for day in (2, 3):  # the second day's files come after a restart
        mine = pages.filter(C("run_id") % 2 == day - 2).select(F.decode("content", "UTF-8").alias("value"))
        mine.write.option("compression", "gzip").option("maxRecordsPerFile", PAGES_PER_BLOB).text(f"{folder}/in/etender/1998/01/0{day}")
        blobs = archive.stream_blob_files(t.spark, f"{folder}/in", "etender", "list")
        finished(jobs.ingest(blobs, f"{folder}/tables", as_of(), n_buckets=8, hot_rows=None, index=False), folder)
    return merge.read_notices(t.spark, f"{folder}/tables").select(
        "external_ref", stamp("last_seen_at").alias("last_seen_at"), C("version_no").cast("long").alias("version_no"))


# ----------------------------------------------------------- stored index

@functools.cache
def _index(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The postings of a table, stored once per session in three batches: most notices, all
    notices with some still in an earlier version, all as they are."""
    folder, rows = scratch(spark), getattr(Tables(spark, sf_dir), name)()
    postings.add(folder, rows.filter("id % 3 <> 0"), ["id"], "a", 16)
    postings.add(folder, rows.withColumn("title", F.when(C("id") % 5 == 0, "earlier title").otherwise(C("title"))), ["id"], "b", 16)
    postings.add(folder, rows, ["id"], "c", 16)
    return folder


def _searched(t: Tables, name: str, q: str) -> DataFrame:
    rows = getattr(t, name)()
    return postings.search_notices(_index(t.spark, t.dir, name), rows, ["id"], q).filter("status = 'live'")


CATALOG["indexed_search_words"] = Entry(lambda t: _searched(
    t, "notices", 'machinery lot -urgent or "supply for customer" nation_3').select("id"), CATALOG["search_words"].oracle)


def _indexed_page(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    order = [F.desc("rank"), C("closing_at").asc_nulls_last(), C("id")]
    top = _searched(t, "corpus", "the and").orderBy(*order).limit(browse.PER_PAGE)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("id", "position")


CATALOG["indexed_search_page"] = Entry(_indexed_page, CATALOG["search_page"].oracle)


@query("indexed_search_fragment", """
SELECT id, reference_no FROM notices WHERE status = 'live' AND (contains(lower(reference_no), '/12')
  OR contains(lower(coalesce(package_no, '')), '/12'))""")
def _(t):
    return _searched(t, "notices", "/12").filter(
        search.substring(C("reference_no"), "/12") | F.coalesce(search.substring(C("package_no"), "/12"), F.lit(False))).select("id", "reference_no")


def _indexed_keywords(t: Tables) -> DataFrame:
    words = matching.profile_keywords(embedding.profile_texts(t.profiles()))
    counts = postings.word_counts(_index(t.spark, t.dir, "corpus"), words, t.corpus())
    return matching.keyword_arm(_pairs(t), counts, words).select(
        "user_id", "notice_id", C("hits").cast("long").alias("hits"), "keyword_position")


CATALOG["indexed_keyword_arm"] = Entry(_indexed_keywords, CATALOG["keyword_arm"].oracle)
