"""Searches through stored postings against the scan of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from noticelake.operators import matching, postings as P, search
from noticelake.sources import buckets

SCHEMA = ("id long, title string, description string, package_no string, reference_no string, organization_path string, "
          "district string, project_name string, status string")
WORDS = ["road", "bridge", "supply", "of", "water", "pump", "পানি", "works", "lot", "x1", "urgent"]


def notices(spark, seed, n=120, salt=""):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) for _ in range(r.randint(0, k))) or None
    rows = [(i, text(6), text(12), r.choice([None, f"PK/{i}", "A-road"]), f"REF-{i * 37 % 1000}{salt}", text(2), r.choice(["Dhaka", None]),
             text(2), "live") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


QUERIES = ["road", "road bridge", '"supply of water"', "road -urgent", 'pump or "lot x1"', '"of of" -road', "ref-1", "PK/11", "/1", "-road",
           "পানি works", "nothing", "a-ROAD", '"road bridge" or water -pump', "road road", "12"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("postings")), notices(spark, 1)
    assert P.add(path, rows.filter("id < 100"), ["id"], "first", 8) and not P.add(path, rows.filter("id < 100"), ["id"], "first", 8)
    # The second batch brings new notices and changes some, the third changes nothing.
    now = rows.filter("id >= 10").unionByName(notices(spark, 2, 10, "z"))
    P.add(path, now, ["id"], "second", 8)
    P.add(path, now, ["id"], "third", 8)
    return path, now


def result(df):
    return {r.id: round(r.rank, 6) for r in df.select("id", "rank").collect()}


def scanned(rows, q):
    return result(rows.filter(search.search_filter(q)).withColumn("rank", search.rank(search.tokens(search.document()), q)))


@pytest.mark.parametrize("q", QUERIES)
def test_searches_find_what_a_scan_finds(index, q):
    path, now = index
    assert result(P.search_notices(path, now, ["id"], q)) == scanned(now, q)


def test_only_changed_notices_are_indexed_again(spark, index):
    path, now = index
    counts = {r.segment: r.n for r in spark.read.parquet(f"{path}/segments").groupBy("segment").agg(
        F.count_distinct("id").alias("n")).collect()}
    assert counts == {"first": 100, "second": 30}


def test_a_search_reads_the_buckets_of_its_terms_and_splits_no_text(spark, index):
    path, now = index
    mine = {r.b for r in spark.createDataFrame([("road",), ("#roa",), ("#oad",)], "term string").select(
        buckets.bucket_of(["term"], 8).alias("b")).collect()}
    read = P.read(spark, path, ["road", "#roa", "#oad"]).inputFiles()
    assert read and all(int(f.split("/bucket=")[1].split("/")[0]) in mine for f in read)
    plan = P.search_notices(path, now, ["id"], "road bridge")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_counts_of_words_without_texts(spark, index):
    path, now = index
    keywords = spark.createDataFrame([(1, "road"), (1, "পানি"), (2, "pump"), (2, "none")], "user_id long, word string")
    key = lambda df: {r.notice_id: dict(r.counts) for r in df.collect()}
    assert key(P.word_counts(path, keywords, now)) == key(matching.word_counts(now, keywords))


def test_compaction_keeps_results_and_drops_former_content(spark, index):
    path, now = index
    name = P.compact(spark, path, now.schema, ["id"])
    assert P._segments(spark, path) == [name]
    assert spark.read.parquet(f"{path}/segments/segment={name}").select("id", "digest").distinct().count() == 120
    for q in QUERIES[:4]:
        assert result(P.search_notices(path, now, ["id"], q)) == scanned(now, q)


def test_a_lost_segment_is_not_read(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path), notices(spark, 3, 20)
    P.add(path, rows.filter("id < 10"), ["id"], "a", 4)
    with monkeypatch.context() as m:
        m.setattr(buckets, "change", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            P.add(path, rows, ["id"], "b", 4)
    assert set(result(P.search_notices(path, rows, ["id"], "ref-"))) == set(range(10))
    P.add(path, rows, ["id"], "b", 4)
    assert set(result(P.search_notices(path, rows, ["id"], "ref-"))) == set(range(20))


def test_words_of_a_notice_are_grouped_without_a_shuffle(spark):
    rows = notices(spark, 3)
    found = P.postings(rows, ["id"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for r in rows.select("id", search.tokens(search.document()).alias("words")).collect():
        for i, w in enumerate(r.words):
            want.setdefault((r.id, w), []).append(i)
    got = [((r.id, r.term), r.positions) for r in found.filter("NOT startswith(term, '#')").collect()]
    assert len(got) == len(want) and dict(got) == want
    grams = found.filter("startswith(term, '#')").groupBy("id", "term").count()
    assert grams.count() > 0 and grams.filter("count > 1").isEmpty()


def test_segments_are_written_without_shuffling_postings(spark, tmp_path, monkeypatch):
    path, rows, plans, kept = str(tmp_path), notices(spark, 5, 60), [], P._write_segment
    monkeypatch.setattr(P, "_write_segment", lambda path, rows, *rest: plans.append(
        rows._jdf.queryExecution().optimizedPlan().toString()) or kept(path, rows, *rest))
    P.add(path, rows, ["id"], "a", 4)
    # The notices are dealt before their words are split.
    assert "Rebalance" not in plans[0] and plans[0].index("Generate explode") < plans[0].index("Repartition 1, true")
    P.compact(spark, path, rows.schema, ["id"])
    assert "Rebalance" in plans[1] and result(P.search_notices(path, rows, ["id"], "road")) == scanned(rows, "road")
    monkeypatch.setattr(P, "TASKS", 2)
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().partition("\n")[0]
    big = spark.range(0, 5 << 20, 1, 8).select((F.col("id") * 7).alias("id"))  # 40 MB in 8 bytes a row
    assert size(P._dealt(big)).startswith("Repartition 5, true")
