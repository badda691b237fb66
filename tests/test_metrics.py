from datetime import date

from pyspark.sql import functions as F

from noticelake.operators import metrics


def matches(spark, n, users):
    by = F.element_at(F.array(F.lit("both"), F.lit("semantic"), F.lit("keyword")), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(n).select((F.col("id") * 7919 % users).alias("user_id"), F.struct(by.alias("matched_by")).alias("reasons"),
                                 F.date_add(F.lit(date(2026, 1, 1)), (F.col("id") % 9).cast("int")).alias("day"))


def test_days_add_up_within_the_error(spark, tmp_path):
    rows = matches(spark, 60_000, 20_011)
    metrics.daily_match_mix(rows, F.col("day")).write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    assert days.count() == 9 and days.agg(F.max(F.length("users"))).first()[0] < 10_000
    exact, found = metrics.match_mix(rows).first(), metrics.match_mix_of_days(days).first()
    assert (found.total, found.both, found.semantic, found.keyword) == (exact.total, exact.both, exact.semantic, exact.keyword)
    assert abs(found.users_with_matches - exact.users_with_matches) < 4 * 0.0163 * exact.users_with_matches
    some = metrics.match_mix_of_days(days.filter("day < '2026-01-03'")).first()
    assert some.total == rows.filter("day < '2026-01-03'").count() and some.users_with_matches < found.users_with_matches


def test_days_of_few_users_are_exact(spark):
    rows = matches(spark, 3_000, 150).union(matches(spark, 2, 2).selectExpr("CAST(NULL AS bigint)", "reasons", "CAST(NULL AS date)"))
    days = metrics.daily_match_mix(rows, F.col("day"))
    assert days.count() == 10
    assert metrics.match_mix_of_days(days).first().users_with_matches == 150
    assert tuple(metrics.match_mix_of_days(days.limit(0)).first()) == (0, 0, 0, 0, 0)
