"""Row filters over notices, accounts and runs. All are plain predicates that
Catalyst pushes into the scan; ``as_of`` replaces the clock everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from noticelake.functions.values import STALE_DAYS, TEST_RECORD_PHRASES
from noticelake.functions.text import contains_any
from noticelake.schemas import AMENDMENT_TYPES

MIN_HOURS_TO_CLOSING = 24
MAX_DAYS_TO_CLOSING = 90


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def timestamp(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def test_record(title: Column, description: Column) -> Column:
    return contains_any(F.lower(F.concat_ws(" ", description, title)), TEST_RECORD_PHRASES)


def exclude_test_records(notices: DataFrame) -> DataFrame:
    return notices.filter(~test_record(F.col("title"), F.col("description")))


def excluded_test_records(notices: DataFrame) -> DataFrame:
    """What the filter removed, for review: an over-match would hide real notices."""
    return notices.filter(test_record(F.col("title"), F.col("description")))


def closing_window(closing_at: Column, bucket: str, as_of: Column) -> Column:
    """today = [now, +1 d), week = [now, +7 d), open = from now on."""
    ends = {"today": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS"}
    start = closing_at >= as_of
    return start if bucket == "open" else start & (closing_at < as_of + F.expr(ends[bucket]))


def matchable(as_of: Column, min_hours: int = MIN_HOURS_TO_CLOSING,
              max_days: int = MAX_DAYS_TO_CLOSING) -> Column:
    """Live and closing neither too soon to act on nor too far out."""
    return ((F.col("status") == "live")
            & (F.col("closing_at") >= as_of + F.expr(f"INTERVAL {min_hours} HOURS"))
            & (F.col("closing_at") <= as_of + F.expr(f"INTERVAL {max_days} DAYS")))


def hard_filter(notices: DataFrame, as_of: str, districts: list[str] = (), natures: list[str] = (),
                methods: list[str] = (), min_security=None, max_security=None,
                min_hours: int = MIN_HOURS_TO_CLOSING,
                max_days: int = MAX_DAYS_TO_CLOSING) -> DataFrame:
    """Eligibility filter of one profile; an empty constraint constrains nothing,
    and an unknown district or security passes."""
    wanted = [matchable(timestamp(as_of), min_hours, max_days)]
    if districts:
        wanted.append(F.col("district").isin(list(districts)) | F.col("district").isNull())
    if natures:
        wanted.append(F.col("procurement_nature").isin(list(natures)))
    if methods:
        wanted.append(F.col("procurement_method").isin(list(methods)))
    security = F.col("tender_security")
    if min_security is not None:
        wanted.append(security.isNull() | (security >= min_security))
    if max_security is not None:
        wanted.append(security.isNull() | (security <= max_security))
    return notices.filter(all_of(wanted))


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == value)


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    return users.filter(F.lower("email") == email.strip().lower())


def amendments(versions: DataFrame, amendments_only: bool = True) -> DataFrame:
    """What the procuring entity changed; our own catching up is left out."""
    return versions.filter(F.col("change_type").isin(*AMENDMENT_TYPES)) if amendments_only else versions


def notice_history(versions: DataFrame, key: dict[str, str], amendments_only: bool = True) -> DataFrame:
    """Amendment history of one notice, newest first."""
    chosen = amendments(versions, amendments_only)
    for column, value in key.items():
        chosen = chosen.filter(F.col(column) == value)
    return chosen.orderBy(F.desc("version_no"))


def active_users(users: DataFrame) -> DataFrame:
    return users.filter("unsubscribed_at IS NULL")


def digest_recipients(users: DataFrame) -> DataFrame:
    return users.filter("unsubscribed_at IS NULL AND email IS NOT NULL AND verified_at IS NOT NULL")


def active_subscriptions(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.filter("retired_at IS NULL")


def needs_detail(notices: DataFrame, limit: int = 200) -> DataFrame:
    """Per source, the newest live notices whose detail page was never seen."""
    order = Window.partitionBy("source_key").orderBy(
        F.col("published_at").desc_nulls_last(), F.col("external_ref"))
    return (notices.filter("detail_fetched_at IS NULL AND status = 'live'")
            .withColumn("position", F.row_number().over(order))
            .filter(F.col("position") <= limit))


def stale(as_of: Column, source_key: str = "offline") -> Column:
    """Offline live notices without a closing date that are too old to be open."""
    return ((F.col("source_key") == source_key) & (F.col("status") == "live")
            & F.col("closing_at").isNull()
            & (F.col("published_at").isNull()
               | (F.col("published_at") < as_of - F.expr(f"INTERVAL {STALE_DAYS} DAYS"))))


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("is_enabled").select("source_key", "crawl_interval_min")
