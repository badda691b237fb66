"""Selecting what to send: digests and urgent alerts, never the same twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from noticelake.functions.text import truncated
from noticelake.operators.filters import timestamp

DIGEST_LIMIT, PROFILE_LIMIT = 10, 20
URGENT_HOURS = 48
MAX_TITLE, MAX_BODY, MAX_ALERT_ERROR = 80, 160, 1000
# Wording of an urgent alert.
TITLE_ONE, TITLE_MANY = "Closing soon: 1 tender for you", "Closing soon: %d tenders for you"
BODY_WITHOUT_TITLE = "Tap to view"


def alerted_pairs(alerts: DataFrame, where: Column) -> DataFrame:
    """(user, notice) pairs in the id arrays of the chosen alerts.

    Exploding makes "not in any alert" an equi anti join; testing the array
    inside the join condition would compare all pairs of a user."""
    return (alerts.filter(where).select("user_id", F.explode("notice_ids").alias("notice_id"))
            .distinct())


def _open_matches(matches: DataFrame, notices: DataFrame, condition: Column,
                  columns: list[str]) -> DataFrame:
    chosen = notices.filter((F.col("status") == "live") & condition)
    return matches.join(chosen.select(F.col("id").alias("notice_id"), *columns), "notice_id")


def _best(df: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), F.col("closing_at").asc(), "notice_id")
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def unsent_matches(matches: DataFrame, notices: DataFrame, alerts: DataFrame, as_of: str,
                   limit: int = DIGEST_LIMIT) -> DataFrame:
    """Per user, the best open matches that no sent alert has carried yet."""
    found = _open_matches(matches, notices, F.col("closing_at") > timestamp(as_of),
                          ["title", "closing_at"])
    sent = alerted_pairs(alerts, F.col("sent_at").isNotNull())
    return _best(found.join(sent, ["user_id", "notice_id"], "left_anti"), limit)


def profile_matches(matches: DataFrame, notices: DataFrame, as_of: str,
                    limit: int = PROFILE_LIMIT) -> DataFrame:
    """Per user, the best open matches shown beside the profile."""
    return _best(_open_matches(matches, notices, F.col("closing_at") > timestamp(as_of),
                               ["title", "closing_at"]), limit)


def urgent_matches(matches: DataFrame, notices: DataFrame, users: DataFrame, alerts: DataFrame,
                   as_of: str, within_hours: int = URGENT_HOURS, min_score: float = 0.0) -> DataFrame:
    """Matches closing too soon for the next digest and not pushed before."""
    now = timestamp(as_of)
    soon = F.col("closing_at").between(now, now + F.expr(f"INTERVAL {within_hours} HOURS"))
    found = _open_matches(matches.filter(F.col("score") >= min_score), notices, soon,
                          ["title", "closing_at"])
    # A push that failed and was never sent leaves its notices open for the next one.
    failed = (F.col("sent_at").isNull() & F.col("error").isNotNull() if {"sent_at", "error"} <= set(alerts.columns)
              else F.lit(False))
    pushed = alerted_pairs(alerts, (F.col("channel") == "push") & ~failed)
    return (found.join(users.filter("unsubscribed_at IS NULL").select("user_id"), "user_id", "left_semi")
            .join(pushed, ["user_id", "notice_id"], "left_anti"))


def digests(unsent: DataFrame, recipients: DataFrame) -> DataFrame:
    """One row per recipient: the ids of at most ten matches, best first."""
    items = unsent.join(recipients.select("user_id"), "user_id", "left_semi")
    return items.groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "notice_id"))),
                    lambda x: x["notice_id"]).alias("notice_ids"),
        F.count("*").alias("n"))


def group_alert_ids(urgent: DataFrame) -> DataFrame:
    """One alert row per user: ids best first, with the top title for the message."""
    order = F.struct((-F.col("score")).alias("by"), F.col("notice_id").alias("id"))
    total = F.col("total")
    return (urgent.groupBy("user_id").agg(
        F.count("*").alias("total"), F.sort_array(F.collect_list(order)).alias("ids"),
        F.min_by("title", order).alias("top_title"))
        .select("user_id", "total", F.transform("ids", lambda x: x["id"]).alias("notice_ids"),
                F.get("ids", F.lit(0))["id"].alias("top_notice_id"),
                truncated(F.when(total == 1, TITLE_ONE).otherwise(
                    F.format_string(TITLE_MANY, "total")), MAX_TITLE).alias("title"),
                truncated(F.coalesce("top_title", F.lit(BODY_WITHOUT_TITLE)), MAX_BODY).alias("body")))


def alert_rows(groups: DataFrame, channel: str, created_at: Column) -> DataFrame:
    """Alert rows to append before anything is sent: not sent until an outcome says so."""
    return groups.select(
        F.xxhash64("user_id", F.lit(channel), created_at, "notice_ids").alias("alert_id"), "user_id", F.lit(channel).alias("channel"), "notice_ids", created_at.alias("created_at"))


def alerts_with_outcome(alerts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Alerts with the state that their send and open events left behind.

    ``outcomes`` has (alert_id, ts, outcome, error) with outcome sent, failed or
    opened. The last send and error count; the first open counts."""
    at = lambda kind: F.when(F.col("outcome") == kind, F.col("ts"))
    state = outcomes.groupBy("alert_id").agg(
        F.max(at("sent")).alias("sent_at"), F.min(at("opened")).alias("opened_at"),
        F.max_by(truncated(F.col("error"), MAX_ALERT_ERROR), at("failed")).alias("error"))
    return alerts.join(state, "alert_id", "left")
