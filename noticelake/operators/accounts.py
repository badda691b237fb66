"""Accounts as folds over event feeds: latest-wins rows, verdicts, subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from noticelake.functions.text import truncated
from noticelake.functions.values import MIN_DESCRIPTION_CHARS, normalize_phone, valid_email
from noticelake.operators.skew import with_history
from noticelake.schemas import ENUMS
from noticelake.sources.tables import upsert

MAX_FAILURES = 5  # Fixed value: consecutive failures that retire a subscription.


def latest_verdicts(feedback: DataFrame) -> DataFrame:
    """One verdict per user and notice; a changed mind overwrites."""
    return feedback.groupBy("user_id", "notice_id").agg(
        F.max_by("verdict", F.struct("created_at", "verdict")).alias("verdict"),
        F.max("created_at").alias("created_at"))


def first_opens(opens: DataFrame) -> DataFrame:
    """The first open of each alert; later ones do not move it."""
    return opens.groupBy("alert_id").agg(F.min("opened_at").alias("opened_at"))


def upsert_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Sign-ups by phone; a repeated sign-up updates address and company."""
    return upsert(users, changes, ["phone"], "changed_at")


def upsert_profiles(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    return upsert(profiles, changes, ["user_id"], "updated_at")


def account_state(events: DataFrame) -> DataFrame:
    """Account flags from (user_id, ts, event) with event login or unsubscribe.

    A login verifies once, marks the user seen and ends an unsubscription."""
    at = lambda kind: F.when(F.col("event") == kind, F.col("ts"))
    state = events.groupBy("user_id").agg(
        F.min(at("login")).alias("verified_at"), F.max(at("login")).alias("last_seen_at"),
        F.max(at("unsubscribe")).alias("_left"))
    back = F.coalesce(F.col("last_seen_at") >= F.col("_left"), F.lit(False))
    return state.withColumn("unsubscribed_at", F.when(~back, F.col("_left"))).drop("_left")


def expectations(signups: DataFrame) -> DataFrame:
    """Sign-up form checks as columns, and ``valid`` when all hold."""
    amount = lambda c: F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    low, high = amount(F.col("min_security")), amount(F.col("max_security"))
    checked = signups.withColumns({
        "phone_normalized": normalize_phone(F.col("phone")),
        "ok_email": valid_email(F.col("email")),
        "ok_description": F.length(F.trim(F.coalesce("business_description", F.lit(""))))
        >= MIN_DESCRIPTION_CHARS,
        "ok_bounds": F.coalesce(low <= high, F.lit(True)),
        "natures_kept": F.filter("natures", lambda n: n.isin(*ENUMS["procurement_nature"]))})
    checked = checked.withColumn("ok_phone", F.col("phone_normalized").isNotNull())
    return checked.withColumn("valid", F.col("ok_phone") & F.col("ok_email")
                              & F.col("ok_description") & F.col("ok_bounds"))


def subscriptions(events: DataFrame) -> DataFrame:
    """Current subscriptions from subscribe and delete events.

    Subscribing again revives and re-owns the endpoint; incomplete keys are
    refused; a deletion after the last subscribe removes it."""
    complete = F.col("endpoint").isNotNull() & F.col("p256dh").isNotNull() & F.col("auth").isNotNull()
    kept = events.filter((F.col("event") == "delete") | complete)
    row = F.struct("user_id", "p256dh", "auth", truncated(F.coalesce(
        "user_agent", F.lit("")), 300).alias("user_agent"), F.col("ts").alias("subscribed_at"))
    subscribed = F.when(F.col("event") == "subscribe", F.col("ts"))
    return (kept.groupBy("endpoint").agg(
        F.max_by(row, subscribed).alias("s"),
        F.max(F.when(F.col("event") == "delete", F.col("ts"))).alias("_deleted"))
        .filter(F.col("s.subscribed_at").isNotNull()
                & F.coalesce(F.col("s.subscribed_at") > F.col("_deleted"), F.lit(True)))
        .select("endpoint", "s.*"))


def send_streaks(sends: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Every send with the failures in a row it ends, up to the threshold.

    ``sends`` has (endpoint, ts, seq, outcome) with outcome subscribe, ok, error
    or gone. Only the last five sends decide, so an endpoint of any size can be
    cut into time chunks with four predecessors each. A "gone" answer is not a
    failure and leaves the count of the sends before it."""
    chunk = chunk if chunk is not None else F.to_date("ts")
    ordered = sends.withColumn("at", F.struct("ts", "seq"))
    rows, part = with_history(ordered, ["endpoint"], "at", chunk, MAX_FAILURES - 1, F.lit(True))
    last = Window.partitionBy(*part).orderBy("at").rowsBetween(1 - MAX_FAILURES, 0)
    recent = F.reverse(F.collect_list("outcome").over(last))
    rows = (rows.withColumn("_recent", recent).filter(~F.col("_history"))
            .withColumn("_recent", F.when(F.col("outcome") == "gone", F.slice(
                "_recent", F.lit(2), F.size("_recent"))).otherwise(F.col("_recent"))))
    broken = F.filter(F.transform("_recent", lambda o, i: F.when(o != "error", i)),
                      lambda i: i.isNotNull())
    streak = F.coalesce(F.get(broken, F.lit(0)), F.size("_recent"))
    return (rows.withColumn("streak", streak.cast("long"))
            .withColumn("retires", (F.col("outcome") == "gone") | (F.col("streak") >= MAX_FAILURES))
            .drop("_history", "_chunk", "_recent"))


def subscription_health(sends: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Failure count, retirement and last success per endpoint.

    Five failures in a row, or an explicit "gone", retire an endpoint until it
    subscribes again; nothing is sent to it in between, so what a retired
    endpoint reports moves neither count nor retirement."""
    subscribed = sends.filter("outcome = 'subscribe'").groupBy("endpoint").agg(
        F.max(F.struct("ts", "seq")).alias("_since"))
    df = send_streaks(sends, chunk).join(subscribed, "endpoint", "left")
    current = F.coalesce(F.col("at") >= F.col("_since"), F.lit(True))
    retirement = F.when(current & F.col("retires"), F.col("at"))
    return df.groupBy("endpoint").agg(
        F.coalesce(F.min_by("streak", retirement), F.max_by("streak", "at")).alias("failure_count"),
        F.min(retirement)["ts"].alias("retired_at"),
        F.max(F.when(F.col("outcome") == "ok", F.col("ts"))).alias("last_success_at"))
