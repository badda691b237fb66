"""The daily chain: embed, match, select digests, measure, in that order.

A digest selected before matching would carry yesterday's list, and matching
before embedding would miss what arrived since. Every stage reads and writes
tables, so the next run picks up whatever a failed stage left undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticelake.operators import alerts, embedding, filters, matching, metrics
from noticelake.sources import buckets
from noticelake.streaming.jobs import alert_log, run_stages

MATCH = ("user_id long, notice_id long, score double, layer2_score double, "
         "reasons struct<matched_by: string, similarity: double, floor: double>")
VECTOR = "id long, embedding array<float>, model string, source_text string, text_digest string"


def daily(spark: SparkSession, path: str, notices: DataFrame, profiles: DataFrame, users: DataFrame,
          verdicts: DataFrame, as_of: str, embed_limit: int | None = None,
          vectorizer: embedding.Vectorizer | None = None, model: str = embedding.MODEL,
          n_buckets: int = buckets.BUCKETS) -> dict[str, str | None]:
    """Run the chain over the tables below ``path``; returns each stage's error.

    Digest rows are written before anything is sent; what the sender appends to
    ``path``/alerts/outcomes decides, so a digest that was not sent comes back."""
    day = as_of[:10]

    def table(name: str, schema: str) -> DataFrame:
        return buckets.read(spark, f"{path}/{name}", schema)

    def embed() -> None:
        held = table("embeddings", VECTOR)
        todo = embedding.needs_embedding(notices, held, model, embed_limit)
        buckets.change(f"{path}/embeddings", VECTOR, ["id"], embedding.embed(todo, vectorizer, model), embedding.upsert_embeddings, buckets=n_buckets)

    def match() -> None:
        held = table("matches", MATCH)
        active = profiles.join(filters.active_users(users).select("user_id"), "user_id", "left_semi")
        fresh = matching.match_all(
            notices, active, table("embeddings", VECTOR), embedding.embed_profiles(active, vectorizer, model), as_of,
            model, seen=[held, verdicts]).select(*held.columns)
        buckets.change(f"{path}/matches", MATCH, ["user_id", "notice_id"], fresh, matching.upsert_matches,
                       buckets=n_buckets)

    def digest() -> None:
        log = alert_log(spark, f"{path}/alerts").filter(F.col("batch") != day)
        unsent = alerts.unsent_matches(table("matches", MATCH), notices, log, as_of)
        groups = alerts.digests(unsent, filters.digest_recipients(users))
        rows = alerts.alert_rows(groups, "email", F.lit(as_of).cast("timestamp"))
        rows.write.mode("overwrite").parquet(f"{path}/alerts/log/batch={day}")

    def measure() -> None:
        metrics.match_precision(verdicts).withColumn("day", F.lit(day)).write.mode(
            "overwrite").parquet(f"{path}/precision/day={day}")

    return run_stages({"embed": embed, "match": match, "digest": digest, "measure": measure})
