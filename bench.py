"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Each query is run to a sink that keeps nothing, once to warm up and then
BENCH_RUNS times, or once when BUDGET_S seconds are spent; the median counts."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

BUDGET_S = 400
HEADLINE = [
    "site_stats", "facets", "browse_page", "search_words", "search_page", "sitemap",
    "candidates_all_users", "candidate_counts", "hybrid_matches",
    "merge_current", "merge_versions", "unsent_matches", "urgent_alert_groups",
    "subscription_health", "yield_anomalies", "award_competition", "top_winners",
    "merge_hot_keys", "match_report", "typical_award_value", "parse_award_pages", "award_links",
    "replay_failed_payloads", "normalize_text", "hashing_vectors", "embed_newest", "parse_list_pages", "parse_detail_pages", "new_blobs",
]


def main() -> None:
    from noticelake.plans.catalog import queries
    from noticelake.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    available = queries()
    seconds: dict[str, float] = {}
    began = time.perf_counter()
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range((runs if time.perf_counter() - began < BUDGET_S else 1) + 1):
            start = time.perf_counter()
            available[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]} (first {times[0]:.2f})", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
