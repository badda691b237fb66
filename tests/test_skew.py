"""Chunked windows against loops over whole keys."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from noticelake.operators import accounts, metrics

T0 = datetime(2026, 1, 1)


def test_baselines_survive_chunking(spark):
    r = random.Random(4)
    runs = [(i, r.choice("ab"), T0 + timedelta(hours=i), r.choice(["ok", "ok", "ok", "failed", "partial"]),
             r.choice([0, 100, 49, 51, 7]), r.random() > .2) for i in range(150)]
    df = spark.createDataFrame(runs, "run_id long, source_key string, started_at timestamp, status string, "
                               "items_found long, is_full_sweep boolean")
    for chunk in (F.floor(F.unix_seconds("started_at") / 18000), F.lit(0)):
        got = {x.run_id: (x.baseline, x.yield_anomaly) for x in metrics.yield_anomalies(df, chunk=chunk).collect()}
        for run_id, source, at, status, found, full in runs:
            past = [x[4] for x in runs if x[1] == source and x[2] < at and x[3] == "ok" and x[5] and x[4] > 0][-10:]
            base = sum(past) / len(past) if past else None
            bad = (status == "failed" or found == 0) or (full and base is not None and found < base * .5)
            assert got[run_id][1] == bad and (got[run_id][0] is None) == (base is None)
            assert base is None or abs(got[run_id][0] - base) < 1e-9


def health_by_loop(sends):
    out = {}
    for endpoint, ts, seq, outcome in sorted(sends, key=lambda s: (s[1], s[2])):
        failures, retired, success = out.get(endpoint, (0, None, None))
        if outcome == "ok":
            success = ts
        if outcome == "subscribe":
            failures, retired = 0, None
        elif retired is None and outcome == "ok":
            failures = 0
        elif retired is None and outcome == "gone":
            retired = ts
        elif retired is None:
            failures += 1
            retired = ts if failures >= 5 else None
        out[endpoint] = (failures, retired, success)
    return out


def random_sends(seed, n=400):
    r = random.Random(seed)
    return [(r.choice(["hot"] * 4 + ["x", "y", "z"]), T0 + timedelta(minutes=r.randint(0, 3000)), i,
             r.choice(["error"] * 8 + ["ok", "ok", "subscribe", "gone"])) for i in range(n)]


def test_subscription_health_equals_a_loop(spark):
    for seed in (1, 2):
        sends = random_sends(seed)
        df = spark.createDataFrame(sends, "endpoint string, ts timestamp, seq long, outcome string")
        rows = accounts.subscription_health(df, F.floor(F.unix_seconds("ts") / 3600)).collect()
        assert {x.endpoint: (x.failure_count, x.retired_at, x.last_success_at) for x in rows} == health_by_loop(sends)
