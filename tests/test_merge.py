"""The fold against a literal loop, its skew path, and the merge job."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noticelake import schemas as S
from noticelake.operators import merge as M, quality
from noticelake.sources import buckets

T0 = datetime(2026, 1, 1)
NAMES = [f.name for f in S.OBSERVATION.fields]


def observation(ref, doc, kind="list", at=T0, **values):
    row = dict.fromkeys(NAMES)
    row.update(source_key="s", external_ref=ref, kind=kind, observed_at=at, raw_document_id=doc,
               procurement_nature="other", status="live")
    row.update(values)
    return row


def frame(spark, rows):
    return spark.createDataFrame([[r[n] for n in NAMES] for r in rows], S.OBSERVATION)


def empty(spark):
    return spark.createDataFrame([], S.NOTICE)


def merged(spark, rows, current=None, **options):
    options = {"hot_rows": None, "always_latest": ()} | options
    return M.merge_observations(current if current is not None else empty(spark), frame(spark, rows), **options)


def random_rows(seed, keys=40):
    r = random.Random(seed)
    rows = []
    for k in range(keys):
        for i in range(r.randint(1, 9)):
            rows.append(observation(
                f"k{k}", i, r.choice(["list", "list", "detail"]), T0 + timedelta(hours=i),
                title=r.choice([None, "", "A", "B"]), district=r.choice([None, None, "X"]),
                status=r.choice(["live", "live", "live", "cancelled"]),
                closing_at=r.choice([None, T0, T0 + timedelta(days=1)]),
                categories=r.choice([None, [], ["c"]])))
    return rows


def literal_fold(rows, seen=False, state=None):
    """The merge rules applied one observation after the other."""
    versions = []
    for o in rows:
        detail = o["kind"] == "detail"
        new = {n: o[n] for n in S.VALUE_FIELDS}
        if state is None:
            state = {n: (v if v not in ("", []) else None) for n, v in new.items()}
            versions.append("new")
        else:
            old = dict(state)
            for n, v in new.items():
                if v in (None, "", []) or (seen and not detail and old[n] is not None):
                    continue
                state[n] = v
            changed = [n for n in S.HASH_FIELDS if old[n] != state[n]]
            if changed:
                later = old["closing_at"] and state["closing_at"] and state["closing_at"] > old["closing_at"]
                versions.append(
                    "cancellation" if state["status"] == "cancelled" else
                    "extension" if "closing_at" in changed and later else
                    "enrichment" if all(old[n] is None for n in changed) else "corrigendum")
        seen = seen or detail
    return state, versions


@pytest.mark.parametrize("options", [{"hot_rows": None}, {"hot_rows": 4, "chunk_seconds": 7200}])
def test_fold_equals_literal_loop(spark, options):
    rows = random_rows(7)
    result = merged(spark, rows, **options)
    current = {r.external_ref: r for r in result.current.collect()}
    versions = {}
    for v in sorted(result.versions.collect(), key=lambda v: (v.external_ref, v.version_no)):
        versions.setdefault(v.external_ref, []).append(v.change_type)
    by_key = {}
    for r in rows:
        by_key.setdefault(r["external_ref"], []).append(r)
    assert set(current) == set(by_key)
    for key, mine in by_key.items():
        state, want = literal_fold(mine)
        got = current[key].asDict()
        assert {n: got[n] for n in ("title", "district", "status", "closing_at", "categories")} == {
            n: state[n] for n in ("title", "district", "status", "closing_at", "categories")}, key
        assert versions[key] == want, key
        assert got["version_no"] == len(want) and got["last_seen_at"] == mine[-1]["observed_at"]
        details = [r["observed_at"] for r in mine if r["kind"] == "detail"]
        assert got["detail_fetched_at"] == (max(details) if details else None)
    assert quality.version_gaps(result.versions, S.KEY).isEmpty()
    assert result.outcomes.agg(F.sum("n")).first()[0] == len(rows)


@pytest.mark.parametrize("options", [{"hot_rows": 2, "chunk_seconds": 3600}])
def test_two_batches_equal_one(spark, options):
    rows = random_rows(11, 25)
    cut = T0 + timedelta(hours=3)
    first = merged(spark, [r for r in rows if r["observed_at"] <= cut]).current
    second = merged(spark, [r for r in rows if r["observed_at"] > cut], current=first, **options)
    whole = merged(spark, rows).current
    both = M.apply_merge(first, second.current)
    key = lambda df: sorted(map(str, df.drop("raw_document_id").collect()))
    assert key(both) == key(whole)


@pytest.mark.parametrize("hot_rows", [None, 0, 10, 1000])
def test_copies_collapse_but_are_counted(spark, hot_rows):
    rows = [observation("a", 1, title="A")] * 50 + [observation("a", 2, at=T0 + timedelta(hours=2), title="B")]
    result = merged(spark, rows, hot_rows=hot_rows)
    assert result.outcomes.count() == 3
    n = {r.outcome: r.n for r in result.outcomes.groupBy("outcome").agg(F.sum("n").alias("n")).collect()}
    assert n == {"new": 1, "unchanged": 49, "changed": 1}


@pytest.mark.parametrize("hot_rows", [None, 0])
def test_observations_are_dealt_once_and_without_their_order(spark, hot_rows):
    import re

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as it is with large tables
    try:
        folded = M.fold_observations(empty(spark), frame(spark, random_rows(2, 3)), (), hot_rows)
        plan = folded._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    parts = [re.split(r", \d+\), ", line)[0] for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert parts and not [p for p in parts if "title" in p or "_ord" in p]
    assert plan.count("REPARTITION_BY_COL") == (1 if hot_rows is None else 2)  # both uses share one when it runs
    assert "_ord" not in plan[plan.rindex("REPARTITION_BY_COL"):]


def test_ten_list_sweeps_after_a_detail_make_no_version(spark):
    rows = [observation("a", 0, "detail", title="Proper Title", package_no="P-1", district="X")]
    rows += [observation("a", i, at=T0 + timedelta(hours=i), title="proper title") for i in range(1, 11)]
    result = merged(spark, rows)
    assert [v.change_type for v in result.versions.collect()] == ["new"]
    assert result.current.first().title == "Proper Title"


@pytest.mark.parametrize("late,expected", [((), "2026-01-05"), (M.ALWAYS_LATEST, "2026-01-09")])
def test_always_latest_fields_follow_the_list(spark, late, expected):
    rows = [observation("a", 0, "detail", closing_at=datetime(2026, 1, 5)),
            observation("a", 1, at=T0 + timedelta(hours=1), closing_at=datetime(2026, 1, 9))]
    result = merged(spark, rows, always_latest=late, hot_rows=0, chunk_seconds=1800)
    assert str(result.current.first().closing_at)[:10] == expected


def test_late_observations_only_fill_gaps(spark):
    current = merged(spark, [observation("a", 0, at=T0 + timedelta(days=2), title="A")]).current
    result = merged(spark, [observation("a", 1, "detail", at=T0, title="OLD", district="X")], current=current)
    row = result.current.first()
    assert (row.title, row.district, row.last_seen_at) == ("A", "X", T0 + timedelta(days=2))
    assert [v.change_type for v in result.versions.collect()] == ["enrichment"]


def test_hash_ignores_whitespace_free_noise_and_money_scale(spark):
    a = merged(spark, [observation("a", 0, detail_url="x", raw_document_id=1, title="T")]).current.first()
    b = merged(spark, [observation("a", 9, detail_url="y", raw_document_id=2, title="T")]).current.first()
    assert a.canonical_hash == b.canonical_hash
    assert M.healed(merged(spark, random_rows(3, 5)).current).isEmpty()


def test_merge_job_is_idempotent_per_batch(spark, tmp_path):
    path = str(tmp_path)
    rows = random_rows(5, 10)
    first = M.merge_into(path, frame(spark, rows), "0", 4, hot_rows=None)
    counts = sorted(map(str, first.collect()))
    assert counts and sorted(map(str, M.merge_into(path, frame(spark, rows), "0", 4, hot_rows=None).collect())) == counts
    later = [dict(r, observed_at=r["observed_at"] + timedelta(days=1), kind="list", raw_document_id=0)
             for r in {r["external_ref"]: r for r in rows}.values()]
    state = M.read_notices(spark, path).collect()
    again = [dict(o, **{n: s[n] for n in S.VALUE_FIELDS}) for o in later
             for s in state if s.external_ref == o["external_ref"]]
    counts = M.merge_into(path, frame(spark, again), "1", 4, hot_rows=None)
    assert {r.outcome for r in counts.collect()} == {"unchanged"}
    assert buckets.head(spark, f"{path}/notices").version == 2


def test_two_writers_of_the_same_notices_lose_nothing(spark, tmp_path, monkeypatch):
    rows = random_rows(8, 12)
    early, late = [r for r in rows if r["observed_at"] < T0 + timedelta(hours=3)], [r for r in rows if r["observed_at"] >= T0 + timedelta(hours=3)]
    path, fold, meanwhile = str(tmp_path), M.fold_observations, []

    def slow(current, observations, **options):  # the other batch is merged while this one is being folded
        if not meanwhile:
            meanwhile.append(True)
            M.merge_into(path, frame(spark, early), "early", 4, hot_rows=None)
        return fold(current, observations, **options)

    monkeypatch.setattr(M, "fold_observations", slow)
    M.merge_into(path, frame(spark, late), "late", 4, hot_rows=None)
    whole = M.merge_observations(empty(spark), frame(spark, rows), hot_rows=None)
    assert sorted(map(str, M.read_notices(spark, path).collect())) == sorted(map(str, whole.current.collect()))
    assert sorted(map(str, M.read_versions(spark, path).collect())) == sorted(map(str, whole.versions.collect()))
    assert [r.batch for r in buckets.batches(spark, f"{path}/notices").orderBy("version").collect()] == ["early", "late"]


def test_a_lost_batch_leaves_no_trace_and_comes_again(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path), random_rows(9, 6)
    M.merge_into(path, frame(spark, rows[:5]), "0", 4, hot_rows=None)
    before = sorted(map(str, M.read_notices(spark, path).collect()))
    monkeypatch.setattr(buckets, "create_once", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        M.merge_into(path, frame(spark, rows[5:]), "1", 4, hot_rows=None)
    monkeypatch.undo()
    assert sorted(map(str, M.read_notices(spark, path).collect())) == before
    assert {r.batch for r in spark.read.parquet(f"{path}/versions").select("batch").distinct().collect()} == {0, 1}
    held = M.read_versions(spark, path).count()
    M.merge_into(path, frame(spark, rows[5:]), "1", 4, hot_rows=None)
    assert M.read_versions(spark, path).count() > held


def test_merge_heals_a_wrong_hash(spark, tmp_path):
    path = str(tmp_path)
    M.merge_into(path, frame(spark, [observation("a", 0, title="T")]), "0", 4, hot_rows=None)
    right = M.read_notices(spark, path).first().canonical_hash
    buckets.change(f"{path}/notices", S.NOTICE, S.KEY, M.read_notices(spark, path),
                   lambda held, _: held.withColumn("canonical_hash", F.lit("wrong")))
    counts = M.merge_into(path, frame(spark, [observation("a", 1, at=T0 + timedelta(hours=1), title="T")]), "1", 4, hot_rows=None)
    assert [r.outcome for r in counts.collect()] == ["unchanged"] and M.read_notices(spark, path).first().canonical_hash == right


def test_streams_and_restarts_do_not_share_batch_names(spark, tmp_path):
    from noticelake.streaming import jobs
    for n, (stream, folder) in enumerate([("a", "one"), ("b", "two"), ("a", "fresh")]):
        rows = frame(spark, [observation(f"k{n}", n, title="T")])
        rows.write.parquet(str(tmp_path / folder / "in"))
        source = spark.readStream.schema(S.OBSERVATION).parquet(str(tmp_path / folder / "in"))
        writer = jobs.merge_stream(source, str(tmp_path / "out"), stream, n_buckets=4, hot_rows=None)
        for _ in range(2):  # the second start finds its own batch done
            query = jobs.start(writer, str(tmp_path / folder / "checkpoint"))
            assert query.awaitTermination(300) and query.exception() is None
    assert {r.external_ref for r in M.read_notices(spark, str(tmp_path / "out")).collect()} == {"k0", "k1", "k2"}


def test_both_paths_tell_an_unknown_document_from_document_zero(spark):
    rows = [observation("a", None, title="A"), observation("a", 0, title="A"), observation("a", 0, title="A")]
    fold = lambda hot: sorted((r.raw_document_id or -1, r._copies) for r in M.fold_observations(
        empty(spark), frame(spark, rows), (), hot, 3600).select("raw_document_id", "_copies").collect())
    assert fold(None) == fold(0) and len(fold(0)) == 2


def test_the_fold_of_oversized_keys_shuffles_a_few_times(spark):
    folded = M.fold_observations(empty(spark), frame(spark, random_rows(4, 3)), (), 0, 3600).select("external_ref", "outcome")
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 16
