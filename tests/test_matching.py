"""Candidates, counts and fusion against brute force on small random tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noticelake.operators import matching as M

AS_OF = "2026-01-01 00:00:00"
T0 = datetime(2026, 1, 1)


def data(seed, n_notices=300, n_users=40):
    r = random.Random(seed)
    notices = [(i, r.choice(["live", "live", "live", "closed"]),
                T0 + timedelta(days=r.randint(-1, 95), hours=r.randint(0, 23)) if r.random() > .1 else None,
                r.choice([None, "A", "A", "A", "B", "C"]), r.choice(["goods", "works"]),
                r.choice([None, "OTM", "LTM"]), r.choice([None, 5, 50, 500, 5000, 20000]),
                T0 - timedelta(days=r.randint(0, 20)) if r.random() > .1 else None)
               for i in range(n_notices)]
    users = [(u, r.choice([None, [], ["A"], ["B", "C"], ["A", "A", "C"]]), r.choice([[], ["goods"], ["goods", "works"]]),
              r.choice([[], [], ["OTM"]]), r.choice([None, None, 50, 60]), r.choice([None, None, 500, 40]))
             for u in range(n_users)]
    return notices, users


def frames(spark, notices, users):
    n = spark.createDataFrame(notices, "id long, status string, closing_at timestamp, district string, "
                              "procurement_nature string, procurement_method string, s int, published_at timestamp")
    u = spark.createDataFrame(users, "user_id long, district_names array<string>, procurement_natures array<string>, "
                              "procurement_methods array<string>, lo int, hi int")
    money = "decimal(18,2)"
    return (n.withColumn("tender_security", F.col("s").cast(money)),
            u.withColumns({"min_security": F.col("lo").cast(money), "max_security": F.col("hi").cast(money)}))


def brute(notices, users, seen=frozenset(), limit=500):
    out = {}
    for u, districts, natures, methods, lo, hi in users:
        hits = [(p, i) for i, status, closing, d, nat, m, s, p in notices
                if status == "live" and closing and T0 + timedelta(hours=24) <= closing <= T0 + timedelta(days=90)
                and (not districts or d is None or d in districts) and (not natures or nat in natures)
                and (not methods or m in methods) and (s is None or lo is None or s >= lo)
                and (s is None or hi is None or s <= hi) and (u, i) not in seen]
        hits.sort(key=lambda x: (x[0] is None, -(x[0] or T0).timestamp(), x[1]))
        out[u] = [i for _, i in hits][:limit]
    return out


@pytest.mark.parametrize("limit,cell_rows", [(10, 12), (10, 3), (500, None), (1500, None)])
def test_candidates_are_exact_however_the_cells_are_cut(spark, limit, cell_rows):
    notices, users = data(limit + (cell_rows or 0))
    # Every notice has a method here: the wildcard covers unknown ones as well.
    notices = [n[:5] + (n[5] or "RFQ",) + n[6:] for n in notices]
    r = random.Random(1)
    seen = {(r.randrange(40), r.randrange(300)) for _ in range(1500)}
    n, u = frames(spark, notices, users)
    s = spark.createDataFrame(sorted(seen), "user_id long, notice_id long")
    got = {}
    for row in M.candidates(n, u, AS_OF, [s], limit, cell_rows).orderBy("user_id", "position").collect():
        got.setdefault(row.user_id, []).append(row.notice_id)
    want = {k: v for k, v in brute(notices, users, seen, limit).items() if v}
    assert got == want


@pytest.mark.parametrize("seed", range(1))
def test_narrow_money_bounds_take_more_rounds(spark, monkeypatch, seed):
    r = random.Random(seed)
    notices, _ = data(seed, 400)
    notices = [n[:5] + (n[5] or "RFQ", r.choice([None, 0, 1, 7, 8, 9, 63, 64, 65, 511, 4096, 10**9])) + n[7:] for n in notices]
    users = [(u, r.choice([[], ["A"]]), [], [], lo, hi) for u, (lo, hi) in enumerate(
        [(None, None), (64, 64), (0, 0), (8, 9), (65, 7), (None, 8), (10**9, None), (63, 511), (2, 6), (1, 10**9)])]
    rounds, once = [], M.threshold_round
    monkeypatch.setattr(M, "threshold_round", lambda *a: rounds.append(a[-1]) or once(*a))
    n, u = frames(spark, notices, users)
    got = {}
    for row in M.candidates(n, u, AS_OF, limit=20, cell_rows=2, growth=4).orderBy("user_id", "position").collect():
        got.setdefault(row.user_id, []).append(row.notice_id)
    assert got == {k: v for k, v in brute(notices, users, limit=20).items() if v}
    assert rounds[:3] == [2, 8, 32]


def test_a_round_prunes_before_it_shuffles(spark):
    n, u = frames(spark, *data(1, 50, 5))
    plan = M.threshold_round(M._priced_cells(n, AS_OF), M._priced_user_cells(u), [], 10, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3 and plan.count("Exchange hashpartitioning") <= 3


def test_unknown_method_passes_only_without_a_method_list(spark):
    notices, users = data(3)
    n, u = frames(spark, notices, users)
    got = {}
    for row in M.candidates(n, u, AS_OF).orderBy("user_id", "position").collect():
        got.setdefault(row.user_id, []).append(row.notice_id)
    assert got == {k: v for k, v in brute(notices, users).items() if v}


def test_counts_without_pairs(spark):
    notices, users = data(9)
    n, u = frames(spark, notices, users)
    got = {r.user_id: r.candidates for r in M.count_candidates(n, u, AS_OF, bucket=100).collect()}
    assert got == {k: len(v) for k, v in brute(notices, users, limit=10**9).items()}


def arms(spark, vector, keyword):
    v = spark.createDataFrame([(1, i, s, p) for p, (i, s) in enumerate(vector)],
                              "user_id long, notice_id long, similarity double, vector_position int")
    k = spark.createDataFrame([(1, i, int(s * 10), p) for p, (i, s) in enumerate(keyword)],
                              "user_id long, notice_id long, hits int, keyword_position int")
    return [r.asDict() for r in M.fuse(v, k).orderBy("position").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_fusion_equals_a_plain_loop(spark, seed):
    r = random.Random(seed)
    vector, keyword = ([(i, round(r.uniform(0.2, 1), 3)) for i in r.sample(range(30), r.randint(1, 12))] for _ in range(2))
    vector.sort(key=lambda x: -x[1])
    floor = max(M.ABSOLUTE_FLOOR, M.RELATIVE_FLOOR * vector[0][1])
    want = {}
    for position, (i, s) in enumerate(vector):
        if s >= floor or i in dict(keyword):
            want[i] = want.get(i, 0) + 1 / (M.RRF_K + position + 1)
    for position, (i, _) in enumerate(keyword):
        want[i] = want.get(i, 0) + 1 / (M.RRF_K + position + 1)
    order = sorted(want, key=lambda i: (-want[i], i))[:M.MATCH_LIMIT]
    rows = arms(spark, vector, keyword)
    assert [row["notice_id"] for row in rows] == order
    assert [row["score"] for row in rows] == pytest.approx([want[i] for i in order])
    by = {row["notice_id"]: row["reasons"]["matched_by"] for row in rows}
    assert all(by[i] == ("both" if i in dict(vector) and i in dict(keyword) else "semantic" if i in dict(vector) else "keyword") for i in order)


def test_wildcard_signs_in_the_data_are_plain_values(spark):
    notices = [(1, "live", T0 + timedelta(days=2), "*", "goods", "OTM", None, T0), (2, "live", T0 + timedelta(days=2), "?", "goods", "OTM", None, T0)]
    users = [(1, ["*", "Q"], [], [], None, None), (2, ["?"], [], [], None, None), (3, ["Q"], [], [], None, None)]
    n, u = frames(spark, notices, users)
    assert sorted((r.user_id, r.notice_id) for r in M.candidates(n, u, AS_OF).collect()) == [(1, 1), (2, 2)]


def test_all_keywords_count(spark):
    pairs = spark.createDataFrame([(1, 7)], "user_id long, notice_id long")
    words = [f"w{i}" for i in range(30)]
    counts = spark.createDataFrame([(7, {w: 2 for w in words})], "notice_id long, counts map<string, long>")
    keywords = spark.createDataFrame([(1, w) for w in words], "user_id long, word string")
    assert M.keyword_arm(pairs, counts, keywords).first().hits == 60


def test_vectors_of_another_model_are_not_compared(spark):
    pairs = spark.createDataFrame([(1, 7)], "user_id long, notice_id long")
    notice = spark.createDataFrame([(7, [1.0, 0.0], "m")], "id long, embedding array<float>, model string")
    mine = spark.createDataFrame([(1, [1.0, 0.0], "other")], "user_id long, embedding array<float>, model string")
    assert M.vector_arm(pairs, notice, mine, "m").isEmpty()
    assert M.vector_arm(pairs, notice, mine.withColumn("model", F.lit("m")), "m").count() == 1


def test_floor_is_relative_and_spares_keyword_hits(spark):
    rows = arms(spark, [(1, .5), (2, .31), (3, .29)], [(4, .1)])
    assert sorted(r["notice_id"] for r in rows) == [1, 2, 4]
    assert rows[0]["reasons"]["floor"] == .3
    low = arms(spark, [(1, .10), (2, .05)], [(2, .1)])
    assert [r["notice_id"] for r in low] == [2] and low[0]["reasons"]["floor"] == .15


def test_keywords_are_ordered_by_count_then_word(spark):
    texts = spark.createDataFrame([(1, "pump pump water tube tube the 12"), (2, "পানি ১২ ab")], "user_id long, text string")
    rows = M.profile_keywords(texts, 3).orderBy("user_id", "position").collect()
    assert [(r.user_id, r.word) for r in rows] == [(1, "pump"), (1, "tube"), (1, "water"), (2, "পানি")]


def test_users_of_equal_constraints_share_one_round_and_others_do_not(spark, tables, monkeypatch):
    from noticelake.plans.proxies import AS_OF

    profiles, notices = tables.customer_profiles(), tables.notices()
    seen = tables.matches().select("user_id", "notice_id").filter("user_id % 2 = 0")
    twice = profiles.unionByName(profiles.filter("user_id = 7").withColumn("district_names", F.array(F.lit("FRANCE"))))
    rounds, whole = [], M.threshold_round

    def spied(cells, users, *rest):
        rounds.append(users.select("user_id").distinct().count())
        return whole(cells, users, *rest)

    def rows(df):
        return sorted(map(tuple, df.select("user_id", "notice_id", "position").collect()))

    for excluded in ([], [seen]):
        monkeypatch.setattr(M, "threshold_round", spied)
        shared = rows(M.candidates(notices, twice, AS_OF, excluded, limit=9, cell_rows=4))
        monkeypatch.setattr(M, "_classes", lambda p, s: p.withColumn("head", F.col("user_id")))
        alone = rows(M.candidates(notices, twice, AS_OF, excluded, limit=9, cell_rows=4))
        monkeypatch.undo()
        assert shared == alone and shared
    assert rounds[0] < profiles.count()


def test_users_who_have_seen_something_share_the_list_of_their_class(spark, monkeypatch):
    notices, _ = data(5)
    users = [(u, ["A"], ["goods"], [], None, 500) for u in range(30)] + [(u, [], [], [], 50, None) for u in range(30, 60)]
    every = brute(notices, users)
    # Each has seen one notice of the list, but 3 the newest forty, 4 all and 40 all but the last two.
    seen = {(u, every[u][u % 7]) for u in range(60)} | {(3, i) for i in every[3][:40]} | {(4, i) for i in every[4]} | {
        (40, i) for i in every[40][:-2]}
    rounds, once = [], M.threshold_round
    monkeypatch.setattr(M, "threshold_round", lambda cells, heads, *rest: rounds.append(
        heads.select("user_id").distinct().count()) or once(cells, heads, *rest))
    n, u = frames(spark, notices, users)
    s = spark.createDataFrame(sorted(seen), "user_id long, notice_id long")
    got = {}
    for row in M.candidates(n, u, AS_OF, [s.limit(40), s], limit=5, growth=2).orderBy("user_id", "position").collect():
        got.setdefault(row.user_id, []).append(row.notice_id)
    assert got == {k: v for k, v in brute(notices, users, seen, 5).items() if v}
    assert len(got[40]) == 2 and 4 not in got and max(rounds) == 2 and len(rounds) > 2
