"""Tables in hash buckets: what is read and written, and who wins."""

import pytest
from pyspark.sql import functions as F

from noticelake.sources import buckets as B
from noticelake.sources.tables import upsert

SCHEMA = "id long, v string, n long"


def frame(spark, ids, v, n=0):
    return spark.createDataFrame([(i, v, n) for i in ids], SCHEMA)


def newest(held, changes):
    return upsert(held, changes, ["id"], "n")


def put(spark, path, ids, v, batch=None, rewrite=newest):
    return B.change(path, SCHEMA, ["id"], frame(spark, ids, v), rewrite, batch, buckets=8)


def content(spark, path, at=None):
    return {r.id: r.v for r in B.read(spark, path, SCHEMA, at).collect()}


def test_a_change_reads_and_writes_its_own_buckets_only(spark, tmp_path):
    path, read = str(tmp_path), []
    assert B.head(spark, path) is None and content(spark, path) == {}
    put(spark, path, range(100), "a")
    first = B.head(spark, path)

    def watched(held, changes):
        read.extend(held.inputFiles())
        return newest(held, changes)

    put(spark, path, [7], "b", rewrite=watched)
    second = B.head(spark, path)
    [bucket] = {r.b for r in frame(spark, [7], "").select(B.bucket_of(["id"], 8).alias("b")).collect()}
    assert read and all(f"/bucket={bucket}/" in f for f in read)
    assert [b for b in range(8) if first.where[b] != second.where[b]] == [bucket]
    assert B.names(spark, f"{path}/data/{second.where[bucket]}") == ["_SUCCESS", f"bucket={bucket}"]
    assert content(spark, path) == {i: "b" if i == 7 else "a" for i in range(100)}
    assert content(spark, path, first) == dict.fromkeys(range(100), "a")


@pytest.mark.parametrize("mine, other, calls", [(range(4), range(4, 50), 2), (range(50), range(50), 2), ([1], [2], None)])
def test_a_change_made_meanwhile_is_kept(spark, tmp_path, mine, other, calls):
    path, seen = str(tmp_path), []
    put(spark, path, range(50), "a")

    def interrupted(held, changes):
        seen.append(True)
        if len(seen) == 1:
            put(spark, path, other, "b")
        return newest(held, changes)

    put(spark, path, mine, "c", rewrite=interrupted)
    want = dict.fromkeys(range(50), "a") | dict.fromkeys(other, "b") | dict.fromkeys(mine, "c")
    assert content(spark, path) == want and B.head(spark, path).version == 3
    ids = lambda x: {r.b for r in frame(spark, x, "").select(B.bucket_of(["id"], 8).alias("b")).collect()}
    assert len(seen) == (calls or (2 if ids(mine) & ids(other) else 1))


def test_a_named_batch_counts_once(spark, tmp_path):
    path = str(tmp_path)
    add = lambda held, new: held.unionByName(new)
    assert put(spark, path, [1], "a", "x", add) and not put(spark, path, [1], "a", "x", add)

    def overtaken(held, new):  # another process merges the same batch first
        put(spark, path, [2], "b", "y", add)
        return add(held, new)

    assert not put(spark, path, [2], "b", "y", overtaken)
    assert B.read(spark, path, SCHEMA).count() == 2 and B.has_batch(spark, path, "y")


def test_rows_may_go_and_a_bucket_may_become_empty(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, range(20), "a")
    put(spark, path, range(20), "a", rewrite=lambda held, new: held.join(new, "id", "left_anti"))
    assert content(spark, path) == {} and B.head(spark, path).where == {}
    put(spark, path, [3], "b")
    assert content(spark, path) == {3: "b"}


def test_a_rewrite_may_not_leave_its_buckets(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(ValueError, match="not given"):
        put(spark, path, [1], "a", rewrite=lambda held, new: held.unionByName(frame(held.sparkSession, range(99), "z")))
    assert B.head(spark, path) is None


def test_old_folders_go_and_batches_are_remembered(spark, tmp_path):
    path = str(tmp_path)
    for n in range(5):
        put(spark, path, range(30), str(n), f"b{n}")
    spark.range(1).write.parquet(f"{path}/data/unfinished")
    gone = B.expire(spark, path, keep=2)
    assert len([g for g in gone if g.startswith("data/")]) == 3 * 8
    assert content(spark, path) == dict.fromkeys(range(30), "4") and B.has_batch(spark, path, "b0")
    assert B.names(spark, f"{path}/data/unfinished") and B.expire(spark, path, keep=2) == []
    put(spark, path, [1], "x")
    assert content(spark, path)[1] == "x"


def test_skewed_and_null_keys(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("id"), F.lit("a").alias("v"), F.col("id").alias("n"))
    B.change(path, SCHEMA, ["id"], rows, lambda held, new: held.unionByName(new), buckets=8)
    assert B.read(spark, path, SCHEMA).count() == 5000
