"""Keyed tables that are changed bucket by bucket.

A row lies in the bucket of its key's hash. ``heads`` has a small file per version: its
batch and the map of where each bucket's rows are, a folder below ``data``. A change reads the
buckets that its keys fall into, writes them into a folder of its own, and publishes a
head that points there; all other buckets stay where they are.

Heads are numbered and a number is taken once: the file is written aside and renamed, and
the rename fails when the name exists. (That is one step on HDFS; an object store needs
a rename or put that fails likewise.) Of two writers that started from the same version one fails to publish.
If the other changed other buckets, it publishes on top of them; if not, it reads and
rewrites its buckets again. So no change is lost and none is applied twice, and a
writer that dies leaves a folder that no head names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from noticelake.session import temporary, written as stored

#: Enough that a bucket of a large table is a few files, few enough for one small map.
BUCKETS = 64
_COMMIT = "version long, batch string"
Rewrite = Callable[[DataFrame, DataFrame], DataFrame]


class Head(NamedTuple):
    version: int
    buckets: int
    where: dict[int, str]  # bucket -> folder below data; empty buckets are missing


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, target = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def read_text(spark: SparkSession, file: str) -> str:
    fs, target = _hadoop(spark, file)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Whether the file was created; False when there is one of that name."""
    jvm = spark.sparkContext._jvm
    fs, target = _hadoop(spark, f"{folder}/{name}")
    _, aside = _hadoop(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), options)
        return True
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        fs.delete(aside, False)
        return False


def _heads(spark: SparkSession, path: str) -> list[str]:
    return [n for n in names(spark, f"{path}/heads") if n.endswith(".json") and not n.startswith(".")]


def head(spark: SparkSession, path: str) -> Head | None:
    """The newest version; None for a table that nobody has written."""
    found = _heads(spark, path)
    if not found:
        return None
    commit = json.loads(read_text(spark, f"{path}/heads/{found[-1]}"))
    where = json.loads(read_text(spark, f"{path}/maps/{commit['map']}.json"))
    return Head(commit["version"], where["buckets"], {int(b): f for b, f in where["where"].items()})


def batches(spark: SparkSession, path: str) -> DataFrame:
    """(version, batch) of every version."""
    if not _heads(spark, path):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).json(f"{path}/heads")


def has_batch(spark: SparkSession, path: str, batch: str) -> bool:
    """True when the batch is part of a published version."""
    return not batches(spark, path).filter(F.col("batch") == batch).isEmpty()


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, schema: T.StructType | str, at: Head | None = None,
         only: Iterable[int] | None = None) -> DataFrame:
    """The table, or some buckets of it, as of a version (default: the newest)."""
    at = at or head(spark, path)
    wanted = set(only) if only is not None else None
    folders = [f"{path}/data/{folder}/bucket={b}" for b, folder in sorted(at.where.items())
               if wanted is None or b in wanted] if at else []
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _is_stored(df: DataFrame) -> bool:
    """Whether the rows are read from files as they are: a second copy would spare nothing."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def change(path: str, schema: T.StructType | str, keys: list[str], changes: DataFrame, rewrite: Rewrite,
           batch: str | None = None, buckets: int = BUCKETS, attempts: int = 30) -> bool:
    """Rewrite the buckets that the keys of ``changes`` fall into; False when the named
    batch is published already.

    ``rewrite(held, changes)`` makes the new rows of those buckets from their present rows;
    it is called again when another writer changed one of them meanwhile, so what else
    it writes must overwrite itself."""
    spark = changes.sparkSession
    if batch is not None and has_batch(spark, path, batch):
        return False
    with temporary(spark):
        return _change(path, schema, keys, changes, rewrite, batch, buckets, attempts)


def _change(path: str, schema: T.StructType | str, keys: list[str], changes: DataFrame, rewrite: Rewrite,
            batch: str | None, buckets: int, attempts: int) -> bool:
    spark = changes.sparkSession
    if not _is_stored(changes):  # read to find the buckets, and again by the rewrite
        changes = stored(changes)
    base = head(spark, path)
    count = base.buckets if base else buckets
    touched = {r.b for r in changes.select(bucket_of(keys, count).alias("b")).distinct().collect()}  # at most ``count``
    written: dict[int, str] | None = None
    for _ in range(attempts):
        if written is None:
            folder = uuid.uuid4().hex
            rows = rewrite(read(spark, path, schema, base, touched) if base else spark.createDataFrame([], schema), changes)
            (rows.withColumn("bucket", bucket_of(keys, count)).hint("rebalance", "bucket")
             .write.partitionBy("bucket").parquet(f"{path}/data/{folder}"))
            written = {int(n[7:]): folder for n in names(spark, f"{path}/data/{folder}") if n.startswith("bucket=")}
            if set(written) - touched:
                raise ValueError("the rewrite returned keys of buckets that it was not given")
        kept = {b: f for b, f in (base.where if base else {}).items() if b not in touched}
        token, version = uuid.uuid4().hex, (base.version if base else 0) + 1
        create_once(spark, f"{path}/maps", f"{token}.json", json.dumps({"buckets": count, "where": kept | written}))
        if create_once(spark, f"{path}/heads", f"{version:010d}.json",
                       json.dumps({"version": version, "batch": batch, "map": token})):
            return True
        before, base = base, head(spark, path)
        if batch is not None and has_batch(spark, path, batch):
            return False
        if base.buckets != count:
            raise ValueError("the table was created with another number of buckets meanwhile")
        if any((before.where if before else {}).get(b) != base.where.get(b) for b in touched):
            written = None
    raise RuntimeError(f"{path} changed {attempts} times while a change was prepared")


def expire(spark: SparkSession, path: str, keep: int = 5) -> list[str]:
    """Delete the bucket folders that only versions before the last ``keep`` name. Heads
    stay, they say which batches were merged; folders that no version names are left
    alone, a writer may be at work there. Returns what was deleted."""
    maps = [json.loads(read_text(spark, f"{path}/heads/{n}"))["map"] for n in _heads(spark, path)]

    def named(tokens: list[str]) -> set[str]:
        out = set()
        for token in tokens:
            if f"{token}.json" in held:
                where = json.loads(read_text(spark, f"{path}/maps/{token}.json"))["where"]
                out |= {f"data/{folder}/bucket={b}" for b, folder in where.items()}
        return out

    held = set(names(spark, f"{path}/maps"))
    old = [t for t in maps[:-keep] if f"{t}.json" in held]
    gone = sorted(named(old) - named(maps[-keep:])) + [f"maps/{t}.json" for t in old]
    for name in gone:
        fs, target = _hadoop(spark, f"{path}/{name}")
        fs.delete(target, True)
    return gone
