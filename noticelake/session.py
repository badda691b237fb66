"""Session settings and lineage cutting shared by all jobs."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # Every timestamp in the library is UTC; local times are converted on parse.
    "spark.sql.session.timeZone": "UTC",
    # Shuffles are sized, and skewed joins split, from runtime statistics.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows here are small and costly (texts, vectors): a megabyte of ids can be
    # minutes of scoring, so small shuffles still spread over the cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # A compressed megabyte of such rows takes some 25 in the sorts and hash tables of one
    # task; at the default of 64 MB that is 1.7 GB, where joins and aggregates share a stage.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Newest-k per group is pruned before the shuffle up to this k.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Payload pages are ~100 KB each; this keeps an Arrow batch near 100 MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Shuffle files go with their job; until a garbage collection finds them, those of all
    # steps of a batch would lie side by side.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "noticelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; cluster sizing stays with the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def checkpoint_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master without it gets a scratch folder of its
    own, on a cluster the missing setting is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="noticelake-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: computed once, columnar, and
    with a size the planner knows. For results that several plans read."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if getattr(_local, "tables", None):
        _local.tables[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_local = threading.local()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`written` makes within are deleted at the end: for intermediate
    results of a job that has stored what came of them."""
    open_ = _local.tables = getattr(_local, "tables", [])
    open_.append([])
    try:
        yield
    finally:
        for path in open_.pop():
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of ``df`` in the folder the cluster names.

    Reads ``spark.checkpoint.dir``. Only a local master without that setting
    gets a scratch folder of its own; on a cluster a machine-local folder would
    not survive the loss of an executor, so the missing setting is an error.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=eager)
