"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master without that setting gets a scratch folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="noticelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, in a folder per value of ``by``, and
    read again: cuts the lineage, survives the loss of executors, and is computed once."""
    path = f"{shared_folder(df.sparkSession)}/noticelake-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Memo(dict):
    """A bounded cache of a pure function; emptied when full."""

    def __init__(self, fn, most: int = 200_000):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):
        value = self.fn(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value
