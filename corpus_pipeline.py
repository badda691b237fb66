"""A corpus pipeline over ``documents``: quality rules, near-duplicates, benchmark
passages, personal data, packing. Each stage works on all rows the one before kept.

Nulls, empty texts, repeated rows and ids and further columns are met as the
operators describe: a null text fails the quality rules, of equal documents one stays,
a null id is a document like any other. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticelake.llm import decontaminate, packing, pii, repetition, simhash
from noticelake.llm.common import stored
from noticelake.llm.queries import PII_KEY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the repetition rules reject."""
    return repetition.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark items."""
    return decontaminate.drop(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; ``n_chars`` follows."""
    out = pii.replace(docs, PII_KEY)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("pii_surrogates", personal_data),
    ("best_fit_packing", packed),
]

#: Retrieval, surrogates and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over ``documents``; stages hand over written tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = stored(docs)
    return docs
