"""Expectations on stored tables; every check is one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noticelake.schemas import ENUMS


def enum_violations(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows per column whose value is outside its vocabulary ({column: enum})."""
    bad = [F.struct(F.lit(c).alias("column_name"),
                    (F.col(c).isNull() | ~F.col(c).isin(*ENUMS[e])).cast("int").alias("bad"))
           for c, e in columns.items()]
    return (df.select(F.explode(F.array(*bad)).alias("x")).groupBy("x.column_name")
            .agg(F.sum("x.bad").alias("violations"), F.count("*").alias("rows")))


def split_by_enum(df: DataFrame, column: str, enum: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows)."""
    ok = F.coalesce(F.col(column).isin(*ENUMS[enum]), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def version_gaps(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose version numbers are not exactly 1..n; empty when all is well."""
    return (versions.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("version_no").alias("low"), F.max("version_no").alias("high"),
        F.count_distinct("version_no").alias("distinct_numbers"))
        .filter("low <> 1 OR high <> n OR distinct_numbers <> n"))


def replay_is_idempotent(outcomes: DataFrame) -> DataFrame:
    """Outcome counts of a repeated merge; new and changed must be zero."""
    n = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0))
    return outcomes.agg(n("new").alias("items_new"), n("changed").alias("items_changed")).withColumn(
        "idempotent", (F.col("items_new") == 0) & (F.col("items_changed") == 0))
