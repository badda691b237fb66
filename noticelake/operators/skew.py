"""Helpers for keys that hold a large share of all rows.

Aggregates and top-k operators need none of this: Spark combines aggregates, and
prunes ``row_number() <= k``, before the shuffle. Ordered windows have no such
partial form, so a hot key is cut into time chunks and each chunk is given what
it needs to know about the earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows of one key that a single task may hold.
HOT_ROWS = 500_000


def split_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys).

    There are at most rows / hot_rows hot keys, and the adaptive planner
    broadcasts them only after it has seen their real size."""
    hot = (df.groupBy(*keys).agg(F.count("*").alias("_rows"))
           .filter(F.col("_rows") > hot_rows).select(*keys))
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def with_history(df: DataFrame, keys: list[str], order: str, chunk: Column, k: int,
                 useful: Column) -> tuple[DataFrame, list[str]]:
    """Prepare a "last k useful rows" window for keys of any size.

    Rows get a ``_chunk``; every chunk is extended by the k useful rows that
    precede it, marked ``_history``. Windows partitioned by the returned columns
    see the same k predecessors a window over the whole key would see, and no
    task ever holds a whole key. Drop ``_history`` rows afterwards."""
    base = df.withColumn("_chunk", chunk)
    cols = [c for c in base.columns if c not in (*keys, "_chunk")]
    tail_order = Window.partitionBy(*keys, "_chunk").orderBy(F.col(order).desc())
    tails = (base.filter(useful).withColumn("_rn", F.row_number().over(tail_order))
             .filter(F.col("_rn") <= k)
             .groupBy(*keys, "_chunk")
             .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*cols).alias("_row"))))
                  .alias("_tail")))
    chunks = base.select(*keys, "_chunk").distinct().join(tails, [*keys, "_chunk"], "left")
    # A chunk with useful rows contributes at least one, so the k latest such
    # chunks hold the k predecessors.
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    filled = chunks.withColumn("_filled", F.count("_tail").over(by_chunk))
    recent = Window.partitionBy(*keys).orderBy("_filled").rowsBetween(1 - k, 0)
    carried = (filled.filter("_tail IS NOT NULL")
               .withColumn("_all", F.flatten(F.collect_list("_tail").over(recent)))
               .select(*keys, "_filled", F.slice(F.reverse("_all"), 1, k).alias("_rows")))
    need = filled.select(*keys, "_chunk", (F.col("_filled") - F.when(
        F.col("_tail").isNotNull(), 1).otherwise(0)).alias("_filled"))
    history = (need.join(carried, [*keys, "_filled"])
               .select(*keys, "_chunk", F.explode("_rows").alias("_r"))
               .select(*keys, "_chunk", "_r._row.*", F.lit(True).alias("_history")))
    extended = base.withColumn("_history", F.lit(False)).unionByName(history)
    return extended, [*keys, "_chunk"]
