"""Connected components by randomized contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noticelake.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) -> (node, root): nodes of one component share a root.

    Each round every node joins its neighbour of the lowest random rank, and the
    links are rewritten between the joined nodes; a fixed share of the nodes goes
    each round, so chains of any length take a logarithmic number of rounds. The
    neighbours of a node are only reduced to a minimum, never gathered, and every
    round is a written table. Null ends and loops are no links."""
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        def rank(c: str, k=len(rounds)):
            return F.struct(F.xxhash64(F.col(c), F.lit(k)), F.col(c).alias("n"))
        both = links.union(links.select("b", "a"))
        joined = stored(both.groupBy("a").agg(F.min(rank("b")).alias("low")).select(
            F.col("a").alias("node"), F.least("low", rank("a"))["n"].alias("root")))
        rounds.append(joined)
        ends = joined.select(F.col("node").alias("a"), F.col("root").alias("x"))
        others = joined.select(F.col("node").alias("b"), F.col("root").alias("y"))
        links = stored(links.join(ends, "a").join(others, "b").where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = rounds.pop()
    while rounds:
        later = label.select(F.col("node").alias("root"), F.col("root").alias("final"))
        label = rounds.pop().join(later, "root", "left").select("node", F.coalesce("final", "root").alias("root"))
    return stored(label)
