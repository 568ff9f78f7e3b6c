"""Connected components of a table of links, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import discard, materialise

#: Nodes of more links than HOT are met by broadcast (there are few of them), the others by a shuffle.
HOT, MAX_ROUNDS = 200_000, 100


def _meet(rows: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """``rows`` (a, b) with ``m``, the node that ``least`` (a, m, deg) has for their ``a``."""
    if links <= HOT:
        return rows.join(least.drop("deg"), "a")
    hot = F.broadcast(least.where(F.col("deg") > HOT).drop("deg"))  # at most 2 * links / HOT rows
    cold = rows.join(hot.select("a"), "a", "left_anti").join(least.where(F.col("deg") <= HOT).drop("deg"), "a")
    return rows.join(hot, "a").unionByName(cold)


def components(links: DataFrame, a: str = "a", b: str = "b", label: str = "comp") -> DataFrame:
    """Every node of ``links`` with the smallest node of its component.

    Alternating large-star and small-star: links are turned to ever smaller nodes until each node
    points at its component's smallest.  Minima are combined before they are shuffled, a hot node's
    links are never one task's, and each round is a table of its own, so a lost executor costs one
    round at most.  Links with a null end, and those of a node with itself, link nothing; repeated
    ones count once.  No links, no rows.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    pairs = materialise(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    count = F.count(F.lit(1)).alias("deg")
    n = pairs.count()  # rounds never add links
    for _ in range(MAX_ROUNDS):
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), count).select("a", F.least("a", "m").alias("m"), "deg")
        large = _meet(both.where(F.col("b") > F.col("a")), least, n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), count)
        small = _meet(large, low, n).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = materialise(small.where(F.col("a") != F.col("b")).distinct(), "links")
        discard(pairs)
        pairs = after
        # settled when no node has two parents and no parent has a parent
        multiple = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        deep = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a")
        if multiple.unionAll(deep).isEmpty():
            break
    else:
        raise RuntimeError(f"components aren't settled after {MAX_ROUNDS} rounds")
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias(label))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias(label)).unionAll(roots)
