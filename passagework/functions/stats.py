"""Summary statistics of a column by group, with quartiles by the *exclusive* method."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.cluster import cut


def exclusive_quantiles(values: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles (name: share) at position ``share * (n + 1)``, interpolated (or extrapolated for two
    values), of non-null values.

    Works on the counts of distinct values, dealt out by range of group and value and counted up
    within partitions, so that neither a hot group nor an ungrouped column is one task's work.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = values.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    order = [F.col(c).asc_nulls_first() for c in (*groups, value)]
    dealt = cut(counts.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_p", F.shiftright("_m", 33))
    sums = dealt.groupBy("_p").agg(F.sum("_c").alias("_w"))  # a row a partition
    shift = sums.select("_p", F.coalesce(F.sum("_w").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    upto = dealt.join(F.broadcast(shift), "_p").withColumn("_hi", F.col("_s") + F.sum("_c").over(Window.partitionBy("_p").orderBy("_m")))
    base = upto.groupBy(*groups).agg(F.min(F.col("_hi") - F.col("_c")).alias("_base"), F.sum("_c").alias("_n"))
    if groups:
        same = [F.col(f"u.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
        met = upto.alias("u").join(base.alias("b"), reduce(Column.__and__, same)).select(*[f"u.{g}" for g in groups], F.col(f"u.{value}").alias("_v"), "_hi", "_c", "_base", "_n")
    else:
        met = upto.select(F.col(value).alias("_v"), "_hi", "_c").crossJoin(base)  # one row
    hi, low = F.col("_hi") - F.col("_base"), F.col("_hi") - F.col("_base") - F.col("_c")
    aggs = []
    for name, share in shares.items():
        p = (F.col("_n") + 1) * share
        j = F.greatest(F.lit(1), F.least(F.floor(p), F.col("_n") - 1))
        aggs += [
            F.max(F.when((hi >= j) & (low < j), F.col("_v"))).cast("double").alias(f"_l_{name}"),
            F.max(F.when((hi >= j + 1) & (low < j + 1), F.col("_v"))).cast("double").alias(f"_h_{name}"),
            F.max(p - j).alias(f"_d_{name}"),
        ]
    found = met.groupBy(*groups).agg(*aggs)
    between = lambda n: F.coalesce(F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * F.col(f"_d_{n}"), F.col(f"_l_{n}")).alias(n)
    return found.select(*groups, *[between(n) for n in shares])


def summary(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """n, min, max, mean, median, stdev (0 for one value), p25 and p75 of non-null values."""
    held = df.where(F.col(value).isNotNull()).select(*groups, value)
    base = held.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"),
    )
    quantiles = exclusive_quantiles(held, groups, value, {"median": 0.5, "p25": 0.25, "p75": 0.75})
    if not groups:
        return base.where("n > 0").crossJoin(quantiles)  # one row each
    q = quantiles.select(*[F.col(g).alias(f"_q_{g}") for g in groups], "median", "p25", "p75")
    return base.join(q, reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_q_{g}")) for g in groups])).drop(*[f"_q_{g}" for g in groups])


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)
