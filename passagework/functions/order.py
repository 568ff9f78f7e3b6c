"""Deterministic order and sampling.

Random choices are replaced by the order of ``md5(seed:key)``.  Positions are counted in two steps
(rows within a hash bucket, then bucket offsets), so that numbering a table, or one hot group of it,
is never the work of a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.cluster import cut


def hash_key(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_number(seed: int, *keys: Column) -> Column:
    """The first 32 bits of the hash."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("long")


def digits_for(rows: int, a_bucket: int = 50_000) -> int:
    """Hexadecimal digits of a hash that make buckets of about ``a_bucket`` rows."""
    digits = 1
    while digits < 8 and rows > a_bucket * 16**digits:
        digits += 1
    return digits


def positions(df: DataFrame, groups: list[str], key: str, out: str = "pos", total: str = "total", digits: int = 2) -> DataFrame:
    """``df`` with the place (from 0) of each row in its group by ``key`` (a hexadecimal hash) and
    the group's size.  Equal keys are the same row's; ties are taken in any order.  ``digits`` of the
    hash make a bucket, so they should grow with the table (``digits_for``)."""
    bucket = df.withColumn("_b", F.substring(key, 1, digits))
    counts = bucket.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    offsets = counts.select(
        *groups, "_b",
        F.coalesce(F.sum("_n").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(by).alias(total),
    )
    within = bucket.withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(key)))
    return within.join(offsets, [*groups, "_b"]).withColumn(out, F.col("_before") + F.col("_r") - 1).drop("_b", "_before", "_r")


def number_rows(df: DataFrame, *order: Column | str, out: str = "n", first: int = 1, parts: int | None = None) -> DataFrame:
    """Consecutive numbers in the given order over the whole table; null keys come first.

    Rows are dealt out by range and sorted once; the dealt table is a checkpoint, for a second
    evaluation could draw other range bounds.  A row's partition and its place there are read from
    one number, and each partition is shifted by the sizes of those before it.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit(2**33 - 1))
    sizes = dealt.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    shift = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return dealt.withColumn("_p", part).join(F.broadcast(shift), "_p").withColumn(out, F.col("_s") + place + F.lit(first)).drop("_p", "_m", "_s")
