"""Hard negatives in tiers, by ring sampling: linear in the number of pairs.

A tier is a grouping of the pool.  Within each group the pool stands in a ring, in hash order; a
pair starts at a place given by its own hash and takes candidates from there on.  Its stretch is as
long as it could need: the wanted number, the candidates that earlier tiers can have used, and its
own family (same parent).  A family of more than SMALL is not walked through: neighbours of one
parent are a *run*, no two runs of one parent are neighbours, so a pair of a large family looks at
the heads of as many runs as it could need.  No pair ever meets its whole group or family.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.order import digits_for, hash_key, hash_number, positions

#: Families up to this size are passed by a longer stretch, larger ones by runs.
SMALL = 16


def with_runs(placed: DataFrame, groups: list[str]) -> DataFrame:
    """``placed`` (positions in ``pos``) with ``run``, the number of the row's run of equal parents
    in its ring, and ``at``, the place in that run.

    Rows are compared within buckets of positions; buckets are chained by one row each.
    """
    rows = placed.withColumn("_k", F.floor(F.col("pos") / 10_000))
    inside = Window.partitionBy(*groups, "_k").orderBy("pos")
    rows = rows.withColumn("_new", F.when(F.row_number().over(inside) == 1, 0).otherwise((~F.col("parent_id").eqNullSafe(F.lag("parent_id").over(inside)) | F.col("parent_id").isNull()).cast("int")))
    rows = rows.withColumn("_runs", F.sum("_new").over(inside)).withColumn("_from", F.max(F.when(F.col("_new") == 1, F.col("pos"))).over(inside))
    ends = rows.groupBy(*groups, "_k").agg(
        F.min(F.struct("pos", "parent_id"))["parent_id"].alias("_first"), F.max(F.struct("pos", "parent_id"))["parent_id"].alias("_last"),
        F.sum("_new").alias("_starts"), F.max("_from").alias("_last_from"), F.min("pos").alias("_low"),
    )
    chain = Window.partitionBy(*groups).orderBy("_k") if groups else Window.partitionBy(F.lit(0)).orderBy("_k")
    joins = F.coalesce(F.col("_first") == F.lag("_last").over(chain), F.lit(False))
    ends = ends.withColumn("_joins", joins).withColumn("_opens", F.when(F.col("_joins"), F.lit(None)).otherwise(F.col("_low")))
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *groups, "_k", (F.coalesce(F.sum(F.col("_starts") + (~F.col("_joins")).cast("int")).over(before), F.lit(0)) - F.col("_joins").cast("int")).alias("_skip"),
        F.coalesce("_opens", F.last(F.coalesce("_last_from", "_opens"), ignorenulls=True).over(before)).alias("_open"),
    )
    out = rows.join(ends, [*groups, "_k"])
    return out.withColumn("run", F.col("_skip") + F.col("_runs")).withColumn("at", F.col("pos") - F.coalesce("_from", "_open")).drop("_k", "_new", "_runs", "_from", "_skip", "_open")


def placed_ring(pool: DataFrame, groups: list[str], seed: int, digits: int) -> DataFrame:
    """The pool (id, parent_id, groups) with place and size of its ring."""
    return positions(pool.withColumn("_h", hash_key(seed, F.col("id"))), groups, "_h", digits=digits).select(*dict.fromkeys([*groups, "pos", "total", "id", "parent_id"]))


def ring(pairs: DataFrame, pool: DataFrame, groups: list[str], stretch: Column | int, tier: int, seed: int, salt: str, digits: int = 2) -> DataFrame:
    """pair, parent_id, cand, cand_parent, tier, step: the next ``stretch`` (a number, or of pairs'
    columns) places of each pair's ring."""
    placed = placed_ring(pool, groups, seed, digits)
    asked = _asked(_starts(pairs, placed, groups, stretch if isinstance(stretch, Column) else F.lit(stretch), seed, salt))
    return _met(asked, placed.drop("total"), [*groups, "pos"], tier)


def _starts(pairs: DataFrame, placed: DataFrame, groups: list[str], stretch: Column, seed: int, salt: str) -> DataFrame:
    totals = placed.groupBy(*groups).agg(F.max("total").alias("total"))
    starts = pairs.withColumn("_l", stretch).select(*dict.fromkeys(["id", "parent_id", *groups, "_l"]))
    starts = starts.join(totals, groups) if groups else starts.crossJoin(totals)  # a single number
    return starts.where("total > 0").withColumn("start", F.pmod(hash_number(seed, F.lit(salt), F.col("id")), F.col("total")))


def _asked(starts: DataFrame) -> DataFrame:
    steps = F.explode(F.sequence(F.lit(0), F.least("_l", "total").cast("int") - 1))
    return starts.withColumn("step", steps).withColumn("pos", F.pmod(F.col("start") + F.col("step"), F.col("total"))).drop("total", "start", "_l")


def _met(asked: DataFrame, placed: DataFrame, on: list[str], tier: int) -> DataFrame:
    held = placed.select(*on, F.col("id").alias("cand"), F.col("parent_id").alias("cand_parent"))
    return asked.join(held, on).select(F.col("id").alias("pair"), "parent_id", "cand", "cand_parent", F.lit(tier).alias("tier"), F.col("step").cast("long").alias("step"))


def beyond(pairs: DataFrame, pool: DataFrame, groups: list[str], need: int, tier: int, seed: int, salt: str, digits: int) -> DataFrame:
    """As ``ring``, for pairs whose family is large: the first ``need`` members of each of the
    ``2 * need + 3`` runs after the place where the pair starts.  Every second run at least is of
    another family, so that these, with the ``need`` places at the start, hold ``need`` candidates
    if the ring has them."""
    placed = with_runs(placed_ring(pool, groups, seed, digits), groups)
    by = [*groups, "pos"]
    runs = placed.groupBy(*groups).agg((F.max("run") + 1).alias("n_runs"))
    starts = _starts(pairs, placed, groups, F.lit(1), seed, salt).withColumnRenamed("start", "pos").drop("_l").join(placed.select(*by, "run"), by)
    starts = starts.join(runs, groups) if groups else starts.crossJoin(runs)  # a single number
    ahead = F.explode(F.sequence(F.lit(0), F.least(F.lit(2 * need + 3), F.col("n_runs") - 1).cast("int")))
    asked = starts.withColumn("ahead", ahead).withColumn("run", F.pmod(F.col("run") + F.col("ahead"), F.col("n_runs"))).withColumnRenamed("pos", "start")
    heads = placed.where(F.col("at") < need).select(*groups, "run", "pos", F.col("id").alias("cand"), F.col("parent_id").alias("cand_parent"))
    met = asked.join(heads, [*groups, "run"])
    return met.select(F.col("id").alias("pair"), "parent_id", "cand", "cand_parent", F.lit(tier).alias("tier"), F.pmod(F.col("pos") - F.col("start"), F.col("total")).alias("step"))


def families(pool: DataFrame) -> tuple[DataFrame, int, int]:
    """parent_id and ``family``, its size; the number of rows and the largest family."""
    sizes = pool.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count(F.lit(1)).alias("family"))
    shape = pool.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("parent_id").isNotNull()).alias("named")).agg(F.sum("n"), F.max(F.when(F.col("named"), F.col("n")))).first()
    return sizes, shape[0] or 0, shape[1] or 0


def not_kin(found: DataFrame) -> DataFrame:
    """Without the pair itself and those of its parent."""
    return found.where(~((F.col("cand") == F.col("pair")) | F.coalesce(F.col("cand_parent") == F.col("parent_id"), F.lit(False))))


def tiered_candidates(pairs: DataFrame, pool: DataFrame, tiers: list[list[str]], n: int, seed: int) -> DataFrame:
    """pair, cand, tier, step: as many candidates of each tier as a pair could need."""
    sizes, rows, largest = families(pool)
    digits = digits_for(rows)
    known = pairs.join(sizes, "parent_id", "left").withColumn("family", F.coalesce("family", F.lit(1)))
    found = []
    for t, groups in enumerate(tiers):
        need, salt = (t + 1) * n + 1, f"tier{t + 1}"
        found.append(ring(known, pool, groups, F.lit(need) + F.least("family", F.lit(SMALL)), t + 1, seed, salt, digits))
        if largest > SMALL:
            found.append(beyond(known.where(F.col("family") > SMALL), pool, groups, need, t + 1, seed, salt, digits))
    return not_kin(reduce(DataFrame.unionByName, found))


def tiered(pairs: DataFrame, pool: DataFrame, tiers: list[list[str]], n: int, seed: int = 42) -> DataFrame:
    """pair, negatives (ids in order of tier and ring), tiers_used.

    ``pairs`` and ``pool`` have id, parent_id and the columns that ``tiers`` group by.  Never the
    pair itself nor one of its parent.
    """
    found = tiered_candidates(pairs, pool, tiers, n, seed)
    once = found.groupBy("pair", "cand").agg(F.min(F.struct("tier", "step")).alias("at"))
    by = Window.partitionBy("pair").orderBy("at", "cand")
    kept = once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
    listed = kept.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("at", "cand"))).alias("l"))
    return listed.select("pair", F.transform("l", lambda x: x["cand"]).alias("negatives"), F.transform("l", lambda x: x["at"]["tier"]).alias("tiers_used"))
