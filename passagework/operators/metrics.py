"""Ranking metrics from ranked results with a relevance mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ideal(n_rel: Column, k: Column) -> Column:
    """Discounted gain of the best ranking of ``n_rel`` relevant documents."""
    top = F.least(n_rel, k)
    return F.when(top > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(top, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))).otherwise(0.0)


def per_query(ranked: DataFrame, n_rel: DataFrame, ks: list[int]) -> DataFrame:
    """query_id, k and every metric.  ``ranked``: query_id, rank, hit; ``n_rel``: query_id, n_rel
    (one row for each query that counts, also those without any result)."""
    by = Window.partitionBy("query_id").orderBy("rank")
    marked = ranked.select("query_id", "rank", F.col("hit").cast("int").alias("hit"))
    marked = marked.withColumn("cum", F.sum("hit").over(by))
    each = n_rel.select("query_id", "n_rel", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    inside = (F.col("rank") <= F.col("k")) & (F.col("hit") == 1)
    sums = each.join(marked, "query_id", "left").groupBy("query_id", "k", "n_rel").agg(
        F.coalesce(F.sum(F.when(inside, 1)), F.lit(0)).alias("hits"),
        F.min(F.when(inside, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(inside, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.sum(F.when(inside, F.col("cum") / F.col("rank"))), F.lit(0.0)).alias("precisions"),
    )
    some = F.col("n_rel") > 0
    return sums.select(
        "query_id", "k", "n_rel", "hits", "first",
        (F.col("hits") > 0).cast("double").alias("accuracy"),
        (F.col("hits") / F.col("k")).alias("precision"),
        F.when(some, F.col("hits") / F.col("n_rel")).otherwise(0.0).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(some, F.col("dcg") / ideal(F.col("n_rel"), F.col("k"))).otherwise(0.0).alias("ndcg_full"),
        F.coalesce(1.0 / F.log2(F.col("first") + 1.0), F.lit(0.0)).alias("ndcg_first"),
        F.when(some, F.col("precisions") / F.least("k", "n_rel")).otherwise(0.0).alias("map_lib"),
        F.when(some, F.col("precisions") / F.col("n_rel")).otherwise(0.0).alias("map_all"),
    )


def mean(rows: DataFrame, metric: str, *groups: str) -> DataFrame:
    return rows.groupBy(*groups).agg(F.round(F.avg(metric), 9).alias("value"))


def normalize_ks(ks: list[int] | int | None, corpus_size: int) -> list[int]:
    """Default 1, 3, 5, 10; kept between 1 and the corpus' size, never empty."""
    wanted = [1, 3, 5, 10] if ks is None else [ks] if isinstance(ks, int) else list(ks)
    return sorted({k for k in wanted if 1 <= k <= corpus_size}) or [min(max(1, corpus_size), 1)]


def parse_ks(text: str | None) -> list[int]:
    found = [int(x) for x in (text or "").split(",") if x.strip().isdigit()]
    return found or [1, 3, 5, 10, 20]


def primary_metric(names: list[str]) -> str | None:
    """The NDCG of the largest k, else MRR, else accuracy."""
    for kind in ("ndcg", "mrr", "accuracy"):
        found = [n for n in names if f"{kind}@" in n.lower()]
        if found:
            return max(found, key=lambda n: int(n.rpartition("@")[2]))
    return None


def early_stopping(values: list[float], patience: int, warmup: int, larger_is_better: bool = True) -> int | None:
    """The step at which training would stop: no gain for ``patience`` evaluations (half as many
    again while the step is within twice the warm-up), or None."""
    best, waited = None, 0
    for step, value in enumerate(values, 1):
        if best is None or (value > best if larger_is_better else value < best):
            best, waited = value, 0
            continue
        waited += 1
        if waited >= (patience * 1.5 if step <= 2 * warmup else patience):
            return step
    return None
