"""Losses as evaluation queries: sampled negatives, in-batch negatives, distillation.

Random draws are replaced by hash order.  For sampled negatives the corpus stands in a ring, in the
order of ``md5(seed:id)``; a query starts at a place of its own hash and takes the first ``n``
documents that are no positives of its.  The ring is dealt to tasks in stretches, a query goes to the
stretches that it needs, and what comes back is its scores in ring order, so neither vectors nor
documents are joined pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.cluster import cut
from passagework.functions.order import digits_for, hash_key, hash_number, positions
from passagework.operators import blocked, vectors

#: Places of the ring in one stretch.
STRETCH = 8_192


def ring(corpus: DataFrame, seed: int, doc_id: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """d, l, v and pos (from 0) of the documents that count, and how many they are."""
    docs = corpus.select(F.col(doc_id).cast("long").alias("d"), F.col(label).alias("l"), F.col(vector).alias("v")).where("d is not null and l is not null and v is not null")
    total = docs.count()
    placed = positions(docs.withColumn("_h", hash_key(seed, F.col("d"))), [], "_h", digits=digits_for(total))
    return cut(placed.select("d", "l", "v", "pos")), total


def sampled_negatives(queries: DataFrame, corpus: DataFrame, n: int, temperature: float = 1.0, seed: int = 42, query_id: str = "query_id", doc_id: str = "doc_id", vector: str = "vector", label: str = "label") -> DataFrame:
    """q, negatives (ids) and scores (divided by the temperature) of the ``n`` sampled of each query, in order.

    Positives are the documents of the query's label.  Every query has the smaller of ``n`` and the
    number of other documents.  A first stretch is half as long again as ``n``; queries that met too
    many positives there go on from its end, twice as far, until they have enough or have been round.
    Rows without id, label or vector take no part.
    """
    held, total = ring(corpus, seed, doc_id, vector, label)
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(label).alias("l"), F.col(vector).alias("v")).where("q is not null and l is not null and v is not null")
    shape = "q long, at long, negatives array<long>, scores array<double>"
    if not total or n <= 0:
        return corpus.sparkSession.createDataFrame([], "q long, negatives array<long>, scores array<double>")
    stretches = -(-total // STRETCH)

    def visit(part: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = part.sort_by("pos")
        places, ids, labels, rows = part.column("pos").to_numpy(), part.column("d").to_numpy(), part.column("l").to_numpy(zero_copy_only=False), blocked.matrix(part.column("v"))
        for batch in vectors.slices(batches, 64):
            scores = blocked.matrix(batch.column("v")) @ rows.T / temperature
            own, low, high = batch.column("l").to_numpy(zero_copy_only=False), batch.column("low").to_numpy(), batch.column("high").to_numpy()
            found = []
            for i in range(batch.num_rows):
                a, b = np.searchsorted(places, (low[i], high[i]))
                mine = a + np.flatnonzero(labels[a:b] != own[i])[:n]  # no more than n of a stretch can be among the first n
                found.append((ids[mine].tolist(), scores[i, mine].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("at"), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.float64()))], ["q", "at", "negatives", "scores"])

    # ``begin`` is the place on the ring unrolled: it may run beyond the end, by one round at most
    open_ = asked.withColumn("start", F.pmod(hash_number(seed, F.lit("q"), F.col("q")), F.lit(total))).withColumn("done", F.lit(0).cast("long")).withColumn("have", F.lit(0).cast("long"))
    length, gathered = n + n // 2 + 16, None
    while True:
        reach = F.least(F.lit(total), F.col("done") + length)
        spans = open_.withColumn("low", F.col("start") + F.col("done")).withColumn("high", F.col("start") + reach)
        first, last = F.floor(F.col("low") / STRETCH).cast("long"), F.floor((F.col("high") - 1) / STRETCH).cast("long")
        # a span is taken apart at the ring's end and at the stretches' borders
        turns = spans.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("low", F.greatest(F.col("low") - F.col("turn") * total, F.lit(0))).withColumn("high", F.least(F.col("high") - F.col("turn") * total, F.lit(total))).where("low < high")
        asks = turns.withColumn("part", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        asks = asks.withColumn("at", F.greatest(F.col("low"), F.col("part") * STRETCH) + F.col("turn") * total)  # place unrolled: the order of the pieces
        asks = asks.select("part", "q", "l", "v", F.col("at").cast("long").alias("at"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
        met = blocked.stream(held.withColumn("part", F.floor(F.col("pos") / STRETCH).cast("int")), asks, stretches, visit, shape)
        gathered = cut(met if gathered is None else gathered.unionAll(met))
        have = gathered.groupBy("q").agg(F.sum(F.size("scores")).cast("long").alias("have"))
        open_ = cut(open_.drop("have").withColumn("done", reach).join(have, "q", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).where((F.col("have") < n) & (F.col("done") < total)))
        if open_.isEmpty():
            break
        length *= 2
    pieces = gathered.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("at", "negatives", "scores"))).alias("p"))  # a few pieces a query
    joined = lambda name: F.slice(F.flatten(F.transform("p", lambda x: x[name])), 1, n).alias(name)
    return pieces.select("q", joined("negatives"), joined("scores"))


def sampled_losses(queries: DataFrame, corpus: DataFrame, n: int = 1000, temperature: float = 0.05, seed: int = 42, query_id: str = "query_id", doc_id: str = "doc_id", vector: str = "vector", label: str = "label") -> DataFrame:
    """query_id, positives and loss: the cross-entropies, summed, of each positive against the query's
    sampled negatives.  Queries without any negative have none."""
    drawn = sampled_negatives(queries, corpus, n, temperature, seed, query_id, doc_id, vector, label)
    top = F.array_max("scores")
    sums = drawn.where(F.size("scores") > 0).select("q", (top + F.log(F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - top)))).alias("t"))
    return vectors.contrast_losses(queries, corpus, temperature, query_id, doc_id, vector, label, against=cut(sums))


def batched(rows: DataFrame, size: int, key: str, seed: int = 42) -> DataFrame:
    """``rows`` with batch (from 0) and place in it: dealt out ``size`` at a time in hash order of ``key``;
    the last batch may be shorter."""
    total = rows.count()
    placed = positions(rows.withColumn("_h", hash_key(seed, F.col(key))), [], "_h", digits=digits_for(total))
    return placed.withColumn("batch", F.floor(F.col("pos") / size).cast("long")).withColumn("place", F.pmod("pos", F.lit(size)).cast("int")).drop("_h", "pos", "total")


def in_batch(rows: DataFrame, scale: float = 0.05, key: str = "id", query: str = "query", positive: str = "positive", extra: str | None = None) -> DataFrame:
    """batch, key, score (the cosine of the row's own pair, times ``scale``) and loss: the cross-entropy
    of each query's own positive against all positives of its batch, and its ``extra`` vectors (a hard
    negative a row, if given; null ones are left out).

    ``rows`` have batch (``batched``); those without a query or positive vector don't count.  A task
    multiplies one batch at a time.
    """
    if scale <= 0:
        raise ValueError("the scale must be positive")
    kind = rows.schema[key].dataType.simpleString()

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        x = blocked.matrix(column)
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)

    def run(table: pa.Table) -> pa.Table:
        candidates = unit(table.column("b"))
        if extra is not None and table.column("c").null_count < table.num_rows:
            candidates = np.concatenate([candidates, unit(table.column("c").drop_null())])
        scores = unit(table.column("a")) @ candidates.T * scale
        own = np.diagonal(scores)
        return pa.table({"batch": table.column("batch"), key: table.column(key), "score": pa.array(own), "loss": pa.array(np.logaddexp.reduce(scores, axis=1) - own)})

    held = rows.select("batch", key, F.col(query).alias("a"), F.col(positive).alias("b"), (F.col(extra) if extra else F.lit(None).cast("array<double>")).alias("c"))
    return held.where("a is not null and b is not null").groupBy("batch").applyInArrow(run, f"batch long, `{key}` {kind}, score double, loss double")


def distillation(rows: DataFrame, student: str = "student", teacher: str = "teacher", *groups: str) -> DataFrame:
    """groups, pairs and mse: the mean squared difference of two models' vectors, over rows and dimensions;
    rows that one model lacks don't count."""
    both = rows.where(F.col(student).isNotNull() & F.col(teacher).isNotNull())
    gaps = F.aggregate(F.zip_with(student, teacher, lambda a, b: (a.cast("double") - b.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    return both.groupBy(*groups).agg(F.count(F.lit(1)).alias("pairs"), (F.sum(gaps) / F.sum(F.size(student))).alias("mse"))


def warmup_cosine(step: int, total: int, ratio: float = 0.1, least: int = 10) -> float:
    """Share of the learning rate at a step: in proportion over the warm-up, then half a cosine down to 0."""
    warm = max(least, int(total * ratio))
    if step < warm:
        return step / max(1, warm)
    return max(0.0, (1 + math.cos(math.pi * min(1.0, (step - warm) / max(1, total - warm)))) / 2)
