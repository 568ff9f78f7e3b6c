"""Data behind pictures of an embedding space: balanced samples, histograms, heat maps, projections.

None of them writes a row a pair: pairs are counted inside the tasks that multiply them, and means of
pairs come from sums of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.cluster import cut
from passagework.operators import blocked, vectors


# -- the running balance of positives and negatives


@dataclass
class Step:
    """What a run of queries makes of the shortage (positives less negatives so far) before it.

    One query with ``p`` positives and ``a`` others takes min(a, max(1, shortage + p)) of them, so the
    shortage after it is that plus p - a where it is large, that plus p - 1 where it is small, and 0
    between.  Such functions, one after the other, stay monotone with slopes of 0 and 1; the
    stretches of slope 0 are kept here as (from, to, value), in order, and ``low`` is what is added
    below all of them.
    """

    flats: list[tuple[float, float, int]] = field(default_factory=list)
    low: int = 0

    def __call__(self, shortage: int) -> int:
        added = self.low
        for a, b, value in self.flats:
            if shortage < a:
                break
            if shortage <= b:
                return value
            added = value - int(b)
        return shortage + added

    def then(self, p: int, a: int) -> None:
        """Put one more query behind."""
        if a <= 0:
            self.flats, self.low = [(x, y, v + p) for x, y, v in self.flats], self.low + p
            return
        # shortages after the run so far, from ``bottom`` to ``top``, become 0
        bottom, top = 1 - p, a - p
        below = [(x, y, v + p - 1) for x, y, v in self.flats if v < bottom]
        above = [(x, y, v + p - a) for x, y, v in self.flats if v > top]
        inside = [f for f in self.flats if bottom <= f[2] <= top]
        first = inside[0][0] - (inside[0][2] - bottom) if inside else self._reached(bottom)
        last = inside[-1][1] + (top - inside[-1][2]) if inside else first + (top - bottom)
        self.flats, self.low = [*below, (first, last, 0), *above], self.low + p - 1

    def _reached(self, value: int) -> int:
        """The shortage that becomes ``value``, which is no flat's."""
        added = self.low
        for _, b, v in self.flats:
            if v > value:
                break
            added = v - int(b)
        return value - added


def take(p: int, a: int, shortage: int) -> int:
    """How many others a query takes."""
    return min(a, max(1, shortage + p))


def running_balance(counts: DataFrame, query_id: str = "query_id", parts: int | None = None) -> DataFrame:
    """``counts`` (query_id, positives, others) with ``taken``: in the order of the ids each query takes
    others, in rank order, until there are as many as positives over all queries so far, one at least.

    The order is a scan over the whole table: rows are dealt out by range of the id, every task sums
    up its rows as one ``Step``, the steps are run through one after the other (a few numbers a task), and
    every task then goes over its rows from the shortage that reached it.  Null counts are 0; rows
    without an id come first, in any order.
    """
    parts = parts or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counts.select(F.col(query_id), *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("positives", "others")])
    dealt = cut(rows.repartitionByRange(parts, query_id).sortWithinPartitions(query_id).withColumn("part", F.spark_partition_id()))

    def pairs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        return zip(batch.column("positives").to_pylist(), batch.column("others").to_pylist(), strict=True)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, part = Step(), None
        for batch in batches:
            for p, a in pairs(batch):
                step.then(p, a)
            part = batch.column("part")[0].as_py() if batch.num_rows else part
        if part is not None:
            flats = [{"a": x, "b": y, "v": v} for x, y, v in step.flats]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([step.low]), pa.array([flats], pa.list_(pa.struct([("a", pa.float64()), ("b", pa.float64()), ("v", pa.int64())])))], ["part", "low", "flats"])

    steps = dealt.mapInArrow(summed, "part int, low long, flats array<struct<a: double, b: double, v: long>>")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shortage = 0
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([shortage])], ["part", "shortage"])
                shortage = Step([(f["a"], f["b"], f["v"]) for f in r["flats"]], r["low"])(shortage)

    entered = steps.repartition(1).sortWithinPartitions("part").mapInArrow(chained, "part int, shortage long")  # a step at a time
    begins = {r["part"]: r["shortage"] for r in entered.collect()}  # a number a task

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shortage: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shortage = begins[batch.column("part")[0].as_py()] if shortage is None else shortage
            taken = []
            for p, a in pairs(batch):
                taken.append(take(p, a, shortage))
                shortage += p - taken[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (query_id, "positives", "others")), pa.array(taken, pa.int64())], [query_id, "positives", "others", "taken"])

    return dealt.mapInArrow(fold, f"`{query_id}` {rows.schema[query_id].dataType.simpleString()}, positives long, others long, taken long")


def balanced_sample(found: DataFrame, positives: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Of ``found`` (query_id, rank and more: no positives among them) what the running balance takes.

    ``positives``: query_id and positives, a row for each query.
    """
    placed = found.withColumn("_r", F.row_number().over(Window.partitionBy(query_id).orderBy("rank")))
    placed = cut(placed)
    others = placed.groupBy(query_id).agg(F.count(F.lit(1)).alias("others"))
    taken = running_balance(positives.join(others, query_id, "left"), query_id).select(query_id, "taken")
    return placed.join(taken, query_id).where(F.col("_r") <= F.col("taken")).drop("_r", "taken")


# -- histograms of pairs


def pair_histogram(queries: DataFrame, corpus: DataFrame, more: DataFrame, bins: int, digits: int = 6, query_id: str = "query_id", doc_id: str = "doc_id", vector: str = "vector", label: str = "label") -> DataFrame:
    """kind, bin (from 1) and n: scores of all pairs of equal label ("positive"; none with itself) and
    of ``more`` (kind, score), in ``bins`` equal widths between the least and the largest of all.

    Scores are rounded to ``digits``.  Pairs are met in blocks, once for their ends and once to be
    counted: a task gives a row a bin.
    """
    docs = corpus.select(F.col(doc_id).cast("long").alias("d"), F.col(label).alias("l"), F.col(vector).alias("v")).where("d is not null and v is not null and l is not null")
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(label).alias("l"), F.col(vector).alias("v")).where("q is not null and v is not null and l is not null")
    parts = blocked.parts_for(docs)

    def scores(part: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        ids, labels, rows = part.column("d").to_numpy(), part.column("l").to_numpy(zero_copy_only=False), blocked.matrix(part.column("v"))
        for batch in vectors.slices(batches, vectors.QUERIES_AT_ONCE):
            own, names, x = batch.column("l").to_numpy(zero_copy_only=False), batch.column("q").to_numpy(), blocked.matrix(batch.column("v"))
            for at in range(0, len(ids), vectors.DOCS_AT_ONCE):
                to = slice(at, at + vectors.DOCS_AT_ONCE)
                yield np.round((x @ rows[to].T)[(own[:, None] == labels[None, to]) & (names[:, None] != ids[None, to])], digits)

    def ends(part: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.min(), x.max()) for x in scores(part, batches) if len(x)]
        if held:
            yield pa.RecordBatch.from_pydict({"lo": [min(a for a, _ in held)], "hi": [max(b for _, b in held)]})

    more = cut(more.select("kind", F.round(F.col("score"), digits).alias("score")).where(F.col("score").isNotNull()))
    met = blocked.meet(docs, asked, parts, blocked.part_of(parts, "d"), ends, "lo double, hi double")
    both = met.unionAll(more.agg(F.min("score"), F.max("score"))).agg(F.min("lo"), F.max("hi")).first()
    if both[0] is None:
        return corpus.sparkSession.createDataFrame([], "kind string, bin int, n long")
    lo, hi = both

    def counted(part: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int64)
        for x in scores(part, batches):
            at = np.minimum(np.floor((x - lo) / (hi - lo) * bins), bins - 1).astype(np.int64) if hi > lo else np.zeros(len(x), np.int64)
            total += np.bincount(at, minlength=bins)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(["positive"] * len(some), pa.string()), pa.array((some + 1).astype(np.int32)), pa.array(total[some])], ["kind", "bin", "n"])

    at = F.least(F.floor((F.col("score") - lo) / (hi - lo) * bins), F.lit(bins - 1)) if hi > lo else F.lit(0)
    rest = more.select("kind", (at + 1).cast("int").alias("bin")).groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"))
    own = blocked.meet(docs, asked, parts, blocked.part_of(parts, "d"), counted, "kind string, bin int, n long")
    return own.unionByName(rest).groupBy("kind", "bin").agg(F.sum("n").alias("n"))


# -- heat map and projection


def heat_map(rows: DataFrame, key: str = "id", vector: str = "vector", label: str = "label") -> DataFrame:
    """label, other, pairs and mean: the mean inner product of rows of two labels; within one label
    without pairs of a row with itself, and null where there is no pair.

    The sum over all pairs is the product of the labels' sums, so only those (a vector a label) meet.
    """
    held = rows.select(F.col(label).alias("label"), F.col(vector).alias("v")).where("label is not null and v is not null")
    by_dim = held.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("s2"), F.count(F.lit(1)).alias("n"))
    sums = cut(by_dim.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("s"), F.sum("s2").alias("s2"), F.max("n").alias("n")))  # a row a label
    kind = rows.schema[label].dataType.simpleString()
    parts = blocked.parts_for(sums)

    def visit(part: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        names, n, s, s2 = part.column("label"), part.column("n").to_numpy(), blocked.matrix(part.column("s")), part.column("s2").to_numpy()
        key = names.to_numpy(zero_copy_only=False)
        for batch in vectors.slices(batches, 64):
            own = batch.column("label").to_numpy(zero_copy_only=False)[:, None] == key[None, :]
            pairs = batch.column("n").to_numpy()[:, None] * n[None, :] - np.where(own, n[None, :], 0)
            total = blocked.matrix(batch.column("s")) @ s.T - np.where(own, s2[None, :], 0.0)
            q, d = (x.ravel() for x in np.indices(own.shape))
            means = np.divide(total, pairs, out=np.zeros_like(total), where=pairs > 0).ravel()
            yield pa.RecordBatch.from_arrays([batch.column("label").take(pa.array(q)), names.combine_chunks().take(pa.array(d)), pa.array(pairs.ravel()), pa.array(means, mask=pairs.ravel() == 0)], ["label", "other", "pairs", "mean"])

    return blocked.meet(sums, sums, parts, blocked.part_of(parts, "label"), visit, f"label {kind}, other {kind}, pairs long, mean double")


@dataclass(frozen=True)
class Components:
    """Principal components: the mean, the components (rows), and the variance along each."""

    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray

    def place(self, vector: Column) -> Column:
        """Coordinates of a vector, an array of one number a component."""
        centred = F.zip_with(vector, F.lit(self.mean.tolist()), lambda x, m: x.cast("double") - m)
        return F.transform(F.array(centred), lambda c: F.array(*[F.aggregate(F.zip_with(c, F.lit(axis.tolist()), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for axis in self.axes]))[0]


def principal(rows: DataFrame, k: int = 2, vector: str = "vector") -> Components:
    """The first ``k`` principal components of all vectors (population variance).

    Tasks add up their rows and the rows' products; what reaches the driver is a vector and a matrix a
    task.  The sign of a component is that of its largest entry.  Null vectors don't count.
    """
    held = rows.select(F.col(vector).alias("v")).where("v is not null")
    dims = held.select(F.max(F.size("v"))).first()[0] or 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = blocked.matrix(batch.column("v"))
            if len(x):
                n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total.tolist()], "square": [square.ravel().tolist()]})

    met = held.mapInArrow(sums, "n long, total array<double>, square array<double>")
    cells = met.select("n", F.concat("total", "square").alias("x")).select("n", F.posexplode("x").alias("i", "x"))  # combined before the shuffle
    added = cells.groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("i").collect()  # dims + dims^2 numbers
    n, x = (added[0]["n"], np.array([r["x"] for r in added])) if added else (0, np.zeros(dims + dims * dims))
    mean = x[:dims] / max(n, 1)
    values, axes = np.linalg.eigh(x[dims:].reshape(dims, dims) / max(n, 1) - np.outer(mean, mean))
    order = np.argsort(-values)[:k]
    axes = axes[:, order].T
    signs = np.sign(axes[np.arange(len(axes)), np.argmax(np.abs(axes), axis=1)])
    return Components(mean, axes * np.where(signs == 0, 1, signs)[:, None], values[order])
