"""A vector index that is saved as tables and searched cell by cell.

``build`` fits centroids to a bounded sample (sums and counts of each cell are added up over
partitions), puts every row of the corpus into the cell of its nearest centroid and writes the
inverted lists, partitioned by cell, beside the table of cells, which comes last and so marks the
index as whole.  ``search`` asks the ``probes`` best cells of each query: only their folders are read, and
each cell meets just the queries that probe it (``blocked.stream``).  A cell of more rows than a task should
hold is dealt into several parts.  With all cells probed the result is the exact one.

Ids are whole numbers or strings; rows without an id or a vector are not indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.cluster import cut
from passagework.operators import blocked, vectors

#: Cells at most, so that the centroids fit into every task (65,536 x 1,024 floats are 256 MB; usual indexes have far fewer).
MOST_CELLS = 65_536
#: Rows that centroids are fitted to, for each cell and at most; rounds of fitting.
ROWS_A_CELL, MOST_ROWS, ROUNDS = 64, 1_000_000, 8
#: Rows that are compared with the centroids at a time.
AT_ONCE = 4_096


@dataclass(frozen=True)
class Index:
    """A saved index: its folder, the centroids, the rows of each cell, and how vectors are compared."""

    path: str
    centroids: np.ndarray
    rows: np.ndarray
    normalize: bool

    def lists(self, spark: SparkSession) -> DataFrame:
        """d (id), v (vector) and cell of every row."""
        return spark.read.parquet(f"{self.path}/lists")


def _near(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cell of each row: its nearest centroid."""
    half = (centroids * centroids).sum(axis=1) / 2
    out = [np.argmax(rows[at : at + AT_ONCE] @ centroids.T - half, axis=1) for at in range(0, len(rows), AT_ONCE)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def fit(corpus: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of (d, v): Lloyd's rounds over the rows of the smallest hash, from the first of them.

    A round is one pass over the sample; tasks add up their rows by cell, so what goes to the driver
    is a sum and a count a cell.  Cells that lose all rows keep their centroid.
    """
    wanted = min(cells * ROWS_A_CELL, MOST_ROWS)
    sample = cut(corpus.orderBy(F.xxhash64("d"), "d").limit(wanted).select("v"))
    centroids = blocked.matrix(sample.limit(cells).toArrow().column("v"))  # a row a cell
    parts = max(1, min(sample.sparkSession.sparkContext.defaultParallelism, wanted // AT_ONCE))
    sample = cut(sample.repartition(parts)) if parts > 1 else sample
    for _ in range(rounds):
        current = centroids

        def sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = current) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
            for batch in batches:
                rows = blocked.matrix(batch.column("v"))
                cell = _near(rows, centroids)
                np.add.at(total, cell, rows)
                count += np.bincount(cell, minlength=len(count))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["cell", "n", "total"])

        added = sample.mapInArrow(sums, "cell long, n long, total array<double>").select("cell", "n", F.posexplode("total").alias("i", "x"))
        added = added.groupBy("cell", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).groupBy("cell").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        centroids = current.copy()
        for r in added.collect():  # a row a cell
            centroids[r["cell"]] = np.array([x["x"] for x in r["v"]]) / r["n"]
    return centroids


def build(corpus: DataFrame, path: str, cells: int | None = None, normalize: bool = False, doc_id: str = "doc_id", vector: str = "vector") -> Index:
    """Write the index of ``corpus`` to ``path`` (which must not exist) and open it.

    ``cells`` is the root of the number of rows if it isn't given.  ``normalize`` makes the scores
    cosines.  The corpus is read twice: give a table or a checkpoint.
    """
    spark = corpus.sparkSession
    v = F.col(vector).cast("array<double>")
    rows = corpus.select(F.col(doc_id).alias("d"), (vectors.l2_normalize(v) if normalize else v).alias("v")).where("d is not null and v is not null")
    total = rows.count()
    wanted = min(cells or math.isqrt(total) or 1, MOST_CELLS, max(total, 1))
    centroids = fit(rows, wanted) if total else np.zeros((0, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _near(blocked.matrix(batch.column("v")), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("v"), pa.array(near.astype(np.int32))], ["d", "v", "cell"])

    kind = rows.schema["d"].dataType.simpleString()
    placed = rows.mapInArrow(assign, f"d {kind}, v array<double>, cell int")
    # by range of (cell, id): a cell's rows are neighbours, and a hot cell is several tasks'
    placed.repartitionByRange("cell", "d").sortWithinPartitions("cell", "d").write.partitionBy("cell").parquet(f"{path}/lists")
    lists = spark.read.schema(f"d {kind}, v array<double>, cell int").parquet(f"{path}/lists")
    sizes = {r["cell"]: r["n"] for r in lists.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    about = [(i, c.tolist(), sizes.get(i, 0), normalize) for i, c in enumerate(centroids)]
    spark.createDataFrame(about, "cell int, centroid array<double>, rows long, normalize boolean").coalesce(1).write.parquet(f"{path}/cells")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """The index that was saved at ``path``."""
    held = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most
    return Index(path, np.array([r["centroid"] for r in held]) if held else np.zeros((0, 1)), np.array([r["rows"] for r in held], np.int64), bool(held and held[0]["normalize"]))


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", doc_id: str = "doc_id", vector: str = "vector", digits: int = 9, skip_own: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank of the ``k`` best rows in the ``probes`` best cells of each query
    (all cells, and so the exact result, if not given); ties by document id."""
    spark = queries.sparkSession
    cells = len(index.centroids)
    probes = min(probes or cells, cells)
    lists = index.lists(spark) if cells else spark.createDataFrame([], T.StructType([T.StructField("d", queries.schema[query_id].dataType), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())]))
    v = F.col(vector).cast("array<double>")
    asked = queries.select(F.col(query_id).alias("q"), (vectors.l2_normalize(v) if index.normalize else v).alias("v")).where("q is not null and v is not null")
    pieces = np.maximum(1, -(-index.rows // blocked.PART_ROWS))  # parts of each cell
    begins = np.cumsum(pieces) - pieces
    total = int(pieces.sum())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                scores = blocked.matrix(part.column("v")) @ index.centroids.T
                best = np.argpartition(-scores, probes - 1, axis=1)[:, :probes] if probes < cells else np.tile(np.arange(cells), (part.num_rows, 1))
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("v"), pa.array(best.tolist(), pa.list_(pa.int32()))], ["q", "v", "cells"])

    kinds = ["string" if t.typeName() == "string" else "long" for t in (asked.schema["q"].dataType, lists.schema["d"].dataType)]
    if not cells:
        return spark.createDataFrame([], f"`{query_id}` {kinds[0]}, `{doc_id}` {kinds[1]}, score double, rank long")
    probing = asked.mapInArrow(choose, f"q {asked.schema['q'].dataType.simpleString()}, v array<double>, cells array<int>")
    if probes < cells:
        probing = cut(probing)
        met = [r[0] for r in probing.select(F.explode("cells").alias("c")).distinct().collect()]  # as many as there are cells at most
        lists = lists.where(F.col("cell").isin(met)) if len(met) < cells else lists  # other folders aren't read
    # the first part of each cell, and how many it has: MOST_CELLS rows of three numbers at most
    placed = F.broadcast(spark.createDataFrame([(i, int(b), int(n)) for i, (b, n) in enumerate(zip(begins, pieces, strict=True))], "cell int, begin int, pieces int"))
    held = lists.join(placed, "cell").select((F.col("begin") + F.pmod(F.xxhash64("d"), F.col("pieces"))).cast("int").alias("part"), "d", "v")
    probed = probing.select("q", "v", F.explode("cells").alias("cell")).join(placed, "cell")
    probed = probed.select(F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("pieces") - 1)).alias("part"), "q", "v")

    def visit(table: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = vectors.id_array(table.column("d")), blocked.matrix(table.column("v"))
        for batch in vectors.slices(batches, vectors.QUERIES_AT_ONCE):
            names = vectors.id_array(batch.column("q"))
            yield vectors.result_batch(names, vectors.nearest(ids, rows, names, blocked.matrix(batch.column("v")), np.full(len(names), -np.inf), k, digits, skip_own), kinds)

    tasks = max(1, min(total, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
    return vectors.best_of(blocked.stream(held, probed, tasks, visit, f"q {kinds[0]}, d {kinds[1]}, s double"), k, query_id, doc_id)


def recall(found: DataFrame, exact: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """One row: the share of the ``k`` best of ``exact`` that ``found`` has among its own ``k`` best, and the number of those."""
    wanted = exact.where(F.col("rank") <= k).select(query_id, doc_id)
    got = found.where(F.col("rank") <= k).select(query_id, doc_id, F.lit(1).alias("got"))
    return wanted.join(got, [query_id, doc_id], "left").agg((F.count("got") / F.count(F.lit(1))).alias("recall"), F.count(F.lit(1)).alias("wanted"))
