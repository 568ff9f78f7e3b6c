"""A set of queries against a whole corpus, in blocks, without the driver.

The corpus is dealt into parts of about PART_ROWS rows by a hash; every query goes to every part.
Both are shuffled to the part's task, where the part stands before the queries: the task holds its
part (a bounded number of rows) and lets the queries stream past in Arrow batches.  Nothing is
collected or broadcast, the plan is the same for any number of queries or parts, and a lost task is
one part's.  What is shuffled is the corpus once and the queries once a part, so the query side
should be the smaller one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the corpus that a task holds at once.
PART_ROWS = 65_536
#: Rows a part below which it isn't worth dealing further, for the sake of idle cores.
LEAST_ROWS = 2_048

#: From the rows of one part and the queries, in batches, to results.
Visit = Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def parts_for(corpus: DataFrame, rows: int | None = None) -> int:
    """How many parts a corpus makes: as many as it needs, or as keep the cores busy.  Counts the
    corpus where ``rows`` isn't given, so that should be a table or a checkpoint."""
    rows = corpus.count() if rows is None else rows
    needed = -(-rows // PART_ROWS)
    return max(1, needed, min(corpus.sparkSession.sparkContext.defaultParallelism, rows // LEAST_ROWS))


def part_of(parts: int, *keys: Column | str) -> Column:
    """The part of a row by its keys, 0 to ``parts`` - 1."""
    return F.pmod(F.xxhash64(F.lit(5), *keys), F.lit(parts)).cast("int")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Runs of rows of one part and one side."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part, asks = batch.column("part").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero((part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), batch.num_rows]
        at = 0
        for end in ends:
            side = batch.column("q" if asks[at] else "c").slice(at, end - at)
            yield int(part[at]), bool(asks[at]), pa.RecordBatch.from_struct_array(side)
            at = end


def stream(corpus: DataFrame, queries: DataFrame, tasks: int, visit: Visit, schema: str) -> DataFrame:
    """What ``visit`` makes of the corpus rows and the queries of each ``part`` (a column of both, from
    0).  Parts are dealt to ``tasks`` tasks in turn.  Parts of one side only aren't visited."""

    def packed(df: DataFrame) -> Column:
        return F.struct(*[F.col(f"`{x}`") for x in df.columns if x != "part"])

    kind = {n: df.select(packed(df).alias("x")).schema["x"].dataType for n, df in (("c", corpus), ("q", queries))}
    held = corpus.select("part", F.lit(False).alias("asks"), packed(corpus).alias("c"), F.lit(None).cast(kind["q"]).alias("q"))
    asked = queries.select("part", F.lit(True).alias("asks"), F.lit(None).cast(kind["c"]).alias("c"), packed(queries).alias("q"))
    both = held.unionByName(asked).repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_segments(batches), key=lambda x: x[0]):
            rows: list[pa.RecordBatch] = []
            for _, asks, batch in group:
                if asks:
                    if rows:
                        yield from visit(pa.Table.from_batches(rows), chain([batch], (b for _, _, b in group)))
                    break
                rows.append(batch)

    return both.mapInArrow(run, schema)


def meet(corpus: DataFrame, queries: DataFrame, parts: int, part: Column, visit: Visit, schema: str, first: int = 0, slices: int = 1) -> DataFrame:
    """What ``visit`` makes of each part of ``corpus`` (``part`` says which, from ``first`` to
    ``parts`` - 1) and all ``queries``.  With ``slices`` a part stands in so many tasks, and each of
    them sees its share of the queries (by a hash of their first column), for few parts and many cores."""
    n = parts - first
    held = corpus.select((part - first).alias("part"), *[F.col(f"`{x}`") for x in corpus.columns]).where(F.col("part").between(0, n - 1))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), *[F.col(f"`{x}`") for x in queries.columns])
    if slices > 1:
        own = F.pmod(F.xxhash64(F.lit(6), F.col(f"`{queries.columns[0]}`")), F.lit(slices)).cast("int")
        asked = asked.withColumn("part", F.col("part") * slices + own)
        held = held.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("part", F.col("part") * slices + F.col("_slice")).drop("_slice")
    return stream(held, asked, n * slices, visit, schema)


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Arrays of equal length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)
