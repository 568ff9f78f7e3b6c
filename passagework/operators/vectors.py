"""Vector operations and exact top-k search by inner product."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.cluster import cut
from passagework.operators import blocked

#: Queries and documents that a task multiplies at a time.
QUERIES_AT_ONCE, DOCS_AT_ONCE = 512, 2048
#: Parts of a corpus from which some are searched first, for floors.
FLOORS_FROM = 16
#: A round of ``first_ranks`` searches so many times what the rounds before it have.
ROUNDS_GROW = 8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, epsilon: float = 1e-8) -> Column:
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + epsilon))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mean_pool(df: DataFrame, keys: list[str], vector: str, renormalize: bool = True) -> DataFrame:
    """Mean vector of each group, normalised to length 1 (a zero vector stays as it is).

    Sums are combined per dimension before the shuffle.
    """
    by_dim = df.select(*keys, F.posexplode(vector).alias("_d", "_x")).groupBy(*keys, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    pooled = by_dim.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_d", "_m"))), lambda x: x["_m"]).alias(vector))
    if not renormalize:
        return pooled
    return pooled.withColumn("_n", norm(F.col(vector))).withColumn(vector, F.when(F.col("_n") > 0, F.transform(vector, lambda x: x / F.col("_n"))).otherwise(F.col(vector))).drop("_n")


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors (arrays in an array) that the mask (1 or 0 a token) keeps.

    As many tokens count as have a mask.  Where the mask keeps none the mean is a zero vector; without
    any token it is null.  Null entries of the mask are 0.
    """
    kept = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(mask), F.lit(0))), mask, lambda t, m: F.struct(t.alias("t"), F.coalesce(m.cast("double"), F.lit(0.0)).alias("m")))
    kept = F.filter(kept, lambda x: x["t"].isNotNull())
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, x["t"], lambda a, b: a + F.coalesce(b.cast("double"), F.lit(0.0)) * x["m"]))
    weight = F.greatest(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["m"]), F.lit(1e-6))
    return F.transform(total, lambda x: x / weight)


def first_token(tokens: Column) -> Column:
    """The vector of the first token, which stands for the text; null without any."""
    return F.transform(F.get(tokens, F.lit(0)), lambda x: x.cast("double"))


def id_array(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as an array that sorts as Spark does: numbers, or strings by code point."""
    return values.to_numpy().astype(np.int64) if pa.types.is_integer(values.type) else np.array(values.to_pylist(), np.str_)


def _scaled(column: pa.Array | pa.ChunkedArray, normalize: bool) -> np.ndarray:
    values = blocked.matrix(column)
    return values / (np.linalg.norm(values, axis=1, keepdims=True) + 1e-8) if normalize else values


def _best(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of flat candidates the ``k`` of each query by score, then id."""
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    first = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - first < k
    return query[keep], doc[keep], score[keep]


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def nearest(docs: np.ndarray, vectors: np.ndarray, asked: np.ndarray, matrix: np.ndarray, floors: np.ndarray, k: int, digits: int = 9, skip_own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids and rounded scores of the ``k`` best of ``docs`` for each, none below its floor."""
    least = floors.copy()  # a query's k-th score so far, or its floor
    best: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), docs[:0], np.zeros(0))
    for at in range(0, len(docs), DOCS_AT_ONCE):
        names = docs[at : at + DOCS_AT_ONCE]
        scores = np.round(matrix @ vectors[at : at + DOCS_AT_ONCE].T, digits)
        if skip_own:
            scores[asked[:, None] == names[None, :]] = -np.inf
        bar = np.maximum(least, -np.partition(-scores, k - 1, axis=1)[:, k - 1]) if len(names) > k else least
        q, d = np.nonzero((scores >= bar[:, None]) & np.isfinite(scores))
        best = _best(*map(np.concatenate, zip(best, (q, names[d], scores[q, d]), strict=True)), k)
        full = np.flatnonzero(np.bincount(best[0], minlength=len(asked)) >= k)
        least[full] = np.maximum(least[full], best[2][np.searchsorted(best[0], full, "right") - 1])
    return best


def _kinds(queries: DataFrame, query_id: str, corpus: DataFrame, doc_id: str) -> list[str]:
    return ["string" if t.typeName() == "string" else "long" for t in (queries.schema[query_id].dataType, corpus.schema[doc_id].dataType)]


def result_batch(names: np.ndarray, best: tuple[np.ndarray, np.ndarray, np.ndarray], kinds: list[str]) -> pa.RecordBatch:
    types = [pa.string() if t == "string" else pa.int64() for t in kinds]
    return pa.RecordBatch.from_arrays([pa.array(names[best[0]].tolist(), types[0]), pa.array(best[1].tolist(), types[1]), pa.array(best[2])], ["q", "d", "s"])


def best_of(found: DataFrame, k: int, query_id: str, doc_id: str) -> DataFrame:
    """query_id, doc_id, score, rank of the ``k`` best of (q, d, s); ties by document id."""
    by = Window.partitionBy("q").orderBy(F.desc("s"), "d")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("d").alias(doc_id), F.col("s").alias("score"), F.col("rank").cast("long").alias("rank"))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id", vector: str = "vector", normalize: bool = False, digits: int = 9, skip_own: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank of the k nearest documents; ties by document id.

    Ids are whole numbers or strings; rows without an id or a vector take no part.  ``skip_own``
    leaves out the document of the query's own id.  Queries meet the parts of the corpus as
    ``blocked`` says; each part gives at most k for a query.  Where there are many parts, about the
    root of their number is searched first, and what a query finds there is its floor in the others,
    so that the rows to be ranked don't grow with queries times parts.
    """
    kinds = _kinds(queries, query_id, corpus, doc_id)
    docs = corpus.select(F.col(doc_id).alias("d"), F.col(vector).alias("v")).where("d is not null and v is not null")
    asked = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v"), F.lit(float("-inf")).alias("floor")).where("q is not null and v is not null")
    parts = blocked.parts_for(docs)

    def visit(part: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = id_array(part.column("d")), _scaled(part.column("v"), normalize)
        for batch in slices(batches, QUERIES_AT_ONCE):
            names = id_array(batch.column("q"))
            yield result_batch(names, nearest(ids, vectors, names, _scaled(batch.column("v"), normalize), batch.column("floor").to_numpy(), k, digits, skip_own), kinds)

    schema = f"q {kinds[0]}, d {kinds[1]}, s double"
    ahead = math.isqrt(parts) if parts >= FLOORS_FROM else parts
    found = blocked.meet(docs.where(blocked.part_of(parts, "d") < ahead), asked, ahead, blocked.part_of(parts, "d"), visit, schema)
    if ahead < parts:
        found = cut(best_of(found, k, "q", "d").withColumnRenamed("score", "s"))
        floors = found.where(F.col("rank") == k).select("q", F.col("s").alias("floor"))
        asked = asked.drop("floor").join(floors, "q", "left").select("q", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        found = found.select("q", "d", "s").unionAll(blocked.meet(docs, asked, parts, blocked.part_of(parts, "d"), visit, schema, first=ahead))
    return best_of(found, k, query_id, doc_id)


def _own_best(asked: DataFrame, docs: DataFrame, rows: int, digits: int) -> DataFrame:
    """``asked`` (q, g, v) with ``s`` and ``own``, score and id of the nearest other document of the
    query's group; queries whose group has no other are left out.  Groups are dealt out whole."""
    parts = max(blocked.parts_for(docs, rows), -(-rows // DOCS_AT_ONCE))
    part = blocked.part_of(parts, "g")
    kind = asked.schema["q"].dataType.simpleString()

    def visit(held: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, vectors = id_array(held.column("d")), id_array(held.column("g")), blocked.matrix(held.column("v"))
        for batch in slices(batches, QUERIES_AT_ONCE):
            names, own, matrix = id_array(batch.column("q")), id_array(batch.column("g")), blocked.matrix(batch.column("v"))
            score, best = np.full(len(names), -np.inf), [None] * len(names)
            for at in range(0, len(ids), DOCS_AT_ONCE):
                to = slice(at, at + DOCS_AT_ONCE)
                met = (own[:, None] == groups[None, to]) & (names[:, None] != ids[None, to])
                q, d = np.nonzero(met)
                found = np.round(matrix @ vectors[to].T, digits)[q, d]
                for i, j, x in zip(q.tolist(), (d + at).tolist(), found.tolist(), strict=True):
                    if x > score[i] or (x == score[i] and ids[j] < best[i]):
                        score[i], best[i] = x, ids[j]
            kept = [i for i, x in enumerate(best) if x is not None]
            yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(kept, pa.int64())), pa.array(score[kept]), pa.array([best[i].item() for i in kept], held.schema.field("d").type)], ["q", "s", "own"])

    found = blocked.stream(docs.withColumn("part", part), asked.withColumn("part", part), min(parts, 4 * blocked.parts_for(docs, rows)), visit, f"q {kind}, s double, own {kind}")
    return asked.join(found, "q")


def first_ranks(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id", group: str = "group", vector: str = "vector", digits: int = 9) -> DataFrame:
    """query_id and rank of the first document of the query's own group among the ``k`` nearest of all
    documents but itself (ties by document id), for queries that have one among them: what accuracy
    and reciprocal rank ask of an exact search.

    The nearest of its group is found first; the query's rank is one more than the documents before
    that one, which are counted, not listed.  The corpus is gone through in rounds, each
    ROUNDS_GROW times as much as before it, and a query that has ``k`` documents before its own has
    no rank and leaves.  So a query costs about as many documents as hold ``k`` nearer ones; only
    those that keep a rank meet the whole corpus.  Single precision decides what is clearly nearer or
    not, the exact score the rest.
    """
    docs = corpus.select(F.col(doc_id).alias("d"), F.col(group).alias("g"), F.col(vector).alias("v")).where("d is not null and v is not null")
    asked = queries.select(F.col(query_id).alias("q"), F.col(group).alias("g"), F.col(vector).alias("v")).where("q is not null and v is not null")
    kind, rows = asked.schema["q"].dataType.simpleString(), docs.count()
    parts = max(1, -(-rows // blocked.PART_ROWS))

    def visit(held: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(id_array(held.column("g")), kind="stable")  # a group's rows are neighbours
        groups, ids = id_array(held.column("g"))[order], id_array(held.column("d"))[order]
        single = blocked.matrix(held.column("v"), np.float32)[order]
        vectors = single if pa.types.is_float32(held.schema.field("v").type.value_type) else blocked.matrix(held.column("v"))[order]
        longest = max((float(np.sqrt(np.einsum("ij,ij->i", single[at : at + DOCS_AT_ONCE], single[at : at + DOCS_AT_ONCE]).max(initial=0))) for at in range(0, len(ids), DOCS_AT_ONCE)), default=0.0)
        for batch in slices(batches, QUERIES_AT_ONCE):
            own, score, matrix = id_array(batch.column("own")), batch.column("s").to_numpy(), blocked.matrix(batch.column("v"))
            names = id_array(batch.column("g"))
            begin, end = np.searchsorted(groups, names, "left"), np.searchsorted(groups, names, "right")
            # what single precision and the rounding of scores may be off by
            slack = (matrix.shape[1] + 4) * 2.0**-23 * np.linalg.norm(matrix, axis=1) * longest + 10.0**-digits
            low, high = (score - slack).astype(np.float32), (score + slack).astype(np.float32)
            low, high = np.nextafter(low, np.float32(-np.inf)), np.nextafter(high, np.float32(np.inf))
            count, live, narrow = batch.column("n").to_numpy().copy(), np.arange(batch.num_rows), matrix.astype(np.float32)
            for at in range(0, len(ids), DOCS_AT_ONCE):
                live = live[count[live] < k]
                if not len(live):
                    break
                near = narrow[live] @ single[at : at + DOCS_AT_ONCE].T
                for i in np.flatnonzero((begin[live] < at + near.shape[1]) & (end[live] > at)):  # its own group doesn't count
                    near[i, max(begin[live[i]] - at, 0) : end[live[i]] - at] = -np.inf
                above, maybe = np.count_nonzero(near > high[live, None], axis=1), np.count_nonzero(near >= low[live, None], axis=1)
                for i in np.flatnonzero(above != maybe):
                    q, open_ = live[i], np.flatnonzero((near[i] >= low[live[i]]) & (near[i] <= high[live[i]])) + at
                    exact = np.round(vectors[open_].astype(np.float64) @ matrix[q], digits)
                    above[i] += np.count_nonzero((exact > score[q]) | ((exact == score[q]) & (ids[open_] < own[q])))
                count[live] += above
            yield pa.RecordBatch.from_arrays([batch.column("q"), pa.array(count - batch.column("n").to_numpy())], ["q", "m"])

    left = cut(_own_best(asked, docs, rows, digits).withColumn("n", F.lit(0).cast("long")))
    done = 0
    while done < parts:
        until = min(parts, max(1, done * ROUNDS_GROW))
        cores = docs.sparkSession.sparkContext.defaultParallelism
        found = blocked.meet(docs, left, until, blocked.part_of(parts, "d"), visit, f"q {kind}, m long", first=done, slices=-(-cores // (until - done)))
        left = cut(left.join(found.groupBy("q").agg(F.sum("m").alias("m")), "q", "left").withColumn("n", F.col("n") + F.coalesce("m", F.lit(0))).drop("m").where(F.col("n") < k))
        done = until
    return left.select(F.col("q").alias(query_id), (F.col("n") + 1).alias("rank"))


def log_sums(each: DataFrame) -> DataFrame:
    """q and t, the logarithm of the sum of the exponentials of its (q, t); a few numbers a query and part."""
    tops = each.groupBy("q").agg(F.max("t").alias("top"), F.collect_list("t").alias("ts"))
    return tops.select("q", (F.col("top") + F.log(F.aggregate("ts", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))).alias("t"))


def contrast_losses(queries: DataFrame, corpus: DataFrame, temperature: float, query_id: str = "query_id", doc_id: str = "doc_id", vector: str = "vector", label: str = "label", against: DataFrame | None = None) -> DataFrame:
    """query_id, positives and loss: the cross-entropies, summed, of each document of the query's
    label (but itself) against all documents of other labels, or against the log-sum ``t`` that
    ``against`` (q, t) gives of those that were sampled.

    Two passes in blocks: the first gives each query's log-sum of its negatives (a row a query and
    part), the second adds up the terms of its positives (another such row).  Queries without
    negatives have none.
    """
    docs = corpus.select(F.col(doc_id).cast("long").alias("d"), F.col(label).alias("l"), F.col(vector).alias("v")).where("d is not null and v is not null and l is not null")
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(label).alias("l"), F.col(vector).alias("v")).where("q is not null and v is not null and l is not null")
    parts, part = blocked.parts_for(docs), lambda n: blocked.part_of(n, "d")

    def scored(held: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Scores of some queries and documents, where the labels are equal, and where the row is the query's own."""
        ids, labels, vectors = held.column("d").to_numpy(), held.column("l").to_numpy(), blocked.matrix(held.column("v"))
        for batch in slices(batches, QUERIES_AT_ONCE):
            names, own, rows = batch.column("q").to_numpy(), batch.column("l").to_numpy(zero_copy_only=False), blocked.matrix(batch.column("v"))
            for at in range(0, len(ids), DOCS_AT_ONCE):
                to = slice(at, at + DOCS_AT_ONCE)
                yield batch, rows @ vectors[to].T / temperature, own[:, None] == labels[None, to], names[:, None] == ids[None, to]

    def negatives(held: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores, same, _ in scored(held, batches):
            total = np.logaddexp.reduce(np.where(same, -np.inf, scores), axis=1)
            some = np.isfinite(total)
            yield pa.RecordBatch.from_arrays([batch.column("q").filter(pa.array(some)), pa.array(total[some])], ["q", "t"])

    def positives(held: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores, same, itself in scored(held, batches):
            against, same = batch.column("t").to_numpy()[:, None], same & ~itself
            loss = np.where(same, np.logaddexp(scores, against) - scores, 0.0).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("q"), pa.array(same.sum(axis=1)), pa.array(loss)], ["q", "n", "loss"])

    if against is None:
        against = log_sums(blocked.meet(docs, asked, parts, part(parts), negatives, "q long, t double"))
    sums = blocked.meet(docs, asked.join(against, "q"), parts, part(parts), positives, "q long, n long, loss double")
    return sums.groupBy(F.col("q").alias(query_id)).agg(F.sum("n").alias("positives"), F.sum("loss").alias("loss"))


def label_means(queries: DataFrame, corpus: DataFrame, query_id: str = "query_id", vector: str = "vector", label: str = "label") -> DataFrame:
    """query_id, positives, score_sum: over all documents of the query's label but itself.  The sum of
    products with them is the product with their sum, so no pair is ever formed."""
    sums = corpus.select(label, F.posexplode(vector).alias("_d", "_x")).groupBy(label, "_d").agg(F.sum(F.col("_x").cast("double")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    whole = sums.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("_d", "_s"))), lambda x: x["_s"]).alias("_sum"), F.max("_n").alias("_n"))
    met = queries.select(query_id, label, vector).join(whole, label)
    return met.select(query_id, (F.col("_n") - 1).alias("positives"), (dot(F.col(vector), F.col("_sum")) - dot(F.col(vector), F.col(vector))).alias("score_sum"))
