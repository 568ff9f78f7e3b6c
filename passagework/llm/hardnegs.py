"""Hard negatives by product quantisation with rigorous bounds.

Vectors become whole numbers (floor of SCALE times each component).  Each row is stored as codes, one
centroid for every WIDTH components, with the norm of what the codes leave over (its residual).  The
inner product of an anchor with a row then lies within *table score* plus or minus *norm of the anchor
times norm of the residual* (Cauchy-Schwarz), where the table score adds up one look-up a code.  Two
passes over the coded rows use it, anchors against parts of the corpus in blocks (``blocked``):

1. positives: of the rows of the anchor's label those whose upper bound reaches the K-th lower bound
   are scored exactly;
2. negatives: for each positive the window runs from LOW hundredths of its score up to its score.
   Rows of other labels whose bounds meet the window and reach the K-th lower bound of the rows that
   are surely inside are scored exactly, in integers, which completes the window.

A bound never excludes a row that belongs in the result, so the result doesn't hang on how well the
centroids fit; they are fitted to at most SAMPLE rows, those of the smallest hash.

Rows with a null id, a null label, a null vector, or any null or non-finite component take no part.
Where vectors differ in length the shorter count as if filled up with zeros; empty ones are zero
vectors.  Components beyond the size at which inner products fit into 64 bits are held at it.  Of
rows that share an id, the first by label and vector takes part, so repeats of a row count once.  Ties
go by the smaller id.  Anchors without positives, and positives whose window is empty, give no rows;
an empty table gives none.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.common import materialise
from passagework.operators import blocked

#: Components become floor(SCALE * x).
SCALE = 256
#: Components under one code, centroids a code, rows that centroids are fitted to, rounds of fitting.
WIDTH, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 4096, 6
#: Scores (rows times anchors) that are held at once.
SCORES_AT_ONCE = 2_000_000


def integers(rows: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """id, label and x (array of whole numbers): one row an id, of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x).cast("long"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.select(F.col(vec_id).cast("long").alias("id"), label.alias("label"), F.when(v.isNotNull() & fine, whole).alias("x")).where("id is not null and label is not null and x is not null")
    return kept.groupBy("id").agg(F.min(F.struct("label", "x")).alias("_r")).select("id", "_r.label", "_r.x")


def fit(sample: np.ndarray) -> np.ndarray:
    """Centroids (codes, CENTROIDS, WIDTH) of a matrix of rows, by Lloyd's rounds from its first rows."""
    n, dims = sample.shape
    books = np.zeros((dims // WIDTH, CENTROIDS, WIDTH))
    for j in range(len(books)):
        part = sample[:, j * WIDTH : (j + 1) * WIDTH]
        book = part[np.arange(CENTROIDS) % n].copy() if n else books[j]
        for _ in range(ROUNDS if n else 0):
            near = nearest(part, book)
            count = np.bincount(near, minlength=CENTROIDS)
            for k in range(WIDTH):
                book[:, k] = np.where(count > 0, np.bincount(near, part[:, k], CENTROIDS) / np.maximum(count, 1), book[:, k])
        books[j] = book
    return books


def nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    out = [np.argmin((book * book).sum(axis=1) - 2 * (part[at : at + 8192] @ book.T), axis=1) for at in range(0, len(part), 8192)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row and the norm of its residual."""
    codes, left = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x))
    for j, book in enumerate(books):
        part = x[:, j * WIDTH : (j + 1) * WIDTH]
        codes[:, j] = nearest(part, book)
        left += ((part - book[codes[:, j]]) ** 2).sum(axis=1)
    return codes, np.sqrt(left)


def padded(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Arrays of whole numbers as a matrix of ``dims`` columns, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.array([len(x) if x is not None else 0 for x in column], np.int64) if len(flat) != len(column) * dims else np.full(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    limit = int((2**62 // max(dims, 1)) ** 0.5)
    return np.clip(out, -limit, limit)


class Part:
    """The coded rows of one part of the corpus, in order of id."""

    def __init__(self, table: pa.Table, books: np.ndarray, dims: int):
        table = table.sort_by("id")
        self.ids, self.labels = table.column("id").to_numpy(), table.column("label").to_numpy(zero_copy_only=False)
        self.x = padded(table.column("x"), dims)
        self.codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(self.ids), len(books))
        self.left = table.column("left").to_numpy()
        self.books = books
        self.slack = 1e-10 * (1 + np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))

    def bounds(self, rows: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible score of each row (down) with each of ``asked`` (across)."""
        score = np.zeros((len(rows), len(asked)))
        for j, book in enumerate(self.books):
            score += (book @ asked[:, j * WIDTH : (j + 1) * WIDTH].T)[self.codes[rows, j]]
        norms = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1))
        off = self.left[rows][:, None] * norms[None, :] * (1 + 1e-9) + self.slack * (1 + norms)[None, :]
        return score - off, score + off

    def exact(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Inner products of rows and anchors, pair by pair."""
        out = np.zeros(len(rows), np.int64)
        for at in range(0, len(rows), 65_536):
            out[at : at + 65_536] = np.einsum("ij,ij->i", self.x[rows[at : at + 65_536]], asked[at : at + 65_536])
        return out


def first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each group, by score, then id."""
    order = np.lexsort((ids, -score, group))
    return order[np.arange(len(order)) - np.searchsorted(group[order], group[order], "left") < k]


def at_least(lower: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column, or minus infinity."""
    return np.partition(lower, len(lower) - k, axis=0)[len(lower) - k] if len(lower) >= k else np.full(lower.shape[1], -np.inf)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    step = max(1, SCORES_AT_ONCE // max(rows, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def positives_in(part: Part, batches: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of anchors, ids and scores of their best ``k`` rows of the same label in this part."""
    by_label = {x: np.flatnonzero(part.labels == x) for x in np.unique(part.labels)}
    for batch in slices(batches, len(part.ids)):
        names, labels, asked = batch.column("id").to_numpy(), batch.column("label").to_numpy(zero_copy_only=False), padded(batch.column("x"), dims)
        for label in np.unique(labels):
            rows, mine = by_label.get(label, np.zeros(0, np.int64)), np.flatnonzero(labels == label)
            if not len(rows):
                continue
            lower, upper = part.bounds(rows, asked[mine])
            own = part.ids[rows][:, None] == names[mine][None, :]
            lower[own] = upper[own] = -np.inf
            r, a = np.nonzero((upper >= at_least(lower, k)[None, :]) & ~own)
            scores = part.exact(rows[r], asked[mine[a]])
            best = first(a, scores, part.ids[rows[r]], k)
            yield names[mine[a[best]]], part.ids[rows[r[best]]], scores[best]


def negatives_in(part: Part, batches: Iterator[pa.RecordBatch], dims: int, k: int, low: int, high: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids of anchors and positives, ids of the best ``k`` rows of other labels within the window of
    each positive, the positives' scores and theirs."""
    every = np.arange(len(part.ids))
    for batch in slices(batches, len(part.ids)):
        names, labels, asked = batch.column("id").to_numpy(), batch.column("label").to_numpy(zero_copy_only=False), padded(batch.column("x"), dims)
        held = [[(p["positive_id"], p["positive_score"]) for p in x] for x in batch.column("positives").to_pylist()]
        lower, upper = part.bounds(every, asked)
        other = part.labels[:, None] != labels[None, :]
        lower[~other] = upper[~other] = -np.inf  # neither meets a window nor lies surely inside
        windows = [(i, pid, score) for i, x in enumerate(held) for pid, score in x]
        maybe: list[np.ndarray] = []
        near = np.zeros(lower.shape, bool)
        for i, _, score in windows:
            from_, to = low * score / 100, high * score / 100
            gap = 1e-9 * (1 + abs(score))
            lo, up = lower[:, i], upper[:, i]
            meets = (up >= from_ - gap) & (lo <= to + gap)
            sure = lo[(lo >= from_ + gap) & (up <= to - gap)]
            least = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf
            rows = np.flatnonzero(meets & (up >= least))
            maybe.append(rows)
            near[rows, i] = True
        r, a = np.nonzero(near)
        scores = np.zeros(near.shape, np.int64)
        scores[r, a] = part.exact(r, asked[a])
        for (i, pid, score), rows in zip(windows, maybe, strict=True):
            found = scores[rows, i]
            hundred = 100 * (found if abs(score) < 2**55 else found.astype(object))
            inside = ((hundred >= low * score) & (hundred <= high * score)).astype(bool)
            rows, found = rows[inside], found[inside]
            best = first(np.zeros(len(rows), np.int64), found, part.ids[rows], k)
            if len(best):
                yield np.full(len(best), names[i]), np.full(len(best), pid), part.ids[rows[best]], np.full(len(best), score), found[best]


def _batch(columns: tuple[np.ndarray, ...], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names)


def mine(rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the column ``id``.  An anchor's positives are its best ``positives``
    other rows of the same label; for each the best ``negatives`` rows of other labels are returned
    whose score is at least ``low`` and at most ``high`` hundredths of the positive's.
    """
    plain = materialise(integers(rows, vec_id, vector, F.col(label) if isinstance(label, str) else label), "negatives-rows")
    size = plain.agg(F.max(F.size("x")).alias("dims"), F.count(F.lit(1)).alias("n")).first()
    dims = -(-(size["dims"] or 0) // WIDTH) * WIDTH or WIDTH
    sample = plain.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow()  # at most SAMPLE rows
    books = fit(padded(sample.column("x"), dims).astype(np.float64))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, left = coded(padded(batch.column("x"), dims).astype(np.float64), books)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "x")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], ["id", "label", "x", "codes", "left"])

    kind = plain.schema["label"].dataType.simpleString()
    corpus = materialise(plain.mapInArrow(code, f"id long, label {kind}, x array<long>, codes binary, left double"), "negatives-codes")
    parts = blocked.parts_for(corpus, size["n"])
    asked = corpus.where(anchors).select("id", "label", "x")

    def find_positives(table: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in positives_in(Part(table, books, dims), batches, dims, positives):
            yield _batch(found, ["anchor_id", "positive_id", "positive_score"])

    def find_negatives(table: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in negatives_in(Part(table, books, dims), batches, dims, negatives, low, high):
            yield _batch(found, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    met = blocked.meet(corpus, asked, parts, blocked.part_of(parts, "id"), find_positives, "anchor_id long, positive_id long, positive_score long")
    by = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = met.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= positives)
    grouped = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # ``positives`` an anchor
    asked = materialise(asked.join(grouped, "id"), "negatives-asked")
    out = blocked.meet(corpus, asked, parts, blocked.part_of(parts, "id"), find_negatives, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    by = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
