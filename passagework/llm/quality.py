"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics (shares of character classes, lengths, repetition) are standardised and mapped
to ``2 D cos(Wx + b)`` features that approximate a Gaussian kernel.  Partitions of the sample sum
their normal equations, the driver adds the sums and solves the ridge system; scores of a fold that
the ridge has not seen are calibrated by pool-adjacent-violators.

Null texts count as empty; an empty text has zero statistics and gets a score like any other.
Repeated rows get equal scores, null ids are scored, further columns pass through.  Without any
labelled row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm import labelled
from passagework.llm.common import batch_rows, discard, materialise

#: Documents that are learnt from, at most.
SAMPLE = 12_000
FEATURES, RIDGE, SEED = 256, 1e-2, 11

#: Classes of a UTF-8 byte: other symbol, lower, upper, digit, blank, line end, stop, comma, first and later bytes of a longer character.
CLASSES = 10
_CLASS = np.zeros(256, np.uint8)
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t", 4), ("\n\r", 5), (".!?", 6), (",;:'\"-()", 7)):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[192:], _CLASS[128:192] = 8, 9
N_STATS = CLASSES + 8
BYTES_AT_ONCE = 4_000_000


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of N_STATS numbers a text; null counts as empty.  Texts are read BYTES_AT_ONCE at a time
    (a longer one alone)."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    out, at = [np.zeros((0, N_STATS))], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BYTES_AT_ONCE, "right")) - 1)
        out.append(_statistics(texts.slice(at, to - at)))
        at = to
    return np.concatenate(out)


def _statistics(texts: pa.Array) -> np.ndarray:
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends, starts = offsets[1:] - offsets[0], offsets[:-1] - offsets[0]
    size = np.maximum(ends - starts, 1)
    kinds = _CLASS[data]
    sums = np.zeros((n, CLASSES), np.float64)
    full = np.flatnonzero(ends > starts)
    for k in range(CLASSES):
        if len(full):
            sums[full, k] = np.add.reduceat((kinds == k).view(np.uint8), starts[full], dtype=np.int64)
    words = sums[:, 4] + sums[:, 5] + 1
    turn = np.zeros(n)
    twice = np.zeros(n)
    if len(full):
        step = np.empty(len(kinds), np.uint8)
        last = ends[full] - 1  # what follows a text is no part of it
        step[:-1] = kinds[1:] != kinds[:-1]
        step[last] = 1
        turn[full] = np.add.reduceat(step, starts[full], dtype=np.int64)
        step[:-1] = data[1:] == data[:-1]
        step[last] = 0
        twice[full] = np.add.reduceat(step, starts[full], dtype=np.int64)
    lines_new, words_new = np.ones(n), np.ones(n)
    for i, x in enumerate(texts.to_pylist()):
        lines, split = x.split("\n"), x.split()
        lines_new[i] = len(set(lines)) / len(lines)
        words_new[i] = len(set(split)) / len(split) ** 0.8 if split else 0
    chars = size - sums[:, 9]
    out = np.column_stack([sums / size[:, None], np.log1p(ends - starts), chars / words, np.log1p(sums[:, 6] / words * 10), turn / words, twice / size, lines_new, words_new, np.log1p(sums[:, 5])])
    out[ends == starts] = 0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.steps, self.levels), 0.0, 1.0)


def fourier(x: np.ndarray) -> np.ndarray:
    """Features whose products approximate exp(-|x - y|^2 / (2 d)), and a constant."""
    draw = np.random.default_rng(SEED)
    w = draw.normal(size=(x.shape[1], FEATURES)) / np.sqrt(x.shape[1])
    b = draw.uniform(0, 2 * np.pi, FEATURES)
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones(len(x))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points of the non-decreasing fit, for interpolation.  Equal ``x`` are
    one point to begin with, so the order of rows doesn't matter."""
    places, which = np.unique(x, return_inverse=True)
    weights = np.bincount(which, minlength=len(places))
    means = np.bincount(which, y, len(places)) / np.maximum(weights, 1)
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for a, b, n in zip(places.tolist(), means.tolist(), weights.tolist(), strict=True):
        blocks.append([b, n, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            top = blocks[-1]
            top[0], top[1], top[3] = (top[0] * top[1] + m * w) / (top[1] + w), top[1] + w, last
    steps, levels = [], []
    for mean, _, first, last in blocks:
        steps += [first, last]
        levels += [mean, mean]
    return np.array(steps), np.array(levels)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, calibrate: Column, label: str = "quality", sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """``allowed`` and ``calibrate`` are conditions on the id: which rows may be learnt from, and
    which of them are kept from the ridge for calibration."""
    batch_rows(docs.sparkSession)
    rows = labelled.sample(docs, labels, label, allowed, sample, doc_id, text)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("late"), pa.array(list(found), pa.list_(pa.float64()))], ["label", "late", "x"])

    seen = materialise(rows.select("text", "label", F.coalesce(calibrate, F.lit(False)).alias("late")).mapInArrow(stats, "label double, late boolean, x array<double>"), "quality-sample")
    shape = seen.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(N_STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not shape["n"]:
        return None
    mean = np.array([shape[f"m{i}"] for i in range(N_STATS)])
    scale = np.array([shape[f"s{i}"] or 1.0 for i in range(N_STATS)]) + 1e-9

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + 1
        total, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            f = fourier((np.stack(batch.column("x").to_numpy(zero_copy_only=False)) - mean) / scale) if batch.num_rows else np.zeros((0, size))
            y = batch.column("label").to_numpy(zero_copy_only=False)
            total += f.T @ f
            right += f.T @ y
        yield pa.RecordBatch.from_pydict({"a": [total.ravel().tolist()], "b": [right.tolist()]})

    early = seen.where(~F.col("late"))
    if early.isEmpty() or seen.where("late").isEmpty():
        early = seen
    sums = early.coalesce(8).mapInArrow(normal, "a array<double>, b array<double>").collect()
    size = FEATURES + 1
    a = sum(np.array(r["a"]) for r in sums).reshape(size, size)
    weights = np.linalg.solve(a + RIDGE * np.eye(size), sum(np.array(r["b"]) for r in sums))
    held = seen.where("late")
    held = seen if held.isEmpty() else held
    points = held.select("x", "label").collect()  # at most ``sample`` rows
    model = Model(mean, scale, weights, np.zeros(0), np.zeros(0))
    discard(seen)
    model.steps, model.levels = isotonic(model.raw(np.array([r["x"] for r in points])), np.array([r["label"] for r in points]))
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: how likely label 1 is, 0 to 1."""
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    batch_rows(docs.sparkSession)
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*(f for f in docs.schema if f.name in kept), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.score(statistics(batch.column(text))), pa.float64())], [*kept, out])

    return docs.select(*kept).mapInArrow(run, schema)
