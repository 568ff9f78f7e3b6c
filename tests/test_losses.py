"""Losses and the data of similarity pictures against plain loops."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.operators import blocked, losses, similarity

DOC, QUERY = "doc_id long, vector array<double>, label int", "query_id long, vector array<double>, label int"


def rows(n: int, labels: int, seed: int = 3):
    draw = np.random.default_rng(seed)
    return [(i, draw.normal(size=4).round(2).tolist(), int(draw.integers(0, labels))) for i in range(n)]


def slow_sample(asked, docs, n, seed=42):
    ring = sorted(docs, key=lambda r: hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest())
    out = {}
    for q, _, label in asked:
        start = int(hashlib.md5(f"{seed}:q:{q}".encode()).hexdigest()[:8], 16) % len(ring)
        out[q] = [d for d, _, x in ring[start:] + ring[:start] if x != label][:n]
    return out


@pytest.mark.parametrize(("n", "labels", "most"), [(200, 2, 30), (150, 1, 5), (90, 5, 1000), (300, 9, 40)])
def test_sampled_negatives(spark, monkeypatch, n, labels, most):
    monkeypatch.setattr(losses, "STRETCH", 17)
    docs = rows(n, labels)
    hot = [(1000 + i, [1.0, 0.0, 0.0, 0.0], 0) for i in range(n)]  # one label holds most rows: later rounds are needed
    docs = docs + (hot if labels == 9 else [])
    found = {r["q"]: r for r in losses.sampled_negatives(spark.createDataFrame(docs[::7], QUERY), spark.createDataFrame(docs, DOC), most, 0.5).collect()}
    expected = slow_sample(docs[::7], docs, most)
    vectors = {d: v for d, v, _ in docs}
    for q, wanted in expected.items():
        if not wanted:
            assert q not in found or found[q]["negatives"] == []
            continue
        assert found[q]["negatives"] == wanted
        assert found[q]["scores"] == pytest.approx([float(np.dot(vectors[q], vectors[d])) / 0.5 for d in wanted])


def test_sampled_losses(spark, monkeypatch):
    monkeypatch.setattr(losses, "STRETCH", 32)
    docs = rows(120, 3)
    found = {r["query_id"]: r for r in losses.sampled_losses(spark.createDataFrame(docs[::9], QUERY), spark.createDataFrame(docs, DOC), 20, 2.0).collect()}
    vectors, sample = {d: np.array(v) for d, v, _ in docs}, slow_sample(docs[::9], docs, 20)
    for q, v, label in docs[::9]:
        against = np.logaddexp.reduce([vectors[d] @ v / 2 for d in sample[q]])
        own = [vectors[d] @ v / 2 for d, _, x in docs if x == label and d != q]
        assert found[q]["positives"] == len(own)
        assert found[q]["loss"] == pytest.approx(sum(np.logaddexp(s, against) - s for s in own))
    assert losses.sampled_losses(spark.createDataFrame([], QUERY), spark.createDataFrame(docs, DOC), 20).collect() == []
    assert losses.sampled_losses(spark.createDataFrame(docs, QUERY), spark.createDataFrame([], DOC), 20).collect() == []


def test_in_batch(spark):
    draw = np.random.default_rng(1)
    made = [(i, draw.normal(size=3).tolist(), draw.normal(size=3).tolist(), draw.normal(size=3).tolist() if i % 2 else None) for i in range(50)] + [(99, None, [1.0, 0.0, 0.0], None)]
    df = losses.batched(spark.createDataFrame(made, "id long, query array<double>, positive array<double>, hard array<double>"), 8, "id")
    batches = {}
    for r in df.collect():
        batches.setdefault(r["batch"], []).append(r)
    assert sorted(len(b) for b in batches.values()) == [3, 8, 8, 8, 8, 8, 8]
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    for extra in (None, "hard"):
        found = {r["id"]: r["loss"] for r in losses.in_batch(df, 5.0, extra=extra).collect()}
        assert 99 not in found
        for b in batches.values():
            held = [r for r in b if r["query"]]
            against = [unit(r["positive"]) for r in held] + ([unit(r["hard"]) for r in held if r["hard"]] if extra else [])
            for r in held:
                scores = [5 * unit(r["query"]) @ x for x in against]
                assert found[r["id"]] == pytest.approx(math.log(sum(map(math.exp, scores))) - 5 * unit(r["query"]) @ unit(r["positive"]))
    with pytest.raises(ValueError, match="positive"):
        losses.in_batch(df, 0.0)


def test_schedule():
    assert [round(losses.warmup_cosine(s, 110, 0.1), 3) for s in (0, 5, 11, 60, 110, 500)] == [0.0, 0.455, 1.0, pytest.approx(0.508, abs=0.01), 0.0, 0.0]


def slow_balance(counts):
    """The loop over queries, one other at a time."""
    positives = negatives = 0
    out = []
    for p, a in counts:
        positives += p
        taken = 0
        for _ in range(a):
            negatives, taken = negatives + 1, taken + 1
            if negatives >= positives:
                break
        out.append(taken)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 7)), max_size=30), st.integers(0, 30))
def test_steps_add_up(counts, middle):
    """Two runs summed up and put together give the loop's shortage, from any shortage before."""
    for begin in range(-12, 13):
        shortage, one, two = begin, similarity.Step(), similarity.Step()
        for i, (p, a) in enumerate(counts):
            shortage += p - similarity.take(p, a, shortage)
            (one if i < middle else two).then(p, a)
        assert two(one(begin)) == shortage
    shortage, taken = 0, []
    for p, a in counts:
        taken.append(similarity.take(p, a, shortage))
        shortage += p - taken[-1]
    assert taken == slow_balance(counts)


def test_running_balance_over_partitions(spark):
    draw = random.Random(2)
    counts = [(f"q{i:04d}", draw.randrange(0, 12), draw.randrange(0, 9)) for i in range(700)] + [("q9999", None, None)]
    df = spark.createDataFrame(draw.sample(counts, len(counts)), "query_id string, positives int, others int")
    found = [r["taken"] for r in similarity.running_balance(df, parts=9).orderBy("query_id").collect()]
    assert found == slow_balance([(p or 0, a or 0) for _, p, a in counts])
    assert similarity.running_balance(df.where("false")).collect() == []


def test_balanced_sample_takes_in_rank_order(spark):
    found = spark.createDataFrame([(q, r * 2, q * 100 + r) for q in range(5) for r in range(1, 5)], "query_id long, rank int, doc_id long")
    positives = spark.createDataFrame([(0, 2), (1, 0), (2, 6), (3, 1), (4, 1)], "query_id long, positives int")
    taken = slow_balance([(2, 4), (0, 4), (6, 4), (1, 4), (1, 4)])
    rows = sorted((r["query_id"], r["doc_id"]) for r in similarity.balanced_sample(found, positives).collect())
    assert rows == [(q, q * 100 + r) for q in range(5) for r in range(1, taken[q] + 1)]


def test_pair_histogram(spark, monkeypatch):
    monkeypatch.setattr(blocked, "PART_ROWS", 20)
    docs = rows(80, 3)
    more = spark.createDataFrame([("negative", 0.25), ("negative", -3.0), ("negative", None)], "kind string, score double")
    found = {(r["kind"], r["bin"]): r["n"] for r in similarity.pair_histogram(spark.createDataFrame(docs[::3], QUERY), spark.createDataFrame(docs, DOC), more, 7).collect()}
    scores = [("positive", round(float(np.dot(v, w)), 6)) for q, v, x in docs[::3] for d, w, y in docs if x == y and q != d] + [("negative", 0.25), ("negative", -3.0)]
    lo, hi = min(s for _, s in scores), max(s for _, s in scores)
    expected: dict = {}
    for kind, s in scores:
        key = kind, min(int((s - lo) / (hi - lo) * 7), 6) + 1
        expected[key] = expected.get(key, 0) + 1
    assert found == expected


def test_heat_map(spark):
    docs = [*rows(40, 3), (99, [1.0, 2.0, 3.0, 4.0], 7), (100, None, 1), (101, [1.0, 1.0, 1.0, 1.0], None)]
    df = spark.createDataFrame(docs, "id long, vector array<double>, label int")
    found = {(r["label"], r["other"]): (r["pairs"], r["mean"]) for r in similarity.heat_map(df).collect()}
    held = [r for r in docs if r[1] is not None and r[2] is not None]
    for a in {r[2] for r in held}:
        for b in {r[2] for r in held}:
            scores = [float(np.dot(v, w)) for i, v, x in held for j, w, y in held if x == a and y == b and i != j]
            assert found[a, b] == ((len(scores), pytest.approx(sum(scores) / len(scores))) if scores else (0, None))


def test_principal(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(200, 6)) * np.array([5, 3, 1, 1, 0.5, 0.1]) + 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, vector array<double>").repartition(5)
    found = similarity.principal(df, 2)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    assert found.variances == pytest.approx(values[::-1][:2])
    assert np.abs(found.axes @ axes[:, ::-1][:, :2]) == pytest.approx(np.eye(2), abs=1e-9)
    placed = {r["id"]: r["p"] for r in df.where("vector is not null").select("id", found.place(F.col("vector")).alias("p")).collect()}
    assert np.array([placed[i] for i in range(200)]) == pytest.approx((x - x.mean(axis=0)) @ found.axes.T)
