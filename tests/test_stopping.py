"""Early stopping against the plain loop; masked pooling."""

from __future__ import annotations

import datetime
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework import catalog
from passagework.operators import stopping, vectors


def loop(values, patience, warmup, larger, delta):
    """(improved, best, best step, waited, stops) of each (step, value) of one run."""
    best, at, waited, out = (-np.inf if larger else np.inf), None, 0, []
    for step, value in values:
        better = value > best + delta if larger else value < best - delta
        if better:
            best, at, waited = value, step, 0
        else:
            waited += 1
        allowed = int(patience * 1.5) if warmup > 0 and step <= warmup * 2 else patience
        out.append((step, value, better, None if at is None else best, at, waited, allowed, waited >= allowed))
    return out


@pytest.mark.parametrize(("larger", "delta", "warmup"), [(True, 0.0, 0), (True, 1.5, 20), (False, 0.0, 9), (False, 0.5, 0)])
def test_is_the_loop(spark, larger, delta, warmup):
    draw = random.Random(7)
    rows = [(run, s, float(draw.randrange(-6, 7)) + s / 50) for run, n in (("hot", 300), ("a", 40), ("b", 1), ("z", 55)) for s in draw.sample(range(1000), n)]
    df = spark.createDataFrame(rows + [(None, 1, 1.0), ("a", None, 1.0), ("a", 5000, None)], "run string, step long, value double")
    folded = stopping.early_stopping(df, 3, warmup, larger, delta, parts=9)
    expected = {run: loop(sorted((s, v) for r, s, v in rows if r == run), 3, warmup, larger, delta) for run in ("hot", "a", "b", "z")}
    for run, wanted in expected.items():
        assert [tuple(r)[1:] for r in folded.where(F.col("run") == run).orderBy("step").collect()] == wanted
    found = {r["run"]: r for r in stopping.stops(folded).collect()}
    for run, wanted in expected.items():
        first = next((x for x in wanted if x[-1]), None)
        assert found[run]["stopped"] == (first[0] if first else None)
        assert (found[run]["best"], found[run]["best_step"]) == ((first or wanted[-1])[3], (first or wanted[-1])[4])
        assert found[run]["evaluations"] == len(wanted)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=20), st.lists(st.integers(-5, 5), max_size=20), st.sampled_from([0.0, 1.0, 2.5]))
def test_summaries_add_up(before, after, delta):
    seen, summary = stopping.Seen(), stopping.Summary([])
    for i, v in enumerate(before):
        seen.then(i, v, delta)
    for i, v in enumerate(after):
        summary.add(100 + i, v)
    found = summary.after(seen, delta)
    for i, v in enumerate(after):
        seen.then(100 + i, v, delta)
    assert (found.best, found.step, found.waited) == (seen.best, seen.step, seen.waited)


def test_which_metric_counts(spark):
    assert stopping.search_keys("cosine_ndcg@10")[:2] == ["cosine_ndcg@10", "val_cosine_ndcg@10"]
    assert "val_ndcg@10" in stopping.search_keys("cosine_ndcg@10")
    assert stopping.search_keys("loss")[0] == "loss"
    log = [("r", 1, "val_ndcg@10", 0.1), ("r", 1, "cosine_ndcg@10", 0.2), ("r", 1, "cosine_ndcg@10", 0.3), ("r", 2, "val_ndcg@10", 0.4), ("r", 3, "val_loss", 0.5), ("r", 4, "cosine_ndcg@10", None)]
    df = spark.createDataFrame(log, "run string, step long, metric string, value double")
    assert [tuple(r) for r in stopping.chosen(df, "cosine_ndcg@10").orderBy("step").collect()] == [("r", 1, 0.3), ("r", 2, 0.4)]
    assert [tuple(r) for r in stopping.chosen(df, "loss").collect()] == [("r", 3, 0.5)]
    assert stopping.early_stopping(stopping.chosen(df, "mrr@5")).collect() == []


def test_masked_pooling(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 6.0], [100.0, 100.0]], [1, 1, 0]), (2, [[1.0, 2.0]], [0]), (3, [], []), (4, None, None), (5, [[1.0, 1.0], [3.0, 5.0]], [1]), (6, [[2.0, 2.0], [4.0, None]], [None, 1])]
    df = spark.createDataFrame(rows, "i int, t array<array<double>>, m array<int>")
    found = {r["i"]: (r["mean"], r["first"]) for r in df.select("i", vectors.masked_mean(F.col("t"), F.col("m")).alias("mean"), vectors.first_token(F.col("t")).alias("first")).collect()}
    assert found == {1: ([2.0, 4.0], [1.0, 2.0]), 2: ([0.0, 0.0], [1.0, 2.0]), 3: (None, None), 4: (None, None), 5: ([1.0, 1.0], [1.0, 1.0]), 6: ([4.0, 0.0], [2.0, 2.0])}


def _said(spark, name, folder, table):
    """Rows of a query and of its SQL over one table, as text (so that signs of 0 show)."""
    ours = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    theirs = con.execute(f"SELECT {', '.join(ours.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    return sorted(str(tuple(r)) for r in ours.collect()), sorted(map(str, theirs))


def test_steps_are_of_the_nearest_second(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 5, 59, 59, 499_999)
    rows = [(at + datetime.timedelta(microseconds=k), k, "view", 1.0 + k) for k in (0, 1, 2, 499_999, 500_000)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    ours, theirs = _said(spark, "early_stops", tmp_path, "events")
    assert ours == theirs
    assert len({r["best_step"] for r in catalog.QUERIES["early_stops"](spark, str(tmp_path)).collect()}) == 2


def test_pooled_zeros_keep_their_sign(spark, tmp_path):
    rows = [(i, [-1e-7 if d % 3 else 0.25 for d in range(64)], 1) for i in (1, 2, 9)] + [(3, [0.0078125, -0.0078125, -0.0, 0.0] * 16, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    ours, theirs = _said(spark, "masked_pool", tmp_path, "embeddings")
    assert ours == theirs and "-0.0" in ours[0]
