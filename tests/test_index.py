"""The saved index: exact with all cells, good with some, whole with hot cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.operators import blocked, index, vectors
from passagework.plans.retrieval_queries import sides
from tests.test_blocked import slow_top


@pytest.fixture
def clustered():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 8)) * 4
    rows = [(f"d{i:04d}", np.round(centres[i % 12] + draw.normal(size=8), 2).tolist(), 0) for i in range(480)]
    return rows + [(f"h{i:03d}", centres[0].round(1).tolist(), 0) for i in range(240)]  # a third in one cell


def test_all_cells_are_exact_and_few_are_good(spark, tmp_path, monkeypatch, clustered):
    monkeypatch.setattr(blocked, "PART_ROWS", 64)
    c = spark.createDataFrame(clustered, "doc_id string, vector array<double>, label int")
    q = spark.createDataFrame(clustered[:480:16], "query_id string, vector array<double>, label int")
    path = f"file://{tmp_path}/index"
    index.build(c, path, cells=12)
    opened = index.open_index(spark, path)
    assert int(opened.rows.sum()) == 720
    assert opened.rows.max() > 200  # a hot cell, dealt into parts
    exact = index.search(opened, q, 6, skip_own=True)
    assert sorted((r[0], r[1], round(r[2], 9), r[3]) for r in exact.collect()) == slow_top(clustered[:480:16], clustered, 6, True)
    few = index.search(opened, q, 6, probes=5, skip_own=True)
    assert index.recall(few, exact, 6).first()["recall"] >= 0.9
    assert few.groupBy("query_id", "doc_id").count().where("count > 1").count() == 0


def test_cells_that_no_query_probes_are_not_read(spark, tmp_path, clustered):
    c = spark.createDataFrame(clustered, "doc_id string, vector array<double>, label int")
    opened = index.build(c, f"file://{tmp_path}/index", cells=12)
    one = spark.createDataFrame([("q", clustered[5][1])], "query_id string, vector array<double>")
    plan = index.search(opened, one, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_recall_on_the_tables(spark, data, tmp_path):
    q, c = sides(spark, data)
    built = index.build(c, f"file://{tmp_path}/index")
    found = index.search(built, q, 10, probes=-(-3 * len(built.centroids) // 4), skip_own=True)
    assert index.recall(found, vectors.top_k(q, c, 10, skip_own=True), 10).first()["recall"] >= 0.9


def test_odd_rows(spark, tmp_path):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (None, [5.0, 5.0]), (2, None), (3, [0.0, 0.0])], "doc_id long, vector array<double>")
    built = index.build(c, f"file://{tmp_path}/a", cells=9, normalize=True)
    assert int(built.rows.sum()) == 2
    q = spark.createDataFrame([(1, [2.0, 0.0]), (None, [1.0, 1.0])], "query_id long, vector array<double>")
    assert [(r[0], r[1], round(r[2], 6)) for r in index.search(built, q, 5).orderBy("rank").collect()] == [(1, 1, 1.0), (1, 3, 0.0)]
    empty = index.build(c.where("false"), f"file://{tmp_path}/b")
    assert index.search(empty, q, 5).collect() == []
    assert index.build(c, f"file://{tmp_path}/c", cells=2).lists(spark).select(F.sum("d")).first()[0] == 4
