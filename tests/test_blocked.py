"""Search in blocks: more than two parts of the corpus and batches of queries, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.operators import blocked, vectors

DIMS = 6


def rows(n: int, seed: int, text_ids: bool = False):
    draw = np.random.default_rng(seed)
    made = np.round(draw.normal(size=(n, DIMS)), 1)  # rounded, so that scores tie
    return [(f"id{i:04d}" if text_ids else i, made[i].tolist(), int(draw.integers(0, 4))) for i in range(n)]


def slow_top(queries, docs, k, skip_own):
    out = []
    for q, v, _ in queries:
        scores = sorted((-round(float(np.dot(v, w)), 9), d) for d, w, _ in docs if not (skip_own and d == q))
        out += [(q, d, -s, r) for r, (s, d) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    """Many parts and many steps from a few rows."""
    monkeypatch.setattr(blocked, "PART_ROWS", 20)
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(vectors, "DOCS_AT_ONCE", 6)


@pytest.mark.parametrize(("n", "text_ids", "floors"), [(130, False, 99), (130, True, 3), (410, False, 16)])
def test_top_k_in_parts(spark, small, monkeypatch, n, text_ids, floors):
    monkeypatch.setattr(vectors, "FLOORS_FROM", floors)
    kind = "string" if text_ids else "long"
    docs, asked = rows(n, 1, text_ids), rows(n, 1, text_ids)[::3]
    c = spark.createDataFrame(docs, f"doc_id {kind}, vector array<double>, label int")
    q = spark.createDataFrame(asked, f"query_id {kind}, vector array<double>, label int")
    assert blocked.parts_for(c) > 5
    found = vectors.top_k(q, c, 4, skip_own=True)
    assert sorted((r[0], r[1], round(r[2], 9), r[3]) for r in found.collect()) == slow_top(asked, docs, 4, True)
    if floors > blocked.parts_for(c):  # floors are joined by Spark's own choice
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_without_id_or_vector_take_no_part(spark, small):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (None, [9.0, 9.0]), (2, None), (3, [0.0, 1.0])], "doc_id long, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.5]), (None, [1.0, 1.0]), (8, None)], "query_id long, vector array<double>")
    assert [tuple(r) for r in vectors.top_k(q, c, 5).orderBy("rank").collect()] == [(7, 1, 1.0, 1), (7, 3, 0.5, 2)]
    assert vectors.top_k(q, c.where("false"), 5).collect() == vectors.top_k(q.where("false"), c, 5).collect() == []


def test_losses_in_parts(spark, small):
    docs = rows(90, 2)
    c = spark.createDataFrame(docs, "doc_id long, vector array<double>, label int")
    q = spark.createDataFrame(docs[::4], "query_id long, vector array<double>, label int")
    found = {r["query_id"]: (r["positives"], r["loss"]) for r in vectors.contrast_losses(q, c, 2.0).collect()}
    for i, v, label in docs[::4]:
        scores = {d: float(np.dot(v, w)) / 2 for d, w, _ in docs}
        against = np.logaddexp.reduce([scores[d] for d, _, x in docs if x != label])
        own = [scores[d] for d, _, x in docs if x == label and d != i]
        assert found[i][0] == len(own)
        assert found[i][1] == pytest.approx(sum(np.logaddexp(s, against) - s for s in own))


def test_meet_sees_every_pair_once(spark, small):
    import pyarrow as pa

    def visit(part, batches):
        for b in batches:
            a, x = np.meshgrid(part.column("a").to_numpy(), b.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel()), pa.array(x.ravel())], ["a", "b"])

    c, q = spark.range(100).select(F.col("id").alias("a")), spark.range(11).select(F.col("id").alias("b"))
    out = blocked.meet(c, q, 5, blocked.part_of(5, "a"), visit, "a long, b long")
    assert sorted(map(tuple, out.collect())) == [(a, b) for a in range(100) for b in range(11)]
    assert out.rdd.getNumPartitions() == 5


@pytest.mark.parametrize("text_ids", [False, True])
def test_first_ranks(spark, small, text_ids):
    """Against brute force, with ties; most queries leave before the last round."""
    kind, docs = "string" if text_ids else "long", [(d, v, int(n) // 3) for n, (d, v, _) in enumerate(rows(420, 3, text_ids))]
    docs[7] = (docs[7][0], docs[100][1], docs[7][2])  # as near as a document of another group
    asked = docs[::5]
    c = spark.createDataFrame(docs, f"doc_id {kind}, vector array<float>, group int")
    q = spark.createDataFrame(asked, f"query_id {kind}, vector array<float>, group int")
    wanted = {}
    for i, v, g in [(i, np.array(v, np.float32).astype(float), g) for i, v, g in asked]:
        scores = sorted((-round(float(np.dot(v, np.array(w, np.float32).astype(float))), 9), d, x) for d, w, x in docs if d != i)
        rank = next(r for r, (_, _, x) in enumerate(scores, 1) if x == g)
        wanted |= {i: rank} if rank <= 10 else {}
    assert 3 < len(wanted) < len(asked) / 2
    assert dict(map(tuple, vectors.first_ranks(q, c, 10).collect())) == wanted


def test_slice_counts_instead_of_listing(spark, data, monkeypatch):
    """The end-to-end query asks no query for its whole list (F3): hit rate and MRR need one rank."""
    from passagework.plans import retrieval_queries

    seen, real = [], blocked.meet

    def meet(corpus, queries, *a, **b):
        seen.append(queries.count())
        return real(corpus, queries, *a, **b)

    monkeypatch.setattr(blocked, "meet", meet)
    monkeypatch.setattr(blocked, "PART_ROWS", 400)
    found = retrieval_queries.retrieval_slice(spark, data).collect()
    assert len(found) == 4 and len(seen) == 2
    assert seen[-1] < seen[0]
