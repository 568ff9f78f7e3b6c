"""Chunk units and the figures of evaluation reports."""

from __future__ import annotations

import math

import pytest

from passagework.operators import encode, evaluation, units

STATUTE = "id string, parent_id string, type string, law_id string, law_name string, article string, effective_date string, text string, file string, rec_no int, a_pos int, p_pos int, i_pos int"
PAIR = "query_id string, query_text string, positive_passages array<string>, meta struct<type: string>"


def law(ident, parent, text, article, a, p=0, i=0):
    return (ident, parent, "법령", "1", "법", article, "2020", text, "f", 0, a, p, i)


@pytest.fixture
def passages(spark):
    statutes = [law("L_1", "L_1", "apples grow on trees", "1", 0), law("L_2_1", "L_2", "ships sail far north wind", "2", 1, 0), law("L_2_2", "L_2", "trains run on rails", "2", 1, 1)]
    items = [law("L_1", "L_1", "apples grow on trees", "1", 0), law("L_2_1_1", "L_2_1", "ships sail far", "2", 1, 0, 0), law("L_2_1_2", "L_2_1", "north wind", "2", 1, 0, 1), law("L_2_2", "L_2", "trains run on rails", "2", 1, 1)]
    rules = spark.createDataFrame([("R_1", "행정규칙", "rules of the harbour")], "id string, type string, text string")
    return spark.createDataFrame(statutes, STATUTE), spark.createDataFrame(items, STATUTE), rules


@pytest.fixture
def asked(spark):
    rows = [("q1", "ships north", ["L_2_2", "L_2_1"], ("a",)), ("q2", "apples", ["L_1", "R_1"], ("b",)), ("q3", "nothing", [], ("b",)), ("q4", "void", None, None), ("q5", "harbour rules", ["gone"], ("a",))]
    return spark.createDataFrame(rows, PAIR)


def test_corpora_and_hierarchy(passages):
    held = units.corpora(*passages)
    ids = {u: sorted(r["id"] for r in df.collect()) for u, df in held.items()}
    assert ids == {"paragraph": ["L_1", "L_2_1", "L_2_2", "R_1"], "item": ["L_1", "L_2_1_1", "L_2_1_2", "L_2_2", "R_1"], "article": ["L_1", "L_2", "R_1"]}
    assert held["article"].where("id = 'L_2'").first()["text"] == "ships sail far north wind\ntrains run on rails"
    found = sorted(map(tuple, units.hierarchy(*passages[:2]).collect()))
    assert found == [("L_1", "L_1", "article"), ("L_1", "L_1", "item"), ("L_2_1", "L_2", "article"), ("L_2_1", "L_2_1_1", "item"), ("L_2_1", "L_2_1_2", "item"), ("L_2_2", "L_2", "article"), ("L_2_2", "L_2_2", "item")]


def test_positives_move_with_the_unit(passages, asked):
    members = units.hierarchy(*passages[:2])
    lists = lambda kind: {r["query_id"]: r["positive_passages"] for r in units.remap(asked, members, kind).collect()}
    assert lists("article") == {"q1": ["L_2"], "q2": ["L_1", "R_1"], "q3": [], "q4": [], "q5": ["gone"]}
    assert lists("item") == {"q1": ["L_2_2", "L_2_1_1", "L_2_1_2"], "q2": ["L_1", "R_1"], "q3": [], "q4": [], "q5": ["gone"]}
    assert lists("paragraph")["q1"] == ["L_2_2", "L_2_1"]


def slow_metrics(coder, texts, asked, ks):
    """Mean accuracy, reciprocal rank and recall at each k, by a loop."""
    names = sorted(texts)
    matrix = coder.encode([encode.INSTRUCTIONS["passage"] + texts[n] for n in names])
    out = {}
    for k in ks:
        rows = []
        for text, wanted in asked:
            scores = (matrix @ coder.encode([encode.INSTRUCTIONS["query"] + text])[0]).round(9)
            top = [names[i] for i in sorted(range(len(names)), key=lambda i: (-scores[i], names[i]))[:k]]
            hits = [i for i, n in enumerate(top) if n in wanted]
            rows.append((bool(hits), 1 / (hits[0] + 1) if hits else 0.0, len(hits) / len(wanted)))
        out[k] = tuple(sum(x) / len(rows) for x in zip(*rows, strict=True))
    return out


def test_study_figures(spark, passages, asked):
    coders = {"small": encode.HashingEncoder(32), "large": encode.HashingEncoder(256)}
    info = spark.createDataFrame([("small", 0.1)], "model string, size double")
    rows = units.study(*passages, asked, coders, [1, 2], info).collect()
    assert len(rows) == 3 * 2 * 2
    held, members = units.corpora(*passages), units.hierarchy(*passages[:2])
    for unit in units.UNITS:
        texts = {r["id"]: r["text"] for r in held[unit].collect()}
        questions = [(r["query_text"], r["positive_passages"]) for r in units.remap(asked, members, unit).collect() if r["positive_passages"]]
        words = [len(t.split()) for t in texts.values()]
        for model, coder in coders.items():
            wanted = slow_metrics(coder, texts, questions, [1, 2])
            for r in (r for r in rows if (r["unit"], r["model"]) == (unit, model)):
                assert (r["accuracy"], r["mrr"], r["recall"]) == pytest.approx(wanted[r["k"]])
                assert r["queries"] == len(questions)
                assert r["avg_tokens"] == pytest.approx(sum(words) / len(words))
                assert r["tokens"] == pytest.approx(r["k"] * sum(words) / len(words))
                assert r["size"] == (0.1 if model == "small" else None)
    assert {r["saved"] for r in rows if r["unit"] == "paragraph"} == {0.0}


@pytest.fixture
def searched(spark, passages, asked):
    corpus = units.corpora(*passages)["paragraph"]
    return {n: evaluation.search(encode.HashingEncoder(n), corpus, asked, [1, 3]) for n in (32, 256)}, {r["id"]: r["text"] for r in corpus.collect()}


def test_report_figures(searched, asked):
    found, texts = searched
    questions = [(r["query_text"], r["positive_passages"]) for r in asked.collect() if r["positive_passages"]]
    wanted = slow_metrics(encode.HashingEncoder(256), texts, questions, [1, 3])
    means = {r["k"]: r for r in found[256].means().collect()}
    for k in (1, 3):
        assert (means[k]["accuracy"], means[k]["mrr"], means[k]["recall"]) == pytest.approx(wanted[k])
        assert means[k]["queries"] == 3
    failed = {r["query_id"]: r for r in found[256].failed().collect()}
    assert "q5" in failed
    assert failed["q5"]["positive_passages"] == ["gone"]
    assert len(failed["q5"]["retrieved"]) == 3
    pooled = {r["bucket"]: r["queries"] for r in found[256].by_length().collect()}
    assert pooled == {"very_short": 3}
    assert sum(r["queries"] for r in found[256].by_source().collect()) == 3
    spread = {r["metric"]: r for r in found[256].distribution().collect()}
    assert spread["mrr"]["mean"] == pytest.approx(wanted[3][1])
    assert spread["recall"]["mean"] == pytest.approx(wanted[3][2])
    assert spread["recall"]["n"] == 3
    text = evaluation.detailed_report(found[256], "Report")
    assert text.startswith("# Report")
    assert f"{wanted[3][1]:.4f}" in text
    assert f"Queries without a hit: {len(failed)}" in text


def test_models_are_compared(searched):
    found, _ = searched
    models = {str(n): s for n, s in found.items()}
    rows = evaluation.compare(models).collect()
    for k in (1, 3):
        top = max(r["mrr"] for r in rows if r["k"] == k)
        assert all(r["best"] == math.isclose(r["mrr"], top) for r in rows if r["k"] == k)
    assert len(evaluation.compare_sources(models).collect()) == sum(s.by_source().count() for s in found.values())
    assert "# Models by source" in evaluation.comparison_report(models)


def test_similarity_rows(spark):
    draw = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(12)]
    corpus = spark.createDataFrame(draw, "doc_id long, vector array<double>")
    queries = spark.createDataFrame(draw[:3], "query_id long, vector array<double>")
    wanted = spark.createDataFrame([(0, 4), (0, 7), (2, 5)], "query_id long, doc_id long")
    rows = evaluation.similarity_rows(queries, corpus, wanted).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(draw[a][1], draw[b][1], strict=True))
    assert sorted((r["query_id"], r["score"]) for r in rows if r["kind"] == "positive") == sorted([(0, dot(0, 4)), (0, dot(0, 7)), (2, dot(2, 5))])
    for q, n, out in ((0, 2, {4, 7}), (1, 1, set()), (2, 1, {5})):
        best = sorted((-dot(q, d), d) for d in range(12) if d not in out)[:n]
        assert sorted(r["score"] for r in rows if r["kind"] == "negative" and r["query_id"] == q) == sorted(-s for s, _ in best)
