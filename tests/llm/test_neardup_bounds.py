"""What the closing step of near-duplicates costs, and links over rows without an id."""

from __future__ import annotations

import random

import pytest

from passagework.llm import labelled, neardup
from tests.llm.test_llm import slow_components

SCHEMA = "doc_id long, text string"


def counted(monkeypatch) -> list[int]:
    """How many candidates each closing step makes."""
    made: list[int] = []
    real = neardup.entry_pairs

    def watched(entries, percent):
        found = real(entries, percent)
        made.append(found.count())
        return found

    monkeypatch.setattr(neardup, "entry_pairs", watched)
    return made


def template(n: int, draw: random.Random) -> list[tuple[int, str]]:
    """Documents of 720 common words and 20 phrases of a pool as large as the table: alike by about 0.78."""
    common = " ".join(f"c{i}" for i in range(720))
    pool = [" ".join(f"p{i}x{k}" for k in range(5)) for i in range(n)]
    return [(i, " ".join([common, *draw.sample(pool, 20)])) for i in range(n)]


@pytest.mark.parametrize("n", [150, 300])
def test_template_families_cost_no_square(spark, monkeypatch, n):
    made = counted(monkeypatch)
    rows = template(n, random.Random(5))
    rows += [(10_000 + i, " ".join(t.split()[:-10])) for i, (_, t) in enumerate(rows[:20])]  # and some that are linked
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=4).collect()}
    assert all(found[10_000 + i] == found[i] for i in range(20))
    assert sum(made) <= 2 * n  # of up to n * n / 2


def test_common_passages_leave_no_candidates(spark, monkeypatch):
    made = counted(monkeypatch)
    common = [f"c{i}" for i in range(70)]
    rows = [(i, " ".join([*common, *(f"o{i}x{k}" for k in range(12))])) for i in range(200)]
    rows += [(1000 + i, " ".join([*common, *(f"p{i}x{k}" for k in range(i % 20))])) for i in range(200)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=1)
    assert sorted(map(tuple, found.collect())) == slow_components(rows, 1, 80)
    assert sum(made) <= 2 * len(rows)


def words(*runs: tuple[str, int]) -> str:
    return " ".join(f"{name}{i}" for name, n in runs for i in range(n))


@pytest.mark.parametrize("middle", [2, None])
def test_rows_without_an_id_link_others(spark, middle):
    """1 and 3 are linked over the text between them alone, whether that has an id or not."""
    texts = [words(("a", 90), ("b", 10)), words(("a", 90), ("c", 4)), words(("a", 80), ("c", 4), ("d", 5))]
    ids = [1, middle, 3]
    rows = list(zip(ids, texts, strict=True))
    named = sorted(slow_components([(1, texts[0]), (2, texts[1]), (3, texts[2])], 1, 80))
    assert {r[2] for r in named} == {1}
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=1)
    assert sorted(((r["doc_id"], r["component_id"]) for r in found.collect()), key=str) == sorted(((i, 1) for i in ids), key=str)
    only = neardup.near_duplicates(spark.createDataFrame([(None, t) for t in texts] + [(None, texts[0])] * 3, SCHEMA), words=1)
    assert {r["component_id"] for r in only.collect()} == {None}


def test_samples_are_bounded(spark):
    from pyspark.sql import functions as F

    rows = [(7, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(100, 150)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(7, 1), (7, 0), *((i, 0) for i in range(100, 150)), (999, 1)], "doc_id long, quality int")
    held = labelled.sample(df, labels, "quality", F.lit(True), 30).collect()
    assert len(held) <= 30
    every = labelled.sample(df, labels, "quality", F.lit(True), 1000).collect()
    assert sorted(r["doc_id"] for r in every) == [7, *range(100, 150)]
    assert next(r["label"] for r in every if r["doc_id"] == 7) == 1.0


def test_case_is_folded_in_every_script():
    from passagework.llm import toxicity

    for upper, lower in (("ИДИОТ", "идиот"), ("ΗΛΙΘΙΟΣ", "ηλιθιος"), ("ԱԲԳ", "աբգ"), ("ÄRGER", "arger")):
        assert toxicity.tokens([upper])[0].tolist() == toxicity.tokens([lower])[0].tolist()
    assert toxicity.tokens(["идиот"])[0].tolist() != toxicity.tokens(["дидот"])[0].tolist()
