"""Host rules, ropes and hard negatives (11 to 13) against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.llm import hardnegs, hostrules, ropes
from passagework.operators import blocked

TEXTS = st.text(alphabet="ab<>PSM\n\ré\U0001f600 ", max_size=60)


# -- host rules


def slow_counts(text: str) -> tuple[int, ...]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), again, len(inside)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ée", "#x", "\n", "\t", "\x85", "\x1c", "　"]), max_size=80), st.sampled_from([3, 4_000_000]))
def test_counts(parts, piece):
    before, hostrules.PIECE = hostrules.PIECE, piece
    try:
        text = " ".join(parts)
        assert hostrules.count(text) == slow_counts(text)
    finally:
        hostrules.PIECE = before


def test_rates_shrink_and_verdicts_follow(spark):
    clean = "one two three four five six seven eight nine ten eleven"
    symbols = clean + " # # # #"
    rows = [(clean, "large")] * 950 + [(symbols, "large")] * 50 + [(symbols, "tiny")] + [("x", "junk")] * 200 + [(clean, "junk")] * 2 + [(clean, "good")] * 2000 + [(symbols, "good")] * 4 + [(clean, None), (symbols, None)]
    docs = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(rows)], "doc_id long, text string, source string")
    rates = {r["host"]: r for r in hostrules.host_rates(hostrules.counts(docs)).collect()}
    assert rates["large"]["r_symbols"] == pytest.approx(0.05, abs=0.01)
    assert 0 < rates["tiny"]["r_symbols"] < 1  # one document proves little
    found = hostrules.judge(docs)
    kept = {(r["host"], r["failed"][0] if r["failed"] else None): (r["kept"], r["n"]) for r in found.groupBy("host", "failed").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).collect()}
    assert kept[("large", None)] == (True, 950)
    assert kept[("large", "symbols")] == (False, 50)
    assert kept[("good", "symbols")] == (True, 4)  # too seldom there to be enforced
    assert kept[("junk", None)] == (False, 2)  # the host is given up
    assert kept[("good", None)] == (True, 2000)
    assert kept[(None, None)] == (True, 1)


def test_rules_meet_odd_rows(spark):
    rows = [(1, None, "a", "x"), (1, None, "a", "x"), (None, "", None, "y"), (3, "w " * 200_000, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string")
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in hostrules.judge(docs).collect())
    assert found == [(0, 0, 0, True, False), (1, 0, 0, True, False), (1, 0, 0, True, False), (3, 200_000, 200_000, True, False)]
    assert hostrules.judge(docs.where("false")).collect() == []


def test_hot_host_is_dealt_out(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text " * 8).alias("text"), F.lit("hot").alias("source"))
    plan = hostrules.judge(docs)._jdf.queryExecution().analyzed().toString()
    assert "salt" in plan
    assert hostrules.judge(docs).count() == 4000


# -- ropes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\n", min_size=1, max_size=9), max_size=40), st.integers(0, 45), st.integers(1, 12))
def test_splits(units, rank, fill):
    rope = ropes.build(units, fill)
    a, b = ropes.split(rope, rank)
    assert [*ropes.pieces(a)] == units[:rank]
    assert [*ropes.pieces(b)] == units[rank:]
    text = "".join(units)
    a, b = ropes.split_chars(rope, rank)
    assert ropes.flat(a) == text[:rank]
    assert ropes.flat(b) == text[rank:]
    for part in (a, b):
        assert part is None or part.n_chars == len(ropes.flat(part))
        assert part is None or part.n_units == len([*ropes.pieces(part)])


def test_trees_are_balanced():
    rope = ropes.build(["x\n"] * 100_000)
    depth = lambda r: 1 if isinstance(r, ropes.Leaf) else 1 + max(depth(r.left), depth(r.right))
    assert depth(rope) <= 11
    a, b = ropes.split(rope, 33_333)
    assert depth(a) <= 12
    assert depth(b) <= 12


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 50), st.integers(0, 50), st.sampled_from(["psm", "spm"]))
def test_outputs_are_restored(text, one, two, form):
    if any(s in text for s in (ropes.PREFIX, ropes.SUFFIX, ropes.MIDDLE)):
        return
    units = ropes.lines(text)
    low, high = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    head, suffix = ropes.split(ropes.build(units, 5), high)
    prefix, middle = ropes.split(head, low)
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    output = ropes.flat(ropes.rearranged(prefix, middle, suffix, form))
    assert output == (f"<P>{a}<S>{c}<M>{b}" if form == "psm" else f"<S>{c}<P>{a}<M>{b}")
    assert ropes.flat(ropes.restored(output, form)) == text


def test_transform_meets_odd_rows(spark):
    long = "".join(f"line {i} é\U0001f600\n" for i in range(50_000))
    rows = [(1, "a\nb\nc", "mine"), (1, "a\nb\nc", "mine"), (2, None, None), (3, "", "x"), (None, "a<S>b", "y"), (4, long, "z"), (None, "no end", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    done = ropes.transform(docs)
    back = ropes.restore(done.drop("text"))
    assert sorted((r["doc_id"] or 0, r["restored"]) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    forms = {(r["doc_id"], r["n"]): r["form"] for r in done.collect()}
    assert forms[(2, 0)] == forms[(3, 0)] == forms[(None, 1)] or forms[(None, 1)] in ("psm", "spm")
    assert forms[(4, 50_000)] in ("psm", "spm")
    assert done.where("doc_id = 1").select("output").distinct().count() == 1
    assert ropes.transform(docs.where("false")).collect() == []
    assert {r["form"] for r in ropes.transform(docs, rate=0).collect()} == {"plain"}


# -- hard negatives


def slow_negatives(rows, anchors, k=5):
    held: dict[int, tuple] = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = tuple(int(np.floor(256 * y)) for y in v)
        held[i] = min(held.get(i, (label, x)), (label, x))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for a in sorted(i for i in held if anchors(i)):
        label, x = held[a]
        scored = sorted((-dot(x, y), i, other == label) for i, (other, y) in held.items() if i != a)
        for s, p, _ in [r for r in scored if r[2]][:k]:
            found = [(n, -t) for t, n, same in scored if not same and -80 * s <= -100 * t <= -100 * s][:k]
            out += [(a, p, r, n, -s, t) for r, (n, t) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "grid"), [(1, 40), (2, 2), (3, 0)])
def test_negatives_are_brute_force(spark, monkeypatch, seed, grid):
    monkeypatch.setattr(blocked, "PART_ROWS", 100)
    monkeypatch.setattr(hardnegs, "SCORES_AT_ONCE", 900)
    monkeypatch.setattr(hardnegs, "SAMPLE", 64)
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=7)
    rows = [(i, [float(round(x * grid) / grid if grid else x) for x in draw.normal(size=7) + centre], int(draw.integers(0, 3))) for i in range(600)]
    rows += rows[:40]  # repeats
    rows += [(None, rows[0][1], 1), (700, None, 1), (720, [1.0, None], 1), (740, [float("nan")] * 7, 1), (760, [float("inf")] * 7, 1), (780, rows[1][1], None), (800, [], 2), (820, [0.5, 2.0], 0), (5, rows[9][1], 2)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, codes string")
    found = sorted(tuple(r) for r in hardnegs.mine(df, F.col("id") % 20 == 0).collect())
    assert found == slow_negatives(rows, lambda i: i % 20 == 0)
    assert len(found) > 100
    assert hardnegs.mine(df.where("false"), F.col("id") % 20 == 0).collect() == []


def test_bounds_hold_and_spare_most_rows():
    draw = np.random.default_rng(4)
    x = np.floor(256 * draw.normal(size=(5000, 32)) / 6).astype(np.int64)
    books = hardnegs.fit(x[:1000].astype(float))
    codes, left = hardnegs.coded(x.astype(float), books)
    table = pa.table({"id": np.arange(5000), "label": np.zeros(5000, int), "x": pa.array(x.tolist()), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "left": left})
    part = hardnegs.Part(table, books, 32)
    lower, upper = part.bounds(np.arange(5000), x[:50])
    true = x @ x[:50].T
    assert (lower <= true).all()
    assert (true <= upper).all()
    assert (upper >= hardnegs.at_least(lower, 5)[None, :]).mean() < 0.1  # few are left to score exactly
