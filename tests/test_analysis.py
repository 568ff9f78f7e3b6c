"""Reports on corpora and pairs, and what training rows are made of."""

from __future__ import annotations

import json
import statistics

import numpy as np
import pytest

from passagework import cli
from passagework.operators import analysis, encode, pairs, precedent_pairs, tokens
from passagework.sources import tables
from tests import legal_records as L

PAIR = "query_id string, query_text string, positive_passages array<string>, hard_negatives array<string>, meta struct<type: string>"
ROWS = [
    ("q1", "one two three", ["a", "b"], ["c"], ("law",)), ("q2", "four", ["a"], [], ("law",)), ("q3", "", ["x"], None, None),
    ("q4", "five six " * 30, [], ["a", "b", "c"], ("prec",)), ("q5", None, None, ["a"], (None,)),
]
TEXTS = {"a": "alpha beta", "b": "gamma  delta\nepsilon", "c": "", "d": "unused words here"}


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(ROWS, PAIR)


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id string, text string")


def stats(values):
    quarters = statistics.quantiles(values, n=4) if len(values) > 1 else [values[0]] * 3
    return len(values), min(values), max(values), statistics.mean(values), statistics.median(values), statistics.stdev(values) if len(values) > 1 else 0.0, quarters[0], quarters[2]


def test_pair_statistics(asked, corpus):
    names = ("n", "min", "max", "mean", "median", "stdev", "p25", "p75")
    found = {r["measure"]: tuple(r[n] for n in names) for r in analysis.pair_statistics(asked, corpus).collect()}
    expected = {"positives": [2, 1, 1, 0, 0], "negatives": [1, 0, 0, 3, 1], "query_tokens": [3, 1, 60], "passage_tokens": [2, 3]}
    assert set(found) == set(expected)
    for measure, values in expected.items():
        assert found[measure] == pytest.approx(stats(values))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_built_once_for_statistics(asked, corpus):
    """What the statistics are made of is a checkpoint: pairs aren't built once a measure (F18)."""
    assert "Union" not in _plan(analysis.pair_statistics(asked, corpus))


def test_example_rows_shuffle_the_corpus_once(spark, corpus):
    """One join to the corpus, one gathering (F19, F20); order, absent passages and repeated ids."""
    rows = [("q1", "one", ["b", "gone", "a"], ["d", "x", "a"]), ("q2", "two", ["x"], ["a"]), ("q3", None, ["c"], None), ("q4", "four", None, ["a"]), ("q1", "again", ["d"], [])]
    made = pairs.example_rows(spark.createDataFrame(rows, "query_id string, query_text string, positive_passages array<string>, hard_negatives array<string>"), corpus, 3)
    assert _plan(made).count("Join") == 1
    found = sorted(((r["query_id"], r["pos_id"], r["texts"]) for r in made.collect()), key=str)
    wanted = [("q1", "a", ["one", TEXTS["a"], TEXTS["d"], TEXTS["a"]]), ("q1", "b", ["one", TEXTS["b"], TEXTS["d"], TEXTS["a"]]), ("q1", "d", ["again", TEXTS["d"]]), ("q3", "c", [None, ""])]
    assert found == sorted(wanted, key=str)


def test_tokens_are_counted_by_any_tokenizer(spark, corpus):
    pieces = tokens.PieceTokenizer(3)
    found = {r["id"]: r["n"] for r in corpus.select("id", analysis.count(corpus["text"], pieces).alias("n")).collect()}
    assert found == {i: len(pieces.ids(t)) for i, t in TEXTS.items()}
    public = pytest.importorskip("public_tokenizers")
    held = tokens.FileTokenizer(public.path("byte_bpe_50k.json"))
    found = {r["id"]: r["n"] for r in corpus.select("id", analysis.count(corpus["text"], held).alias("n")).collect()}
    assert found == {i: len(held.ids(t)) for i, t in TEXTS.items()}


def test_types_and_samples(asked):
    found = {r["type"]: tuple(r)[1:] for r in analysis.type_summary(asked).collect()}
    assert found == {"law": (2, 0.4, 3, 1, 1.5, 0.5), "unknown": (2, 0.4, 1, 1, 0.5, 0.5), "prec": (1, 0.2, 0, 3, 0.0, 3.0)}
    first = analysis.sample_pairs(asked, 4).collect()
    assert [(r["query_id"], r["positives"], r["negatives"], r["type"]) for r in first] == [("q1", 2, 1, "law"), ("q2", 1, 0, "law"), ("q3", 1, 0, "unknown"), ("q4", 0, 3, "prec")]
    assert first[3]["query_text"].endswith("...") and len(first[3]["query_text"]) == 103


def test_training_rows(asked, corpus):
    rows = {(r["query_id"], r["pos_id"]): r["texts"] for r in pairs.training_rows(asked, corpus, 2, normalize=True).collect()}
    q, p = encode.INSTRUCTIONS["query"], encode.INSTRUCTIONS["passage"]
    assert rows[("q1", "b")] == [q + "one two three", p + "gamma delta epsilon", p]
    assert set(rows) == {("q1", "a"), ("q1", "b"), ("q2", "a")}
    plain = pairs.training_rows(asked, corpus, mode=encode.TemplateMode.NONE).collect()
    assert {tuple(r["texts"]) for r in plain} == {("one two three", "alpha beta"), ("one two three", "gamma  delta\nepsilon"), ("four", "alpha beta")}
    assert tuple(pairs.without_positive(asked, corpus).first()) == (5, 3)


def test_precedents_from_files(spark):
    laws, rules, *_ = L.parts(spark)
    built, chunks = precedent_pairs.from_files(L.files(spark), laws, rules)
    assert chunks.count() == 4
    assert built.count() > 0
    counted = {r["outcome"]: r["cases"] for r in analysis.outcome_counts(built).collect()}
    assert sum(counted.values()) == built.count()


def test_failed_citations(spark):
    laws = spark.createDataFrame([("L1", "민법", "제1조"), ("L2", "민법", "제10조"), ("L3", "민법", "제2조")], "id string, law_name string, article string")
    rules = spark.createDataFrame([("R1", "세칙 규칙", "제3조")], "id string, rule_name string, article string")
    cases = spark.createDataFrame([("1", "민법 제1조, 민법 제7조, 상법 제5조"), ("2", "상법 제5조"), ("3", None)], "case_id string, refs string")
    found = {(r["law_name"], r["article_num"]): (r["cases"], r["reason"], r["known"]) for r in analysis.failed_citations(cases, laws, rules, known=2).where("type = 'law'").collect()}
    assert found[("상법", "5")] == (2, "law", []) and found[("민법", "7")][1:] == ("article", ["1", "10"])
    assert ("민법", "1") not in found


def test_arrays(spark, tmp_path):
    df = spark.createDataFrame([("b", [3.0, 4.0]), ("a", [1.0, 2.0])], "id string, vector array<double>")
    assert tables.export_arrays(df, str(tmp_path / "both"), "both") == 2
    assert (tmp_path / "both" / "ids.txt").read_text() == "a\nb\n"
    assert np.load(tmp_path / "both" / "embeddings.npy").tolist() == [[1.0, 2.0], [3.0, 4.0]]
    assert sorted(p.name for p in (tmp_path / "both").iterdir()) == ["embeddings.npy", "embeddings.npz", "ids.npy", "ids.txt"]
    tables.export_arrays(df, str(tmp_path / "npy"), "npy")
    assert not (tmp_path / "npy" / "embeddings.npz").exists()
    with pytest.raises(ValueError, match="kind"):
        tables.export_arrays(df, str(tmp_path / "odd"), "odd")


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text("".join(json.dumps({"id": i, "text": t, "type": "법령"}, ensure_ascii=False) + "\n" for i, t in TEXTS.items()), encoding="utf-8")
    (tmp_path / "p.json").write_text(json.dumps({"query_id": "q", "query_text": "x y", "positive_passages": ["a"], "hard_negatives": [], "meta": {"type": "law"}}) + "\n")
    (tmp_path / "set.json").write_text('{"a": {"b": 1}}')
    cli.main(["analyze-pairs", "--pairs", str(tmp_path / "p.json"), "--corpus", str(tmp_path / "c.json")])
    cli.main(["analyze-passages", "--corpus", str(tmp_path / "c.json")])
    cli.main(["config", "--file", str(tmp_path / "set.json"), "--set", "a.c=2"])
    said = capsys.readouterr().out
    assert "passage_tokens" in said and "chars" in said and '"c": 2' in said
