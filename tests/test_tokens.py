"""Token windows against a plain loop, and against the tokenizer libraries."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.operators import encode, tokens

PIECES = tokens.PieceTokenizer(3)


def loop(found: list[str], size: int, overlap: int) -> list[list[str]]:
    """Windows of tokens, one after the other."""
    if len(found) <= size:
        return [found]
    out, i = [], 0
    while True:
        end = min(i + size, len(found))
        out.append(found[i:end])
        if end == len(found):
            return out
        i = end - overlap


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcé\U0001f600 \n", max_size=70), st.integers(1, 9), st.integers(0, 8))
def test_windows_are_the_loop(text, size, overlap):
    overlap = min(overlap, size - 1)
    found = re.findall(PIECES.pattern, text)
    assert "".join(found) == text
    cut = tokens.cut_text(text, PIECES, size, overlap)
    assert [c for _, _, c in cut] == (["".join(w) for w in loop(found, size, overlap)] if text else [])
    assert all(text[a : a + len(c)] == c for a, _, c in cut)
    assert [n for _, n, _ in cut] == ([len(w) for w in loop(found, size, overlap)] if text else [])


def test_columns_equal_the_function(spark):
    texts = ["", None, "a", "one two three four five", "  lead", "tail  ", "é\U0001f600" * 9, "x" * 500, "w " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for size, overlap in ((2, 0), (5, 3), (4000, 1)):
        native = df.select("i", F.inline(tokens.window_column(F.col("text"), PIECES, size, overlap)))
        rows = tokens.token_windows(df, "text", PIECES, size, overlap)
        expected = sorted((i, k, a, n, c) for i, t in enumerate(texts) for k, (a, n, c) in enumerate(tokens.cut_text(t or "", PIECES, size, overlap)))
        assert sorted(map(tuple, native.collect())) == expected
        assert sorted(map(tuple, rows.collect())) == expected
    with pytest.raises(ValueError, match="overlap"):
        tokens.window_column(F.col("text"), PIECES, 4, 4)


def test_file_tokenizer_cuts_exact_text(spark, data):
    public = pytest.importorskip("public_tokenizers")
    held = tokens.FileTokenizer(public.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(40)
    texts = {r[0]: r[1] or "" for r in docs.collect()}
    texts[-1] = "日本語 \U0001f600é" * 30
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = tokens.token_windows(df, "text", held, 50).orderBy("doc_id", "window_no").collect()
    for i, text in texts.items():
        own = [r for r in rows if r["doc_id"] == i]
        assert "".join(r["chunk"] for r in own) == text
        assert sum(r["n_tokens"] for r in own) == len(held.ids(text))
        assert all(r["n_tokens"] == 50 for r in own[:-1])


def test_queries_are_cut_and_passages_pooled(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = spark.createDataFrame([(1, text), (2, None)], "i int, text string")
    coder, windows = encode.HashingEncoder(32), [c for _, _, c in tokens.cut_text(text, PIECES, 6)]
    none = encode.TemplateMode.NONE
    one = {r["i"]: r["vector"] for r in encode.encode_queries(df, F.col("text"), coder, PIECES, 6, none, double=True).collect()}
    many = {r["i"]: r["vector"] for r in encode.encode_passages(df, F.col("text"), coder, PIECES, 6, none, double=True).collect()}
    import numpy as np

    assert one[1] == pytest.approx(coder.encode(windows[:1])[0].tolist())
    mean = coder.encode(windows).mean(axis=0)
    assert many[1] == pytest.approx((mean / np.linalg.norm(mean)).tolist())
    assert not any(one[2]) and not any(many[2])
