"""Text encoders: a protocol, a dependency-free hashing encoder, templates, long-text pooling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from enum import Enum
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.operators import tokens


class TemplateMode(Enum):
    NONE = "none"
    BGE = "bge"

    @classmethod
    def of(cls, name: str) -> TemplateMode:
        """Unknown names mean BGE."""
        return cls.NONE if name.lower() == "none" else cls.BGE


#: Fixed instructions of the BGE template.
INSTRUCTIONS = {
    "query": "Represent this sentence for searching relevant passages: ",
    "passage": "Represent this sentence for retrieving relevant passages: ",
}
#: Fixed short names of public models.
ALIASES = {
    "bge-m3": "BAAI/bge-m3",
    "bge-m3-ko": "dragonkue/BGE-m3-ko",
    "ko-simcse": "jhgan/ko-sroberta-multitask",
    "multilingual-minilm": "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2",
    "multilingual-e5-small": "intfloat/multilingual-e5-small",
}


#: Characters (and rows of the result) that an encoder is given at a time, so that the words of a batch don't add up.
AT_ONCE = 500_000


def pieces(texts: pd.Series, at_once: int) -> list[tuple[int, int]]:
    """Neighbouring texts of ``at_once`` characters together, or a single longer one."""
    sizes = np.cumsum(texts.str.len().fillna(0).to_numpy(np.int64) + 1)
    ends, at = [0], 0
    while at < len(sizes):
        at = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + at_once, "right")))
        ends.append(at)
    return list(zip(ends, ends[1:], strict=False))


def template(c: Column, side: str, mode: TemplateMode = TemplateMode.BGE) -> Column:
    """``c`` with the instruction of its side, "query" or "passage"."""
    return F.concat(F.lit(INSTRUCTIONS[side]), c) if mode is TemplateMode.BGE else c


class Encoder(Protocol):
    """Anything that turns a list of texts into a matrix of ``dims`` columns."""

    dims: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Signed feature hashing of white-space words, normalised to length 1."""

    def __init__(self, dims: int = 64, remember: int = 200_000):
        self.dims, self.remember = dims, remember
        self.places: dict[str, int] = {}

    def place(self, word: str) -> int:
        """Dimension of a word, as itself for +1 and as its complement for -1."""
        h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
        return h % self.dims if h >> 63 else ~(h % self.dims)

    def encode(self, texts: list[str]) -> np.ndarray:
        if len(self.places) > self.remember:
            self.places.clear()
        split = [x.split() for x in texts]
        for word in set().union(*split).difference(self.places):
            self.places[word] = self.place(word)
        at = np.fromiter((self.places[w] for words in split for w in words), np.int64)
        row = np.repeat(np.arange(len(texts)), [len(words) for words in split])
        out = np.zeros((len(texts), self.dims), np.float64)
        np.add.at(out, (row, np.where(at < 0, ~at, at)), np.where(at < 0, -1.0, 1.0))
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def encode(
    df: DataFrame, text: Column, encoder: Encoder, out: str = "vector", max_words: int | None = None, pool_long: bool = False, double: bool = False,
    tokenizer: tokens.Tokenizer | None = None, max_tokens: int | None = None, overlap: int = 0,
) -> DataFrame:
    """``df`` with ``out``, an array of floats (or doubles).

    Texts of more than ``max_words`` words, or of more than ``max_tokens`` tokens of ``tokenizer``,
    are cut; or, with ``pool_long``, encoded in parts (windows of tokens, cut back to the text) whose
    mean is normalised again.  The encoder is made once a task.
    """
    if max_tokens is not None:
        tokens.check(max_tokens, overlap)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.concat([vectors_of(batch.iloc[a:b]) for a, b in pieces(batch, AT_ONCE)]) if len(batch) else pd.Series([], dtype=object)

    def vectors_of(texts: pd.Series) -> pd.Series:
        parts: list[str] = []
        owner: list[int] = []
        for i, x in enumerate(texts.fillna("")):
            if tokenizer is not None and max_tokens:
                cuts = [c for _, _, c in tokens.cut_text(x, tokenizer, max_tokens, overlap)] or [x]
                cuts = cuts if pool_long else cuts[:1]
                parts += cuts
                owner += [i] * len(cuts)
                continue
            words = x.split()
            if max_words and len(words) > max_words:
                cuts = [" ".join(words[k : k + max_words]) for k in range(0, len(words), max_words)]
                cuts = cuts if pool_long else cuts[:1]
            else:
                cuts = [x]
            parts += cuts
            owner += [i] * len(cuts)
        sums, counts = np.zeros((len(texts), encoder.dims)), np.bincount(owner, minlength=len(texts)) if owner else np.ones(len(texts))
        if parts:
            np.add.at(sums, owner, encoder.encode(parts))
        means = sums / np.maximum(counts, 1)[:, None]
        norms = np.linalg.norm(means, axis=1, keepdims=True)
        means = np.divide(means, norms, out=means, where=norms > 0)
        return pd.Series(list(means if double else means.astype(np.float32)))

    return df.withColumn(out, F.pandas_udf(run, T.ArrayType(T.DoubleType() if double else T.FloatType()))(text))


def encode_queries(df: DataFrame, text: Column, encoder: Encoder, tokenizer: tokens.Tokenizer | None = None, max_tokens: int | None = None, mode: TemplateMode = TemplateMode.BGE, out: str = "vector", double: bool = False) -> DataFrame:
    """Queries under their template; what is longer than ``max_tokens`` is cut off."""
    return encode(df, template(F.coalesce(text, F.lit("")), "query", mode), encoder, out, double=double, tokenizer=tokenizer, max_tokens=max_tokens)


def encode_passages(df: DataFrame, text: Column, encoder: Encoder, tokenizer: tokens.Tokenizer | None = None, max_tokens: int | None = None, mode: TemplateMode = TemplateMode.BGE, out: str = "vector", double: bool = False, overlap: int = 0) -> DataFrame:
    """Passages under their template; longer ones are encoded window by window and their mean is normalised."""
    return encode(df, template(F.coalesce(text, F.lit("")), "passage", mode), encoder, out, pool_long=True, double=double, tokenizer=tokenizer, max_tokens=max_tokens, overlap=overlap)
