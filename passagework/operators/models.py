"""Bi-encoders by name: an encoder with the tokenizer and lengths that its texts are held to.

A name says the kind of features and how many dimensions: ``words-256``, ``grams-256`` (character
n-grams), ``pieces-256`` (sub-word tokens), with the longest passage window in tokens after a colon
(``pieces-256:128``).  Queries that are longer are cut, passages are encoded window by window.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from passagework.operators import encode, tokens

#: Tokens of a window where neither a caller nor a model's own settings say.
DEFAULT_LENGTH = 384
KINDS = ("words", "grams", "pieces")


def _summed(rows: list[np.ndarray], dims: int) -> np.ndarray:
    """Hashes (a few each) as signed features, normalised to length 1."""
    out = np.zeros((len(rows), dims))
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    np.add.at(out, (row, at // 2 % dims), np.where(at % 2, 1.0, -1.0))
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


class GramEncoder:
    """Signed hashing of character n-grams (of white space as one blank): forms of a word are near each other."""

    def __init__(self, dims: int = 256, n: int = 3):
        self.dims, self.n = dims, n

    def encode(self, texts: list[str]) -> np.ndarray:
        rows = []
        for text in texts:
            plain = f" {' '.join(text.split())} "
            rows.append(np.array([zlib.crc32(plain[i : i + self.n].encode()) for i in range(len(plain) - self.n + 1)], np.int64))
        return _summed(rows, self.dims)


class PieceEncoder:
    """Signed hashing of the ids of a tokenizer."""

    def __init__(self, dims: int, tokenizer: tokens.Tokenizer):
        self.dims, self.tokenizer = dims, tokenizer

    def encode(self, texts: list[str]) -> np.ndarray:
        return _summed([np.array([zlib.crc32(i.to_bytes(4, "little")) for i in self.tokenizer.ids(text)], np.int64) for text in texts], self.dims)


@dataclass
class Model:
    """Encodes columns of queries and passages under a template; long passages by windows."""

    name: str
    encoder: encode.Encoder
    tokenizer: tokens.Tokenizer = field(default_factory=tokens.PieceTokenizer)
    max_tokens: int = DEFAULT_LENGTH
    query_tokens: int | None = None
    overlap: int = 0
    mode: encode.TemplateMode = encode.TemplateMode.BGE

    def encode_queries(self, df: DataFrame, text: Column, out: str = "vector") -> DataFrame:
        return encode.encode_queries(df, text, self.encoder, self.tokenizer, self.query_tokens or self.max_tokens, self.mode, out)

    def encode_passages(self, df: DataFrame, text: Column, out: str = "vector") -> DataFrame:
        return encode.encode_passages(df, text, self.encoder, self.tokenizer, self.max_tokens, self.mode, out, overlap=self.overlap)


def length(folder: str | None = None, wanted: int | None = None) -> int:
    """Tokens of a window: what the caller wants, else ``max_len`` of the model folder's
    ``training_config.json``, else the default.  A file that can't be read counts as none."""
    if wanted:
        return wanted
    held = Path(folder) / "training_config.json" if folder else None
    if held is not None and held.is_file():
        try:
            found = json.loads(held.read_text(encoding="utf-8")).get("max_len")
        except (ValueError, AttributeError):
            found = None
        if found:
            return int(found)
    return DEFAULT_LENGTH


def named(name: str, tokenizer_file: str | None = None, mode: encode.TemplateMode = encode.TemplateMode.BGE) -> Model:
    """The model of a name such as ``grams-256:128``."""
    found = re.fullmatch(rf"({'|'.join(KINDS)})-([1-9]\d*)(?::([1-9]\d*))?", name)
    if not found:
        raise ValueError(f"{name!r} isn't a kind ({', '.join(KINDS)}), a dash and a number of dimensions")
    kind, dims = found[1], int(found[2])
    tokenizer = tokens.FileTokenizer(tokenizer_file) if tokenizer_file else tokens.PieceTokenizer()
    encoder = {"words": lambda: encode.HashingEncoder(dims), "grams": lambda: GramEncoder(dims), "pieces": lambda: PieceEncoder(dims, tokenizer)}[kind]()
    return Model(name, encoder, tokenizer, length(wanted=int(found[3]) if found[3] else None), mode=mode)


def information(spark: SparkSession, models: list[Model]) -> DataFrame:
    """model, dims and max_tokens of each, for reports to join."""
    return spark.createDataFrame([(m.name, m.encoder.dims, m.max_tokens) for m in models], "model string, dims int, max_tokens int")
