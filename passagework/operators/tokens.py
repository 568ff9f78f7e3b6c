"""Windows of sub-word tokens, cut back to the exact text.

A tokenizer gives the places in a text (code points) at which its tokens begin, and their ids.  A text of
more than ``size`` tokens is taken apart in windows of ``size`` that share ``overlap`` tokens with the
one before; the window that reaches the last token is the last.  A shorter text is one window, whole; an
empty or null one has none.  Windows are cut from the text itself, from the begin of their first
token to that of the token after their last, so without overlap they add up to the text (what stands
before the first token belongs to the first window).  Decoding ids, by contrast, needn't give the text back.

``PieceTokenizer`` needs no vocabulary and stays in the JVM; ``FileTokenizer`` reads a public
tokenizer file (its path is a parameter) inside the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOWS = "array<struct<window_no: int, start: int, n_tokens: int, chunk: string>>"


class Tokenizer(Protocol):
    """Anything that finds tokens in texts."""

    def starts(self, text: str) -> np.ndarray:
        """Where each token begins, in code points, in order (several may begin at one)."""
        ...

    def ids(self, text: str) -> list[int]: ...


class PieceTokenizer:
    """White space with up to ``longest`` characters after it, and what white space is left over.

    An id is the CRC-32 of the piece.
    """

    def __init__(self, longest: int = 6):
        self.pattern = rf"[\x20\x09-\x0D]*[^\x20\x09-\x0D]{{1,{longest}}}|[\x20\x09-\x0D]+"
        self._find = re.compile(self.pattern)

    def starts(self, text: str) -> np.ndarray:
        return np.fromiter((m.start() for m in self._find.finditer(text)), np.int64)

    def ids(self, text: str) -> list[int]:
        import zlib

        return [zlib.crc32(x.encode()) for x in self._find.findall(text)]

    def pieces(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))


class FileTokenizer:
    """A tokenizer of the ``tokenizers`` library, loaded once a worker from its file."""

    _held: dict = {}

    def __init__(self, path: str):
        self.path = path

    def _loaded(self):
        if self.path not in FileTokenizer._held:
            from tokenizers import Tokenizer as Library

            FileTokenizer._held[self.path] = Library.from_file(self.path)
            FileTokenizer._held[self.path].encode_special_tokens = True  # their strings are ordinary text
        return FileTokenizer._held[self.path]

    def starts(self, text: str) -> np.ndarray:
        return np.array([a for a, _ in self._loaded().encode(text, add_special_tokens=False).offsets], np.int64)

    def ids(self, text: str) -> list[int]:
        return self._loaded().encode(text, add_special_tokens=False).ids


def check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and smaller than the window")


def spans(n: int, size: int, overlap: int = 0) -> list[tuple[int, int]]:
    """First token and end of each window of ``n`` tokens."""
    if n <= size:
        return [(0, n)]
    step = size - overlap
    last = -(-(n - size) // step)
    return [(k * step, min(k * step + size, n)) for k in range(last + 1)]


def cut_text(text: str, tokenizer: Tokenizer, size: int, overlap: int = 0) -> list[tuple[int, int, str]]:
    """start, tokens and text of each window."""
    if not text:
        return []
    starts = tokenizer.starts(text)
    at = [*np.maximum.accumulate(starts).tolist(), len(text)] if len(starts) else [len(text)]
    out = []
    for first, end in spans(len(starts), size, overlap):
        begin, to = at[first] if first else 0, at[end] if end < len(starts) else len(text)
        out.append((begin, end - first, text[begin:to]))
    return out


def window_column(text: Column, tokenizer: PieceTokenizer, size: int, overlap: int = 0) -> Column:
    """The windows of a text (``WINDOWS``) by built-in functions."""
    check(size, overlap)
    step = size - overlap

    def numbers(p: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(p) - size) / step).cast("int")))

    def begins(p: Column) -> Column:
        """Where each window begins: the lengths of the steps before it, added up (one number a window)."""
        lengths = F.transform(numbers(p), lambda k: F.length(F.array_join(F.slice(p, k * step + 1, step), "")))
        return F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def windows(held: Column) -> Column:
        p = held["p"]
        return F.transform(
            numbers(p),
            lambda k: F.struct(
                k.alias("window_no"), F.get(held["at"], k).alias("start"), F.least(F.lit(size), F.size(p) - k * step).alias("n_tokens"),
                F.array_join(F.slice(p, k * step + 1, size), "").alias("chunk"),
            ),
        )

    # as elements of arrays of one, pieces and begins are worked out once a text
    held = F.transform(F.array(tokenizer.pieces(text)), lambda p: F.struct(p.alias("p"), begins(p).alias("at")))
    return F.when(F.length(text) > 0, F.element_at(F.transform(held, windows), 1))


def token_windows(df: DataFrame, text: str, tokenizer: Tokenizer, size: int, overlap: int = 0) -> DataFrame:
    """``df`` without ``text``, a row for each window: window_no (from 0), start, n_tokens, chunk."""
    check(size, overlap)
    kept = [c for c in df.columns if c not in (text, "window_no", "start", "n_tokens", "chunk")]
    kinds = {"window_no": T.IntegerType(), "start": T.IntegerType(), "n_tokens": T.IntegerType(), "chunk": T.StringType()}
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, t) for n, t in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            for i in range(batch.num_rows):  # a text's windows are one batch, so that long texts don't add up
                found = cut_text(texts[i].as_py() or "", tokenizer, size, overlap)
                row = batch.slice(i, 1)
                repeat = pa.array(np.zeros(len(found), np.int64))
                made = [pa.array(range(len(found)), pa.int32()), *(pa.array([x[k] for x in found], pa.int32() if k < 2 else pa.string()) for k in range(3))]
                yield pa.RecordBatch.from_arrays([*(row.column(c).take(repeat) for c in kept), *made], [*kept, *kinds])

    return df.select(*kept, text).mapInArrow(run, schema)
