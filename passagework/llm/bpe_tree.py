"""Byte-level BPE as a monoid: encode halves, join them over a boundary window.

A text is halved recursively down to leaves of ``leaf`` characters, each leaf is encoded on its
own, and neighbours are joined by encoding again only a window around their boundary.  The window
grows outwards (16, 32, 64 ... characters) until both of its ends are *seams*: places where a
character that is not white space is followed by white space.  No piece of the split pattern holds
white space after another character, and no piece looks further than the first character of the
white space that follows it, so the text before a seam and the text from it on are encoded
independently: tokens outside the window can't change.  Where a side has no seam the window
reaches that side's end and the join is still exact.

Null and empty texts have no tokens.  Rows are independent: repeated rows, ties and further
columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from passagework.llm.common import batch_rows

#: The Unicode white space (fixed by the standard), as the split pattern's ``\s`` has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEAM = regex.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")
SEAM_LAST = regex.compile(rf"(?r)(?<=[^{SPACE}])(?=[{SPACE}])")
#: Characters of a leaf (and ids of one in decoding): small, so that most documents are trees.
LEAF = 512
FIRST_WINDOW = 16


@lru_cache(maxsize=4)
def load(rank_file: str, pattern: str):
    """The base encoder of leaves and windows, and the bytes of each token."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    table: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return encoder, table


def seam_before(text: str, low: int, mid: int) -> int:
    """The last seam in (low, mid), searched in growing windows; ``low`` if there is none."""
    width = FIRST_WINDOW
    while True:
        start = max(low, mid - width)
        found = SEAM_LAST.search(text, start + 1, mid) if start + 1 < mid else None
        if found:
            return found.start()
        if start == low:
            return low
        width *= 2


def seam_after(text: str, mid: int, high: int) -> int:
    """The first seam in (mid, high), searched in growing windows; ``high`` if there is none."""
    width = FIRST_WINDOW
    while True:
        stop = min(high, mid + width)
        found = SEAM.search(text, mid + 1, stop)
        if found and found.start() < stop:
            return found.start()
        if stop == high:
            return high
        width *= 2


def encode_tree(text: str, encode: Callable[[str], np.ndarray], leaf: int = LEAF) -> np.ndarray:
    """Token ids of ``text`` by tree reduction over ``encode``."""

    def reduce(low: int, high: int) -> np.ndarray:
        if high - low <= leaf:
            return encode(text[low:high])
        mid = (low + high) // 2
        left, right = reduce(low, mid), reduce(mid, high)
        start, stop = seam_before(text, low, mid), seam_after(text, mid, high)
        cut = len(encode(text[start:mid]))
        skip = len(encode(text[mid:stop]))
        return np.concatenate([left[: len(left) - cut], encode(text[start:stop]), right[skip:]])

    return reduce(0, len(text))


def decode_tree(ids: np.ndarray, table: list[bytes], leaf: int = LEAF) -> bytes:
    """Bytes of ``ids``: decoding is a homomorphism, so parts are joined as they are."""
    if len(ids) <= leaf:
        return b"".join([table[i] for i in ids.tolist()])
    mid = len(ids) // 2
    return decode_tree(ids[:mid], table, leaf) + decode_tree(ids[mid:], table, leaf)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", leaf: int = LEAF) -> DataFrame:
    """``df`` with the column ``ids`` (array of int) in place of ``text``."""
    batch_rows(df.sparkSession)
    kept = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([*(f for f in df.schema if f.name in kept), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = load(rank_file, pattern)
        for batch in batches:
            found = [encode_tree(x or "", encoder.encode_to_numpy, leaf) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists(found)], [*kept, ids])

    return df.select(*kept, text).mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", data: str = "decoded", leaf: int = LEAF) -> DataFrame:
    """``df`` with the column ``data`` (binary), the bytes that ``ids`` stand for; null ids: empty."""
    batch_rows(df.sparkSession)
    kept = [c for c in df.columns if c != data]
    schema = T.StructType([*(f for f in df.schema if f.name in kept), T.StructField(data, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = load(rank_file, pattern)
        for batch in batches:
            column = batch.column(ids)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            found = [decode_tree(flat[a:b], table, leaf) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.binary())], [*kept, data])

    return df.mapInArrow(run, schema)
