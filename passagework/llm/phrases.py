"""Document fingerprints by locally consistent parsing.

A text is a string of symbols (code points).  Each level cuts the string into phrases of two or
three symbols and gives every phrase a name, a hash of its content; the names are the next level's
string.  Where to cut is decided by deterministic coin tossing: a symbol compared with the one
before it yields the lowest bit in which they differ, doubled, plus that bit; after ROUNDS such
rounds labels are below 8 (neighbours still differ), and a phrase begins at each local minimum of
the labels.  Runs of one symbol are folded to the symbol and its count beforehand.  A cut depends
on a few symbols to either side only, so equal substrings have equal phrases in their interior,
wherever they stand.

The fingerprint is a bottom-k sketch of the phrase names from level LOWEST upwards, each the text's
whatever its offset.  Likeness of two fingerprints is the sketches' estimate of the share of
phrases in common (Jaccard), 0 to 1; two empty fingerprints are alike.

Null counts as empty; an empty text's fingerprint is the empty string.  Very short texts are
named by their own symbols.  Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import batch_rows
from passagework.llm.shingles import mix

ROUNDS = 4
LOWEST, LEVELS = 2, 5
KEEP = 64
SYMBOLS_AT_ONCE = 1_000_000
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round on bytes: the lowest bit in which a label differs from the one before, doubled, plus its value."""
    differ = np.empty_like(labels)
    differ[1:] = labels[1:] ^ labels[:-1]
    differ[first] = 1  # the start of a text has nothing before it
    return _ROUND[differ, labels]


def _first_toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The same on 64-bit names; where the low bytes are alike the others decide."""
    low = names.astype(np.uint8)
    labels = _toss(low, first)
    alike = np.flatnonzero(low[1:] == low[:-1]) + 1
    alike = alike[~first[alike]]
    if len(alike):
        differ = names[alike] ^ names[alike - 1]
        at = np.log2((differ & (~differ + np.uint64(1))).astype(np.float64)).astype(np.uint64)
        labels[alike] = (at * np.uint64(2) + ((names[alike] >> at) & np.uint64(1))).astype(np.uint8)
    return labels


#: By difference and label: twice the lowest bit of the difference, plus that bit of the label.
_LOW = np.array([(d & -d).bit_length() - 1 if d else 0 for d in range(256)])
_ROUND = (2 * _LOW[:, None] + (np.arange(256)[None, :] >> _LOW[:, None] & 1)).astype(np.uint8)


def _level(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of a level: their names and documents."""
    new = np.empty(len(names), bool)
    new[0] = True
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    if not new.all():  # fold runs
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(names))).astype(np.uint64)
        names, doc = names[at], doc[at]
        longer = runs > 1
        names = np.where(longer, mix(names * _P[3] + runs), names)
    n = len(names)
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = doc[1:] != doc[:-1]
    labels = _first_toss(names, first)
    for _ in range(ROUNDS - 1):
        labels = _toss(labels, first)
    cut = first.copy()
    after = np.append(labels[1:], np.uint8(255))
    after[np.flatnonzero(first)[1:] - 1] = 255  # nothing stands after a text's last symbol
    cut[1:] |= (labels[1:] < labels[:-1]) & (labels[1:] <= after[1:])
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, n))
    place = np.arange(n) - np.repeat(starts, sizes)
    weights = _P[place & 1] + (place.astype(np.uint64) << np.uint64(32)) * _P[2]
    sums = np.add.reduceat(mix(names) * (weights | np.uint64(1)), starts)
    return mix(sums + sizes.astype(np.uint64)), doc[starts]


def sketches(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the KEEP smallest distinct phrase names, in order."""
    out: list[np.ndarray] = []
    group: list[str] = []
    size = 0
    for x in [*texts, None]:
        if group and (len(out) + len(group) == len(texts) or size + len(x or "") > SYMBOLS_AT_ONCE):
            out += _sketch_group(group)
            group, size = [], 0
        group.append(x or "")
        size += len(group[-1])
    return out


def _sketch_group(texts: list[str]) -> list[np.ndarray]:
    lengths = np.array([len(x) for x in texts])
    if not lengths.sum():
        return [np.zeros(0, np.uint64) for _ in texts]
    names = mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * _P[0] + _P[1])
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    held, whose = [], []
    for level in range(1, LEVELS + 1):
        names, doc = _level(names, doc)
        if level >= LOWEST:
            held.append(names)
            whose.append(doc)
    names, doc = np.concatenate(held), np.concatenate(whose)
    order = np.argsort(doc, kind="stable")
    names, edges = names[order], np.searchsorted(doc[order], np.arange(len(texts) + 1))
    return [np.unique(names[a:b])[:KEEP] if b > a else np.zeros(0, np.uint64) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of the KEEP smallest names of both together that both have."""
    if not len(x) and not len(y):
        return 1.0
    both = np.union1d(x, y)[:KEEP]
    return float(np.isin(both, x, assume_unique=True)[np.isin(both, y, assume_unique=True)].sum() / len(both))


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the column ``out``."""
    batch_rows(docs.sparkSession)
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*(f for f in docs.schema if f.name in kept), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [to_text(x) for x in sketches(batch.column(text).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string())], [*kept, out])

    return docs.select(*kept).mapInArrow(run, schema)


def followed(docs: DataFrame, parts: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in ascending order of ``doc_id`` (null first, ties by a hash of the text), dealt to parts
    of an id range each, with ``own`` false for the row that follows a part's last one.

    Splits come from approximate quantiles of the ids; the first rows of the parts (one id a part)
    are the only ones that are dealt twice, so nothing but one shuffle of the texts is needed.  Splits
    and first ids (a number a part each) go to the tasks as arrays, so the plan is the same for any
    number of parts.  Rows of one id, or without any, are one part's.
    """
    spark = docs.sparkSession
    none = F.lit(-(2**63))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), none).alias("id"))
    splits = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] if parts > 1 else []
    splits = np.array(sorted(set(splits or [])), np.int64)

    @F.pandas_udf(T.LongType())
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, ids.to_numpy(np.int64), "right"))

    found = ids.select(part_of("id").alias("part"), "id").groupBy("part").agg(F.min("id").alias("id")).orderBy("part").collect()  # a row a part
    first, order = np.array([r["id"] for r in found], np.int64), np.array([r["part"] for r in found], np.int64)
    before = np.roll(order, 1)  # the first part follows the last
    spots = _spots(spark, max(1, parts))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def targets(ids: pd.Series) -> pd.Series:
        """Where a row goes: place, part and whether it is the part's own, in one number."""
        values = ids.to_numpy(np.int64)
        own = np.searchsorted(splits, values, "right")
        out = [[int(spots[p]) << 32 | int(p) << 1 | 1] for p in own]
        at = np.searchsorted(first, values)
        for i in np.flatnonzero((at < len(first)) & (first[np.minimum(at, len(first) - 1)] == values)) if len(first) else ():
            p = int(before[at[i]])
            out[i].append(int(spots[p]) << 32 | p << 1)
        return pd.Series(out)

    dealt = rows.select("doc", "text", F.xxhash64("text").alias("tie"), F.explode(targets(F.coalesce("doc", none))).alias("to"))
    low = F.col("to").bitwiseAND(F.lit(2**32 - 1))
    dealt = dealt.select("doc", "text", "tie", F.shiftright("to", 32).cast("int").alias("at"), F.shiftright(low, 1).cast("int").alias("part"), (low.bitwiseAND(F.lit(1)) == 1).alias("own"))
    # what follows a part stands after its own rows, also where the last part is followed by the first
    return dealt.repartition(max(1, parts), "at").sortWithinPartitions("part", F.desc("own"), F.asc_nulls_first("doc"), "tie")


def _spots(spark: SparkSession, parts: int) -> np.ndarray:
    """A number for each part whose hash falls to a partition of its own, so that no two parts meet."""
    tried = spark.range(40 * parts).select(F.col("id").cast("int").alias("k"))
    found = {r["p"]: r["k"] for r in tried.groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("p")).agg(F.min("k").alias("k")).collect()}
    return np.array([found.get(p, p) for p in range(parts)], np.int64)


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter of code points replaced by the start of ``after``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def with_next(docs: DataFrame, parts: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited, near_next."""
    batch_rows(docs.sparkSession)
    names = [doc_id, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # part, doc, text, sketch of the row that waits for the one after it
        closed = None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("part", "own", "doc", "text")]
            pairs, texts = [], cols[3]
            own = sketches(texts)
            for part, is_own, doc, text_, sketch in zip(*cols, own, strict=True):
                if last is not None and last[0] == part and closed != part:
                    pairs.append((last, (text_, sketch)))
                if is_own:
                    last = (part, doc, text_, sketch)
                else:
                    closed, last = part, None
            new = [edited(a[2], b[0]) for a, b in pairs]
            new_sketch = sketches(new)
            rows = [
                (a[1], len(a[2]), e, to_text(a[3]), to_text(s), likeness(a[3], s), likeness(a[3], b[1]))
                for (a, b), e, s in zip(pairs, new, new_sketch, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    schema = f"`{doc_id}` long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return followed(docs, parts, doc_id, text).select("part", "own", "doc", "text").mapInArrow(run, schema)
