"""Fill-in-the-middle by ropes.

A document is a rope: a balanced binary tree whose leaves are pieces of text and whose nodes cache
how many units and code points stand below them.  A unit is whatever ``cut`` makes of a text (lines
here).  Prefix, middle and suffix come from splitting the tree at two unit ranks; the output is the
concatenation of the three subtrees, in their new order, with a leaf for each sentinel.  The inverse
builds a rope over the output, finds the sentinels, splits at their code points and concatenates in
the old order.  Splitting and concatenating share subtrees; no text is copied but in the two leaves
that a split goes through.

Forms: ``psm`` is prefix, suffix, middle, each after its sentinel; ``spm`` is suffix, prefix, middle.
Empty texts, and texts that contain a sentinel, stay ``plain``: their output is the text itself.
Null texts count as empty.  The draws hang on the id and the seed alone, so repeated rows come out
alike and partitioning doesn't matter; a null id draws as an empty one.  Further columns are passed
through, except those of the names that are made here, which are replaced.  Texts of any length are whole:
a unit longer than a leaf is a leaf of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points that a leaf is filled up to.
LEAF = 512
#: Marks before the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LINES = re.compile(r"[^\n]*\n|[^\n]+")

#: Splits a text into its units, whole and in order.
Cut = Callable[[str], list[str]]


def lines(text: str) -> list[str]:
    """Lines with their ends; what follows the last end is one more."""
    return _LINES.findall(text)


@dataclass(frozen=True, slots=True)
class Leaf:
    units: tuple[str, ...]
    n_units: int
    n_chars: int


@dataclass(frozen=True, slots=True)
class Node:
    left: Leaf | Node
    right: Leaf | Node
    n_units: int
    n_chars: int


Rope = Leaf | Node | None  # None is the empty rope


def leaf(units: tuple[str, ...]) -> Leaf:
    return Leaf(units, len(units), sum(map(len, units)))


def concat(a: Rope, b: Rope) -> Rope:
    if a is None or b is None:
        return a if b is None else b
    return Node(a, b, a.n_units + b.n_units, a.n_chars + b.n_chars)


def build(units: list[str], fill: int = LEAF) -> Rope:
    """A balanced rope over ``units``; neighbours share a leaf up to ``fill`` code points."""
    leaves: list[Leaf] = []
    held: list[str] = []
    size = 0
    for u in units:
        if held and size + len(u) > fill:
            leaves.append(leaf(tuple(held)))
            held, size = [], 0
        held.append(u)
        size += len(u)
    if held:
        leaves.append(leaf(tuple(held)))

    def tree(lo: int, hi: int) -> Rope:
        if hi - lo < 2:
            return leaves[lo] if lo < hi else None
        mid = (lo + hi) // 2
        return concat(tree(lo, mid), tree(mid, hi))

    return tree(0, len(leaves))


def split(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the rest."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= rope.n_units:
        return rope, None
    if isinstance(rope, Leaf):
        return leaf(rope.units[:rank]), leaf(rope.units[rank:])
    if rank <= rope.left.n_units:
        a, b = split(rope.left, rank)
        return a, concat(b, rope.right)
    a, b = split(rope.right, rank - rope.left.n_units)
    return concat(rope.left, a), b


def split_chars(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` code points, and the rest; a unit that is cut through is one on either side."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= rope.n_chars:
        return rope, None
    if isinstance(rope, Leaf):
        before: list[str] = []
        for i, u in enumerate(rope.units):
            if rank < len(u):
                after = (u[rank:], *rope.units[i + 1 :])
                return leaf((*before, u[:rank])) if rank or before else None, leaf(after)
            before.append(u)
            rank -= len(u)
        raise AssertionError("the counts of a leaf are wrong")
    if rank <= rope.left.n_chars:
        a, b = split_chars(rope.left, rank)
        return a, concat(b, rope.right)
    a, b = split_chars(rope.right, rank - rope.left.n_chars)
    return concat(rope.left, a), b


def pieces(rope: Rope) -> Iterator[str]:
    """The units in order."""
    stack = [rope] if rope is not None else []
    while stack:
        top = stack.pop()
        if isinstance(top, Leaf):
            yield from top.units
        else:
            stack += (top.right, top.left)


def flat(rope: Rope) -> str:
    return "".join(pieces(rope))


def mark(sentinel: str) -> Leaf:
    return leaf((sentinel,))


def rearranged(prefix: Rope, middle: Rope, suffix: Rope, form: str) -> Rope:
    if form == "psm":
        order = (mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)
    else:
        order = (mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)
    out: Rope = None
    for part in order:
        out = concat(out, part)
    return out


def restored(output: str, form: str, cut: Cut = lines) -> Rope:
    """The document of an output: its rope is split at the sentinels, and the parts go back in order.

    Texts with sentinels of their own stay plain, and no sentinel can arise across the border of a
    part (they share no character with each other's ends), so the first find is the right one.
    """
    rope = build(cut(output))
    if form == "plain":
        return rope
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first)), output.index(MIDDLE, len(first))
    parts, middle = split_chars(rope, at[1])
    one, two = split_chars(parts, at[0])
    one, two, middle = split_chars(one, len(first))[1], split_chars(two, len(second))[1], split_chars(middle, len(MIDDLE))[1]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return concat(concat(prefix, middle), suffix)


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, doc_id: str = "doc_id", text: str = "text", cut: Cut = lines) -> DataFrame:
    """``docs`` with n (units), form, output, prefix_chars and middle_chars (null where plain).

    Of a hundred documents ``rate`` are rearranged, ``spm`` of a hundred of those with the suffix first.
    """
    draws = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(draws, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    made = {"n": T.LongType(), "form": T.StringType(), "output": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType()}
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(*kept, F.array(*drawn).alias("_draws"))
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, t) for n, t in made.items())])

    def one(body: str, h: list[int]) -> tuple[int, str, str, int | None, int | None]:
        units = cut(body)
        n = len(units)
        if not body or any(s in body for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
            return n, "plain", body, None, None
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        head, suffix = split(build(units), high)
        prefix, middle = split(head, low)
        form = "spm" if h[3] % 100 < spm else "psm"
        return n, form, flat(rearranged(prefix, middle, suffix, form)), prefix.n_chars if prefix else 0, middle.n_chars if middle else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, draws = batch.column(text), batch.column("_draws").to_pylist()
            for at in range(0, batch.num_rows, 64):  # outputs of a few rows are held at a time
                found = [one(texts[i].as_py() or "", draws[i]) for i in range(at, min(at + 64, batch.num_rows))]
                arrays = [pa.array([x[k] for x in found], pa.string() if n in ("form", "output") else pa.int64()) for k, n in enumerate(made)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, 64) for c in kept), *arrays], [*kept, *made])

    return rows.mapInArrow(run, schema)


def restore(done: DataFrame, output: str = "output", form: str = "form", out: str = "restored", cut: Cut = lines) -> DataFrame:
    """``done`` with ``out``, the text that each output was made of."""
    kept = [c for c in done.columns if c != out]
    schema = T.StructType([*(done.schema[c] for c in kept), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = batch.column(output), batch.column(form)
            for at in range(0, batch.num_rows, 64):
                found = [flat(restored(outputs[i].as_py(), forms[i].as_py(), cut)) for i in range(at, min(at + 64, batch.num_rows))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, 64) for c in kept), pa.array(found, pa.string())], [*kept, out])

    return done.select(*kept).mapInArrow(run, schema)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)
