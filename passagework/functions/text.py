"""Text expressions with the white-space semantics of Python strings.

Java's ``\\s`` and ``trim`` know fewer characters than ``str.split`` and ``str.strip``, so the class
is spelt out.  Everything here is a Column expression except ``nfkc``, for which Spark has no
built-in: that is an Arrow UDF, to which texts without any character that may change go as null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of Python strings (fixed by Unicode), as a class and as a list.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: Where the characters of common scripts stand (fixed by Unicode): Latin to Cyrillic, marks, kana, Han and Hangul.
SCRIPTS = ((0, 0x530), (0x2010, 0x2060), (0x20A0, 0x20C1), (0x3001, 0x3100), (0x3400, 0xD800))


@cache
def _staying() -> tuple[tuple[int, int], ...]:
    """Runs (first, last) of the characters in ``SCRIPTS`` that NFKC leaves alone, by themselves and after another."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x20000))
    second = {int(p[1], 16) for p in pairs if len(p) == 2 and not p[0].startswith("<")} | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    runs: list[tuple[int, int]] = []
    for first, end in SCRIPTS:
        begin = first
        for c in range(first, end + 1):
            if c == end or c in second or unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFKC", chr(c)):
                if c - begin >= (1 if c < 0x100 else 4):
                    runs.append((begin, c - 1))
                begin = c + 1
    return tuple(runs)


def _class(runs: Iterable[tuple[int, int]]) -> str:
    return "".join(rf"\x{{{first:x}}}-\x{{{last:x}}}" for first, last in runs)


def changing() -> str:
    """A class that holds every character that NFKC may change, alone or after another: all but the
    runs of those in ``SCRIPTS`` that stay."""
    return f"[^{_class(_staying())}]"


@cache
def unchanged() -> str:
    """A pattern of whole texts without any of ``changing``.  Java tries the ranges of a class one after
    the other for each character, so runs of the commonest (one range each) come first; nothing is
    tried twice, and the loop doesn't recurse."""
    held = {c: next(r for r in _staying() if r[0] <= c <= r[1]) for c in (0x41, 0xE9, 0xAC00, 0x4E00, 0x2019)}
    common = list(dict.fromkeys(held.values()))
    rest = [r for r in _staying() if r not in common]
    return rf"\A(?:{'|'.join(f'[{_class([r])}]++' for r in common)}|[{_class(rest)}]++)*+\z"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _nfkc_groups(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else [[None if t is None else unicodedata.normalize("NFKC", t) for t in group] for group in x])


def nfkc_stays(c: Column) -> Column:
    """True only where NFKC leaves the text as it is."""
    return (F.octet_length(c) == F.char_length(c)) | c.rlike(unchanged())


def nfkc(c: Column) -> Column:
    """Compatibility composition (NFKC)."""
    return F.coalesce(_nfkc(F.when(~nfkc_stays(c), c)), c)


def normalize_groups(c: Column) -> Column:
    """``normalize_whitespace`` of every text of an array of arrays of texts; ``c`` is a plain column.

    Functions of Python can't stand in a transform; all texts of a row go there at once, if any must."""
    plain = F.forall(c, lambda group: F.forall(group, lambda x: F.coalesce(nfkc_stays(x), F.lit(True))))
    composed = F.coalesce(_nfkc_groups(F.when(~plain, c)), c)
    return F.transform(composed, lambda group: F.transform(group, lambda x: collapse_ws(F.coalesce(x, F.lit("")))))


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one blank; the ends are stripped."""
    # printable ASCII is told apart first: Java tries the ranges of a class one after the other
    return F.trim(F.regexp_replace(c, rf"[[\x00-\x20\x7f-\u3000]&&{WS}]+", " "))  # no other white space is left at the ends


def normalize_whitespace(c: Column, compose: bool = True) -> Column:
    """Null as '', NFKC (unless ``compose`` is off), collapsed and stripped."""
    c = F.coalesce(c, F.lit(""))
    return collapse_ws(nfkc(c) if compose else c)


def normalize_text(c: Column, lower: bool = False) -> Column:
    """NFKC, zero-width spaces dropped, collapsed; optionally lower-cased."""
    c = collapse_ws(F.replace(nfkc(F.coalesce(c, F.lit(""))), F.lit("\u200b"), F.lit("")))
    return F.lower(c) if lower else c


def one_line(c: Column, n: int = 120) -> Column:
    return F.substring(collapse_ws(c), 1, n)


def short(c: Column, n: int) -> Column:
    return F.substring(py_strip(c), 1, n)


def ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def clean_html(c: Column) -> Column:
    """Line-break tags become blanks, other tags vanish, white space is collapsed."""
    return collapse_ws(strip_tags(c))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), r"<[^>]+>", "")


def first_section(c: Column, n: int = 200) -> Column:
    """The text after the first [number] mark, cut at ``n``; without a mark the first ``n``."""
    parts = F.split(c, r"\[\d+\]")
    return F.when(F.size(parts) > 1, ellipsis(py_strip(F.get(parts, F.lit(1))), n)).otherwise(F.substring(py_strip(c), 1, n))


def normalize_law_name(c: Column) -> Column:
    """Collapsed, without parentheses and their content (removed last, so a blank may be doubled)."""
    return py_strip(F.regexp_replace(collapse_ws(c), r"\([^)]*\)", ""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def count_tokens(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit("")))).cast("long")


def length_bucket(n: Column) -> Column:
    return F.when(n < 10, "very_short").when(n < 20, "short").when(n < 50, "medium").when(n < 100, "long").otherwise("very_long")


def join_lines(lines: Column) -> Column:
    """Lines without their ends, empty ones dropped, joined; blanks within are kept (tables)."""
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^[\r\n]+|[\r\n]+\z", ""))
    return py_strip(F.array_join(F.filter(bare, lambda x: x != ""), "\n"))


def alias(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def zfill(c: Column, n: int) -> Column:
    """Zeros to the left up to ``n``; longer ones are kept whole."""
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def windows(c: Column, size: int, overlap: int) -> Column:
    """Character windows of ``size`` that share ``overlap`` characters; none of an empty text."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap
    n = F.length(c)
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1)
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(c, k * step + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def metric_key(c: Column) -> Column:
    """Prefixes of the evaluator dropped, ``@`` spelt out."""
    return F.replace(F.regexp_replace(F.regexp_replace(c, "^val_", ""), "^cosine_", ""), F.lit("@"), F.lit("_at_"))
