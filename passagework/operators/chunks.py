"""Chunking of long texts into passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import text as X


def chunk_rows(df: DataFrame, text: Column, size: int = 1200, overlap: int = 200, min_len: int = 0, distinct: bool = False, strip: bool = False) -> DataFrame:
    """One row a window: ``chunk_no`` from 1 and ``chunk``.

    ``strip`` strips each window and drops blank ones; ``min_len`` drops shorter ones (after
    stripping); ``distinct`` keeps the first of equal windows of a row.  Numbers are given last.
    """
    cut = X.windows(text, size, overlap)
    if strip:
        cut = F.filter(F.transform(cut, X.py_strip), lambda x: x != "")
    if min_len:
        cut = F.filter(cut, lambda x: F.length(X.py_strip(x)) >= min_len)
    if distinct:
        cut = F.array_distinct(cut)
    return df.select("*", F.posexplode(cut).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no") + 1)


def valid_passages(df: DataFrame, text: str = "text", min_len: int = 50) -> DataFrame:
    return df.where(F.length(X.py_strip(F.coalesce(text, F.lit("")))) >= min_len)


def live_clauses(df: DataFrame, text: str = "text", mark: str = "삭제", anchored: bool = False) -> DataFrame:
    """Rows whose text is not a repealed clause: empty ones, and those with ``mark`` anywhere (or,
    ``anchored``, only at the start, in parentheses or not)."""
    body = X.collapse_ws(F.coalesce(text, F.lit("")))
    gone = body.rlike(rf"^\(?{mark}\)?") if anchored else F.contains(body, F.lit(mark))
    return df.where((body != "") & ~gone)
