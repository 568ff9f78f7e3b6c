"""A bounded sample of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its identifier as text, by ``folds``; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``rows`` labelled documents, those of the identifiers of the smallest hash.

    ``allowed`` says which identifiers may be learnt from.  A label that is given more than once
    counts as its largest value; null labels and ids don't count.  An identifier that documents
    repeat is one row, with the text of the smallest hash.  Only ids and labels of the sample,
    bounded by ``rows``, are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & allowed).groupBy(doc_id).agg(F.max(label).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64(doc_id), doc_id).limit(rows)
    held = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), doc_id)
    once = held.groupBy(doc_id).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r"))
    return once.select(doc_id, "r.text", "r.label")
