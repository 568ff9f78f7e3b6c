"""A corpus pipeline of five stages: quality, toxicity, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as Parquet and read again
as the next one's ``docs``.  All but the last return the columns of ``documents``; further columns,
also of names that the operators use, are dropped.

Null and empty texts are scored like others and go on if the classifiers let them; they have no words,
so they are nobody's copy and hold no benchmark window, and their tokens are none.  Rows that repeat an
identifier and text come once after the third stage; one identifier with different texts is judged by
text.  Rows without an identifier can't be named by copies and stay.  Very long texts are taken whole.
An empty table gives an empty one of the same columns.

Near-duplicates are found by five words here, the operators' default; four is the contract of the
operator's own query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import decontaminate, neardup, queries_score, queries_tokens
from passagework.llm.common import shared_path, table, text_print

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 and more)."""
    scored = queries_score.quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= queries_score.THRESHOLD).select(COLUMNS)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject (score below 0.3)."""
    scored = queries_score.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") < queries_score.THRESHOLD).select(COLUMNS)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text are those of ``dropped`` (doc_id, print)."""
    named = docs.withColumn("print", text_print(F.col("text")))
    return named.join(dropped.select("doc_id", "print").distinct(), ["doc_id", "print"], "left_anti").drop("print")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): that of the smallest id.

    Rows that repeat an id and text come once, rows with a null id or without words stay.
    """
    found = neardup.near_duplicates(docs, prints=True)
    dropped = found.where((F.col("doc_id") != F.col("component_id")) | (F.col("print") != F.col("component_print")))
    kept = without(docs, dropped)
    named = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    return named.unionByName(kept.where(F.col("doc_id").isNull())).select(COLUMNS)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), prints=True)
    return without(docs, found.where(F.col("n_hit") > 0)).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of the ids and of the decoded bytes."""
    return queries_tokens.bpe_round_trip(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_civil),
    ("near_dedup", keep_distinct),
    ("decontamination", cut_benchmarks),
    ("bpe", encode),
]

#: The classifiers are no SQL; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
