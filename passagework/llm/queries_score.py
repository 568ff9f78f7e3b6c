"""Queries of the classifiers (5 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import quality, toxicity
from passagework.llm.common import table
from passagework.llm.labelled import fold

THRESHOLD = 0.3


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score``; rows of fold 0 of 5 are never learnt from, fold 1 calibrates."""
    part = fold(F.col("doc_id"), 5)
    return quality.score(docs, quality.fit(docs, labels, part != 0, part == 1))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score``; rows of fold 2 of 4 are never learnt from, fold 1 calibrates."""
    part = fold(F.col("doc_id"), 4)
    return toxicity.score(docs, toxicity.fit(docs, labels, part != 2, part == 1))


def _result(scored: DataFrame, folds: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; fold 0 of 5 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _result(quality_scores(docs, table(spark, sf_dir, "labels")).drop("text"), 5, 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; fold 2 of 4 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _result(toxicity_scores(docs, table(spark, sf_dir, "labels")).drop("text"), 4, 2)
