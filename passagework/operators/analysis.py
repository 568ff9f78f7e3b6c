"""Reports on corpora and data sets of pairs: statistics by measure and type, failed citations, samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.cluster import cut
from passagework.functions import text as X
from passagework.functions.stats import summary
from passagework.operators import citations, corpus, reports, tokens
from passagework.operators.citations import cap


def count(text: Column, tokenizer: tokens.Tokenizer | None = None) -> Column:
    """Tokens of a text: words, or what ``tokenizer`` finds."""
    if tokenizer is None:
        return X.count_tokens(text)
    if isinstance(tokenizer, tokens.PieceTokenizer):
        return F.size(tokenizer.pieces(F.coalesce(text, F.lit("")))).cast("long")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.fillna("").map(lambda x: len(tokenizer.starts(x)))

    return F.pandas_udf(run, T.LongType())(text)


def _size(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.size(column)).otherwise(0).cast("long")


def _kind() -> Column:
    return F.coalesce("meta.type", F.lit("unknown"))


def pair_statistics(pairs: DataFrame, passages: DataFrame, tokenizer: tokens.Tokenizer | None = None) -> DataFrame:
    """measure, n, min, max, mean, median, stdev, p25, p75: of positives and negatives a pair, tokens of the
    queries, and tokens of the distinct positives that the corpus holds.  Empty texts don't count."""
    asked = F.when(F.col("query_text") != "", count(F.col("query_text"), tokenizer))
    own = cut(pairs.select(_size("positive_passages").alias("positives"), _size("hard_negatives").alias("negatives"), asked.alias("query_tokens"), "positive_passages"))  # pairs are built once
    sizes = own.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("positives", "negatives", "query_tokens")])))
    named = own.select(F.explode("positive_passages").alias("id")).distinct()
    # texts are counted where they lie, not shuffled
    held = named.join(passages.where(F.col("text") != "").select("id", count(F.col("text"), tokenizer).alias("v")), "id").select(F.lit("passage_tokens").alias("measure"), "v")
    return summary(cut(sizes.unionAll(held)), ["measure"], "v")


def type_summary(pairs: DataFrame) -> DataFrame:
    """type, pairs, share of all, positives and negatives, and their means a pair."""
    by = pairs.groupBy(_kind().alias("type")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(_size("positive_passages")).alias("positives"), F.sum(_size("hard_negatives")).alias("negatives"))
    total = by.agg(F.sum("pairs").alias("total"))  # one row against a row a type
    out = by.crossJoin(F.broadcast(total))
    return out.select("type", "pairs", (F.col("pairs") / F.col("total")).alias("share"), "positives", "negatives", (F.col("positives") / F.col("pairs")).alias("mean_positives"), (F.col("negatives") / F.col("pairs")).alias("mean_negatives"))


def sample_pairs(pairs: DataFrame, n: int = 5, key: str = "query_id") -> DataFrame:
    """The first ``n`` pairs by ``key``: text of 100 characters, sizes, type."""
    first = pairs.orderBy(key).limit(n)
    return first.select(key, X.ellipsis(F.coalesce("query_text", F.lit("")), 100).alias("query_text"), _size("positive_passages").alias("positives"), _size("hard_negatives").alias("negatives"), _kind().alias("type"))


def passage_statistics(passages: DataFrame, tokenizer: tokens.Tokenizer | None = None) -> DataFrame:
    """source ('all' for the whole corpus), measure (chars, tokens) and the statistics of its texts."""
    named = passages.select(reports.passage_source(F.col("id"), F.col("type")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    each = F.array(F.struct(F.lit("chars").alias("measure"), F.length("text").cast("long").alias("v")), F.struct(F.lit("tokens").alias("measure"), count(F.col("text"), tokenizer).alias("v")))
    rows = named.select("source", F.inline(each))
    both = rows.withColumn("source", F.explode(F.array(F.col("source"), F.lit("all"))))
    return summary(both, ["source", "measure"], "v")


def duplicate_report(passages: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Totals of equal texts, and the ``top`` largest groups."""
    return corpus.duplicate_summary(passages), corpus.duplicate_groups(passages, "id", top=top)


def failed_citations(precedents: DataFrame, statutes: DataFrame, rules: DataFrame, known: int = 5) -> DataFrame:
    """law_name, article_num, type, cases, reason and known: what precedents cite and the corpus lacks.

    ``reason`` is ``law`` (no such name) or ``article`` (no such article of it); ``known`` are the
    first articles that the law has.  Every name and article is one row.  Columns as of ``cited_passages``.
    """
    refs = precedents.select("case_id", F.explode(citations.citations(F.col("refs"))).alias("ref")).select("case_id", "ref.law_name", "ref.article_num", "ref.type")
    asked = refs.groupBy("law_name", "article_num", "type").agg(F.countDistinct("case_id").alias("cases"))
    laws = statutes.select(X.normalize_law_name(F.col("law_name")).alias("law_name"), citations.article_number(F.col("article")).alias("article_num"), F.lit("law").alias("type"))
    held = laws.unionByName(rules.select(X.py_strip(F.col("rule_name")).alias("law_name"), citations.article_number(F.col("article")).alias("article_num"), F.lit("admin").alias("type")))
    held = held.where("article_num is not null").distinct()
    keys = ["law_name", "type"]
    first = cap(held, keys, ["article_num"], known).groupBy(*keys).agg(F.sort_array(F.collect_list("article_num")).alias("known"))
    missing = asked.join(held, [*keys, "article_num"], "left_anti").join(first, keys, "left")
    reason = F.when(F.col("known").isNull(), "law").otherwise("article")
    return missing.select("law_name", "article_num", "type", "cases", reason.alias("reason"), F.coalesce("known", F.array().cast("array<string>")).alias("known"))


def outcome_counts(built: DataFrame) -> DataFrame:
    """outcome, cases, pairs and share of failures: cases that match nothing count as failed even where
    their own first chunk makes a pair."""
    failed = F.col("outcome") != "ok"
    by = built.groupBy("outcome").agg(F.count(F.lit(1)).alias("cases"), F.sum((F.size("positive_passages") > 0).cast("long")).alias("pairs"))
    total = by.agg(F.sum(F.when(failed, F.col("cases"))).alias("failed"))  # one row against a row an outcome
    share = F.when(failed, F.col("cases") / F.col("failed"))
    return by.crossJoin(F.broadcast(total)).select("outcome", "cases", "pairs", share.alias("share"))
