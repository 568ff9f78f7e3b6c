"""Evaluation of encoders over a corpus and its pairs: searches, detailed reports, comparisons, chunk units."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.cluster import cut
from passagework.functions import text as X
from passagework.functions.stats import summary
from passagework.operators import encode, metrics, models, reports, vectors

#: Metrics that reports list.
METRICS = ("accuracy", "precision", "recall", "mrr", "ndcg_full", "ndcg_first", "map_lib", "map_all")


@dataclass
class Search:
    """What one encoder finds: ranked (query_id, doc_id, rank, hit) and the queries that count
    (query_id, query_text, positive_passages, source, tokens, n_rel)."""

    ranked: DataFrame
    queries: DataFrame
    ks: list[int]

    def per_query(self, ks: list[int] | None = None) -> DataFrame:
        return metrics.per_query(self.ranked, self.queries.select("query_id", "n_rel"), ks or self.ks)

    def means(self) -> DataFrame:
        """k, queries and the mean of each metric."""
        return self.per_query().groupBy("k").agg(F.count(F.lit(1)).alias("queries"), *[F.avg(n).alias(n) for n in METRICS]).orderBy("k")

    def by_source(self) -> DataFrame:
        """source, queries and means, pooled over k."""
        return self._pooled("source")

    def by_length(self) -> DataFrame:
        """bucket of the query's words, queries and means, pooled over k."""
        return self._pooled("bucket")

    def _pooled(self, by: str) -> DataFrame:
        named = self.queries.select("query_id", "source", X.length_bucket(F.col("tokens")).alias("bucket"))
        rows = self.per_query().join(named.select("query_id", by), "query_id")
        return rows.groupBy(by).agg(F.countDistinct("query_id").alias("queries"), *[F.avg(n).alias(n) for n in ("mrr", "ndcg_first", "recall")]).orderBy(by)

    def failed(self) -> DataFrame:
        """Queries without any hit in the first max(k): their first 5 positives and what was found instead."""
        k = max(self.ks)
        missed = self.per_query([k]).where(F.col("first").isNull()).select("query_id")
        top = self.ranked.where(F.col("rank") <= 5).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("retrieved"))
        rows = self.queries.join(missed, "query_id", "left_semi").join(top, "query_id", "left")
        return rows.select("query_id", X.ellipsis(F.col("query_text"), 200).alias("query_text"), F.slice("positive_passages", 1, 5).alias("positive_passages"), "source", "retrieved")

    def distribution(self) -> DataFrame:
        """metric and the statistics of its values at max(k) over queries."""
        rows = cut(self.per_query([max(self.ks)]).select("mrr", "recall"))
        return reduce(DataFrame.unionAll, [summary(rows.select(F.col(m).alias("v")), [], "v").withColumn("metric", F.lit(m)) for m in ("mrr", "recall")])


def search(encoder: encode.Encoder | models.Model, passages: DataFrame, pairs: DataFrame, ks: list[int], mode: encode.TemplateMode = encode.TemplateMode.BGE) -> Search:
    """``passages``: id, text, one row an id; ``pairs``: query_id, query_text, positive_passages,
    meta.type.  Pairs without positives don't count.  A bare encoder takes texts whole."""
    asked = pairs.where(F.size("positive_passages") > 0)
    held = passages.select(F.col("id").alias("doc_id"), "text")
    if isinstance(encoder, models.Model):
        c, q = encoder.encode_passages(held, F.col("text")), encoder.encode_queries(asked.select("query_id", "query_text"), F.col("query_text"))
    else:
        c, q = encode.encode_passages(held, F.col("text"), encoder, mode=mode), encode.encode_queries(asked.select("query_id", "query_text"), F.col("query_text"), encoder, mode=mode)
    found = vectors.top_k(q.select("query_id", "vector"), cut(c.select("doc_id", "vector")), max(ks))  # encoded once, counted and searched
    wanted = asked.select("query_id", F.explode(F.array_distinct("positive_passages")).alias("doc_id"), F.lit(True).alias("hit"))
    ranked = cut(found.join(wanted, ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))))  # every report reads it
    queries = asked.select(
        "query_id", "query_text", "positive_passages", reports.query_source(F.col("meta.type")).alias("source"),
        X.count_tokens(F.col("query_text")).alias("tokens"), F.size(F.array_distinct("positive_passages")).alias("n_rel"),
    )
    return Search(ranked, queries, ks)


def detailed_report(found: Search, title: str = "Evaluation") -> str:
    """All tables of a search as text; the first 10 failures."""
    rows = lambda df, n=None: [r.asDict() for r in (df.limit(n) if n else df).collect()]
    failed = found.failed()
    parts = [
        (title, rows(found.means())), ("By source", rows(found.by_source())), ("By length of the query", rows(found.by_length())),
        (f"Queries without a hit: {failed.count()}", rows(failed.orderBy("query_id"), 10)), ("Distribution over queries", rows(found.distribution())),
    ]
    return "\n".join(reports.markdown(r, t) for t, r in parts)


def compare(searches: dict[str, Search]) -> DataFrame:
    """model, k, queries, metrics, and whether the model's MRR is the best at that k."""
    rows = reduce(DataFrame.unionAll, [s.means().withColumn("model", F.lit(m)) for m, s in searches.items()])
    best = rows.groupBy("k").agg(F.max("mrr").alias("top"))
    return rows.join(best, "k").withColumn("best", F.col("mrr") == F.col("top")).drop("top").orderBy("k", F.desc("mrr"), "model")


def compare_sources(searches: dict[str, Search]) -> DataFrame:
    """source, model and means."""
    return reduce(DataFrame.unionAll, [s.by_source().withColumn("model", F.lit(m)) for m, s in searches.items()]).orderBy("source", "model")


def comparison_report(searches: dict[str, Search]) -> str:
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a few rows a model
    return "\n".join([reports.markdown(rows(compare(searches)), "Models"), reports.markdown(rows(compare_sources(searches)), "Models by source")])


def chunk_study(corpora: dict[str, DataFrame], pairs: dict[str, DataFrame], encoders: dict[str, encode.Encoder | models.Model], ks: list[int], base: str, info: DataFrame | None = None) -> DataFrame:
    """unit, model, k, metrics, words a passage and what k passages save against unit ``base``.

    ``corpora`` and ``pairs`` are by unit of chunking (their positives name that unit's ids);
    ``info`` (model, ...) is joined on where it knows a model.
    """
    found = [
        search(e, corpora[unit], pairs[unit], ks).means().select(F.lit(unit).alias("unit"), F.lit(model).alias("model"), "k", "queries", *METRICS)
        for unit in corpora for model, e in encoders.items()
    ]
    texts = reduce(DataFrame.unionAll, [c.select(F.lit(unit).alias("unit"), "text") for unit, c in corpora.items()])
    sizes = cut(reports.chunk_tokens(texts, "unit"))  # a row a unit
    saved = reports.token_saving(sizes, "unit", base, tuple(ks))
    out = reduce(DataFrame.unionAll, found).join(sizes.select("unit", "avg_tokens", "avg_chars"), "unit", "left").join(saved, ["unit", "k"], "left")
    return out.join(info, "model", "left") if info is not None else out


def similarity_rows(queries: DataFrame, corpus: DataFrame, wanted: DataFrame, most: int = 100) -> DataFrame:
    """kind (positive, negative) and score: of each query all positives (``wanted``: query_id, doc_id)
    and, from the first ``most`` found, as many others as it has positives."""
    v = corpus.select("doc_id", F.col("vector").alias("v"))
    positive = queries.join(wanted, "query_id").join(v, "doc_id").select("query_id", F.lit("positive").alias("kind"), vectors.dot(F.col("vector"), F.col("v")).alias("score"))
    counts = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    found = vectors.top_k(queries, corpus, most).join(wanted, ["query_id", "doc_id"], "left_anti")
    return positive.unionByName(balanced(found, counts).select("query_id", F.lit("negative").alias("kind"), "score"))


def balanced(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Of (query_id, rank, ...) as many rows of a query, in order of rank, as ``counts`` (query_id, m) says, one at least."""
    placed = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return placed.join(counts, "query_id", "left").where(F.col("_r") <= F.greatest(F.coalesce("m", F.lit(0)), F.lit(1))).drop("_r", "m")


def histogram(rows: DataFrame, value: str, bins: int = 50, *groups: str) -> DataFrame:
    """groups, bin (from 1), its lower bound and n: equal widths between the least and largest value."""
    ends = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))  # one row
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0) + 1
    placed = rows.where(F.col(value).isNotNull()).crossJoin(ends).withColumn("bin", at.cast("int"))
    return placed.groupBy(*groups, "bin").agg(F.min(F.col("lo") + (F.col("hi") - F.col("lo")) / bins * (F.col("bin") - 1)).alias("low"), F.count(F.lit(1)).alias("n"))
