"""Units of chunking: the same corpus as paragraphs, items and articles, and what is relevant in each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators import corpus, encode, evaluation, models

UNITS = ("paragraph", "item", "article")


def corpora(statutes: DataFrame, items: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """id, type and text of the corpus of each unit; rules are the same in all (they come by article)."""
    order = F.struct("file", "rec_no", "a_pos", "p_pos", "i_pos")
    plain = lambda df: df.select("id", F.lit("법령").alias("type"), "text", order.alias("pos"))
    once = lambda df: corpus.first_wins(df, ["id"], ["pos"]).select("id", "type", "text")
    merged = corpus.article_passages(statutes.withColumn("pos", order), ["law_id", "article"], "pos").select("id", F.lit("법령").alias("type"), "text")
    rest = rules.select("id", "type", "text")
    return {"paragraph": once(plain(statutes)).unionByName(rest), "item": once(plain(items)).unionByName(rest), "article": merged.unionByName(rest)}


def hierarchy(statutes: DataFrame, items: DataFrame) -> DataFrame:
    """paragraph, unit and kind: the article of each paragraph, and its items (itself, if it has none)."""
    paragraphs = statutes.select(F.col("id").alias("paragraph")).distinct()
    articles = statutes.select(F.col("id").alias("paragraph"), corpus.article_id(F.col("id"), F.col("parent_id")).alias("unit"))
    own = items.select(F.col("id").alias("paragraph"), F.col("id").alias("unit"))
    below = items.select(F.col("parent_id").alias("paragraph"), F.col("id").alias("unit"))
    members = own.unionAll(below).join(paragraphs, "paragraph", "left_semi")
    return articles.withColumn("kind", F.lit("article")).unionAll(members.withColumn("kind", F.lit("item"))).distinct()


def remap(pairs: DataFrame, members: DataFrame, kind: str, query_id: str = "query_id", positives: str = "positive_passages") -> DataFrame:
    """``pairs`` with ``positives`` in ids of the unit ``kind``, in the old order, each once; passages
    without such units (rules, say) stay as they are, and null or empty lists are empty."""
    if kind == "paragraph":
        return pairs
    map_ = members.where(F.col("kind") == kind).select("paragraph", "unit")
    each = pairs.select(query_id, F.posexplode(positives).alias("_pos", "paragraph")).join(map_, "paragraph", "left")
    first = each.groupBy(query_id, F.coalesce("unit", "paragraph").alias("_u")).agg(F.min("_pos").alias("_pos"))
    lists = first.groupBy(query_id).agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_u"))), lambda x: x["_u"]).alias("_new"))
    found = F.coalesce("_new", F.array().cast("array<string>")).alias(positives)
    return pairs.join(lists, query_id, "left").select(*[found if c == positives else F.col(c) for c in pairs.columns])


def study(statutes: DataFrame, items: DataFrame, rules: DataFrame, pairs: DataFrame, encoders: dict[str, encode.Encoder | models.Model], ks: list[int], info: DataFrame | None = None) -> DataFrame:
    """The study of chunk units from one set of flattened passages: ``pairs`` name paragraphs.

    unit, model, k, queries, metrics, words and characters a passage, and what k passages save against
    paragraphs; ``info`` (model, ...) is joined where it knows a model.
    """
    held, members = corpora(statutes, items, rules), hierarchy(statutes, items)
    return evaluation.chunk_study(held, {u: remap(pairs, members, u) for u in UNITS}, encoders, ks, "paragraph", info)
