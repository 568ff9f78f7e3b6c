"""Merging, first-wins and last-wins deduplication, grouped concatenation, duplicate reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import text as X


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows of equal ``keys`` the first by ``order``.

    An aggregate, not a window: candidates are combined before the shuffle, so a key that many rows
    share moves one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_of_text(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Of rows of equal ``text`` the first by ``order``.  Texts may be long, so what is shuffled and
    compared as the key is a 128-bit hash; the text goes along as a value."""
    return first_wins(df.withColumn("_text", F.md5(F.coalesce(text, F.lit("")))), ["_text"], order).drop("_text")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def union_ranked(*parts: DataFrame) -> DataFrame:
    """All rows with ``src_rank``, the place of their table; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("src_rank", F.lit(i)) for i, p in enumerate(parts)])


def merge_corpora(*parts: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Union of the tables in order; the first row of an id wins."""
    return first_wins(union_ranked(*parts).where(F.col(key).isNotNull()), [key], ["src_rank", order]).drop("src_rank", order)


def concat_groups(df: DataFrame, keys: list[str], order: str, text: str, between: str = "\n") -> DataFrame:
    """Stripped texts of a group in order, joined; a text that the ones before contain is skipped."""
    return df.groupBy(*keys).agg(_gathered(order, text).alias("_t")).select(*keys, _joined("_t", between).alias(text))


def _gathered(order: str, text: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: X.py_strip(F.coalesce(x[text], F.lit(""))))


def _joined(texts: str, between: str = "\n") -> Column:
    return F.aggregate(texts, F.lit(""), lambda acc, x: F.when((x == "") | F.contains(acc, x), acc).when(acc == "", x).otherwise(F.concat(acc, F.lit(between), x)))


def article_id(ident: Column, parent: Column) -> Column:
    """The article that a passage belongs to: its parent, else its id without the last part; an id
    without parts is its own."""
    cut = F.regexp_replace(ident, "_[^_]*$", "")
    return F.when(F.contains(ident, F.lit("_")), F.coalesce(F.nullif(parent, F.lit("")), cut)).otherwise(ident)


def article_passages(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Passages merged by article; the first one's id and fields stand for it.

    ``keys``: the label alone merges equal labels of different laws; add law_id to keep them apart.
    """
    rows = df.where(F.coalesce("article", F.lit("")) != "").withColumn("_a", article_id(F.col("id"), F.col("parent_id")))
    first = F.min(F.struct(order, "_a", "law_name", "effective_date")).alias("_f")
    merged = rows.groupBy(*keys).agg(_gathered(order, "text").alias("_t"), first)  # texts are shuffled once
    return merged.select(*keys, F.col("_f._a").alias("id"), F.col("_f.law_name").alias("law_name"), F.col("_f.effective_date").alias("effective_date"), _joined("_t").alias("text"))


def text_hash(text: Column) -> Column:
    return F.md5(X.collapse_ws(F.coalesce(text, F.lit(""))))


def duplicate_groups(df: DataFrame, key: str, text: str = "text", top: int | None = None, ids: int = 1000) -> DataFrame:
    """Groups of more than one equal text: hash, size, least key, keys in order, a sample of the text.

    Sizes come from an aggregate that is combined before the shuffle.  With ``top`` only the largest
    groups are listed and their keys gathered, ``ids`` of each at most; without it the keys are left
    out, for ``duplicate_members`` to give as rows.
    """
    named = _bodies(df, key, text)
    sizes = named.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.min("sample").alias("sample")).where("n > 1")
    if not top:
        return sizes
    listed = sizes.orderBy(F.desc("n"), "first_key").limit(top)
    members = named.join(F.broadcast(listed.select("hash")), "hash", "left_semi").select("hash", "key")  # ``top`` rows
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy("hash").orderBy("key"))).where(F.col("_r") <= ids)
    keys = first.groupBy("hash").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return listed.join(keys, "hash").select("hash", "n", "first_key", "keys", "sample").orderBy(F.desc("n"), "first_key")


def duplicate_members(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """hash and key of every row whose text occurs more than once."""
    named = _bodies(df, key, text)
    return named.select("hash", "key").join(duplicate_groups(df, key, text).select("hash"), "hash", "left_semi")


def _bodies(df: DataFrame, key: str, text: str) -> DataFrame:
    body = X.collapse_ws(F.coalesce(text, F.lit("")))
    return df.select(F.col(key).alias("key"), body.alias("body")).where("body <> ''").select("key", F.md5("body").alias("hash"), X.ellipsis(F.col("body"), 200).alias("sample"))


def duplicate_summary(df: DataFrame, text: str = "text", min_len: int = 10) -> DataFrame:
    """Total, distinct, duplicate, empty and short texts, number, largest and mean size of the groups of equal
    ones, and the duplicates' share of all rows."""
    named = df.select(X.collapse_ws(F.coalesce(text, F.lit(""))).alias("body"))
    by_text = named.groupBy(F.md5("body").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("body")).alias("len"))
    full = F.col("len") > 0
    counts = by_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.when(full, 1)).alias("distinct_texts"),
        F.coalesce(F.sum(F.when(full, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(~full, F.col("n"))), F.lit(0)).alias("empty"),
        F.coalesce(F.sum(F.when(full & (F.col("len") < min_len), F.col("n"))), F.lit(0)).alias("short"),
        F.coalesce(F.max(F.when(full & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("largest"),
        F.count(F.when(full & (F.col("n") > 1), 1)).alias("groups"),
        F.coalesce(F.round(F.avg(F.when(full & (F.col("n") > 1), F.col("n"))), 6), F.lit(0.0)).alias("mean_size"),
    )
    return counts.withColumn("dup_ratio", F.when(F.col("total") > 0, F.round(F.col("duplicates") / F.col("total"), 6)).otherwise(0.0))


def fold_segments(lines: DataFrame, keys: list[str], order: str, line: str, is_header: Column) -> DataFrame:
    """Lines belong to the latest header line before them; those before the first header are dropped.

    Gives keys, segment number from 1, header and body (lines after the header, joined by line ends).
    Works on each key's gathered lines, so a document's lines must fit in memory, as they did as text.
    """
    rows = lines.withColumn("_h", F.coalesce(is_header, F.lit(False)).cast("int"))
    gathered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, line, "_h"))).alias("_l"))
    heads = F.filter(F.transform("_l", lambda x, i: F.when(x["_h"] == 1, i)), lambda i: i.isNotNull())
    marked = gathered.withColumn("_at", heads).select(*keys, "_l", "_at", F.posexplode("_at").alias("_s", "_from"))
    until = F.coalesce(F.get("_at", F.col("_s") + 1), F.size("_l"))
    body = F.transform(F.slice("_l", F.col("_from") + 2, until - F.col("_from") - 1), lambda x: x[line])
    return marked.select(*keys, (F.col("_s") + 1).cast("long").alias("segment"), F.get("_l", F.col("_from"))[line].alias("header"), F.array_join(body, "\n").alias("body"))
