"""Benchmark decontamination: a prefix-filtered set join, verified by exact containment.

An item's windows are its runs of ``window`` consecutive words (a shorter item is one window).  A
window is held to be a set of positioned shingles; for exact containment the necessary prefix of a
window is its one rarest shingle, rarity being counted over all documents.  Documents are exploded
into shingles and joined with the prefixes; length and position bounds follow at once (the window
must lie within the document), then the words themselves are compared.  All of it is one codegen
stage: the exploded rows are never written, only true occurrences leave it.

Shingles are of two words; only where an item is a single word those of one word are made as well.
The prefixes are broadcast only up to ``max_broadcast`` windows and MAX_BYTES.  A larger benchmark is
joined in blocks within these bounds, each against all documents.

Null and empty texts have no words and no hits.  A row is known by its identifier and text: rows
that repeat both come back as often as they came.  Null identifiers are kept, further columns are
dropped, an empty benchmark or document table gives zero hits or no rows.  An item without an
identifier hits words but is no item of the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import ascii_lower, discard, materialise, text_print

#: Everything that isn't part of a word, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands after the last word of a document, so that each document has one row of its own in the join.
END = "\x01"
END_KEY = -1
SHINGLE = 2
MAX_BROADCAST, MAX_BYTES = 100_000, 64_000_000


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(lowered, GAP), "")


def shingle_key(array: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(array, at + i) for i in range(size)])


def windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct windows with the items they come from."""
    found = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    cut = found.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))).alias("at"))
    return cut.select("item", F.slice("w", F.col("at"), window).alias("grams")).groupBy("grams").agg(F.collect_set("item").alias("items"))


def shingles(docs: DataFrame, sizes: list[int], ends: bool = True) -> DataFrame:
    """A row for each place and size of shingle, and with ``ends`` one more a document; ``ws`` and ``n``
    ride along within the stage."""
    held = docs.select("*", F.size("ws").alias("n"), (F.array_append("ws", END) if ends else F.col("ws")).alias("plus"))
    rows = held.select("*", F.posexplode("plus").alias("pos", "word"))
    keys = [shingle_key(F.col("plus"), F.col("pos"), size) for size in sizes]
    if ends:
        last = F.col("pos") == F.col("n")
        keys = [F.when(last, F.lit(END_KEY).cast("long")).otherwise(keys[0]), *[F.when(~last, k) for k in keys[1:]]]
    return rows.withColumn("key", keys[0] if len(keys) == 1 else F.explode(F.array(*keys))).where("key is not null")


def prefixes(wins: DataFrame, docs: DataFrame, sizes: list[int], max_broadcast: int) -> DataFrame:
    """Each window's rarest shingle and its place, by occurrences in all documents."""
    both = []
    for size in sizes:
        own = F.size("grams") >= SHINGLE if size == SHINGLE else F.size("grams") < SHINGLE
        each = wins.where(own).select("grams", F.explode(F.sequence(F.lit(0), F.size("grams") - size)).alias("offset"))
        both.append(each.select("grams", "offset", shingle_key(F.col("grams"), F.col("offset"), size).alias("key")))
    each = reduce(DataFrame.unionAll, both)
    wanted = each.select("key").distinct()
    small = wanted.count() <= max_broadcast
    seen = shingles(docs, sizes, ends=False).select("key")
    counts = seen.join(F.broadcast(wanted) if small else wanted, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    rare = each.join(counts, "key", "left").groupBy("grams").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "offset", "key")).alias("prefix")
    )
    return wins.join(rare, "grams").select("prefix.key", "prefix.offset", "grams", "items")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = 10, max_broadcast: int = MAX_BROADCAST, prints: bool = False) -> DataFrame:
    """Per document: words, words inside an occurring window, and the items whose windows occur;
    with ``prints`` the hash of its text."""
    spark = docs.sparkSession
    held = docs.select(F.col(doc_id).alias("doc"), text_print(F.col(text)).alias("print"), words(F.col(text)).alias("ws"))
    wins = materialise(windows(items, item_id, text, window), "windows")
    bytes_ = F.octet_length(F.array_join("grams", " ")) + 16 * F.size("grams") + F.octet_length(F.array_join("items", " ")) + 16 * F.size("items") + 64
    shape = wins.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("grams")).alias("least"), F.sum(bytes_).alias("bytes")).first()
    sizes = [SHINGLE, 1] if (shape["least"] or SHINGLE) < SHINGLE else [SHINGLE]
    table = materialise(prefixes(wins, held, sizes, max_broadcast), "prefixes")
    discard(wins)
    blocks = max(1, -(-shape["n"] // max_broadcast), -(-(shape["bytes"] or 0) // MAX_BYTES))
    own = spark.range(1).select(
        F.lit(END_KEY).cast("long").alias("key"), F.lit(0).alias("offset"), F.array().cast("array<string>").alias("grams"), F.array().cast("array<string>").alias("items")
    )

    def occurrences(block: int) -> DataFrame:
        part = table if blocks == 1 else table.where(F.pmod(F.xxhash64("grams", F.lit(7)), F.lit(blocks)) == block)
        part = part.unionByName(own) if block == 0 else part
        met = shingles(held, sizes).join(F.broadcast(part), "key")
        start = F.col("pos") - F.col("offset")
        met = met.where((start >= 0) & (start + F.size("grams") <= F.col("n")) & (F.slice("ws", start + 1, F.size("grams")) == F.col("grams")))
        return met.select("doc", "print", (F.col("key") == END_KEY).alias("own"), "n", F.struct(start.alias("start"), F.size("grams").alias("len")).alias("hit"), "items")

    met = reduce(DataFrame.unionAll, [occurrences(b) for b in range(blocks)])
    by_doc = met.groupBy("doc", "print").agg(
        F.max("n").alias("n"),
        F.sum(F.col("own").cast("int")).alias("copies"),
        F.collect_set(F.when(~F.col("own"), F.col("hit"))).alias("hits"),
        F.collect_set(F.when(~F.col("own"), F.col("items"))).alias("items"),
    )
    covered = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))
    found = by_doc.select(
        "doc", "print", "copies", F.col("n").cast("long").alias("n_words"), F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("items")
    )
    out = found.select(F.col("doc").alias(doc_id), "n_words", "n_hit", "items", *(["print"] if prints else []), "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
