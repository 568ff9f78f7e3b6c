"""Query-passage pairs of court precedents: positives from their citations, negatives in tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.cluster import cut
from passagework.functions import text as X
from passagework.functions.order import digits_for
from passagework.operators import citations, legal
from passagework.operators.negatives import ring, tiered_candidates
from passagework.operators.pairs import query_precedent


def _take(found: DataFrame, n: int) -> DataFrame:
    """Of (pair, cand, tier, step) the first ``n`` candidates of each pair, as an array."""
    once = found.groupBy("pair", "cand").agg(F.min(F.struct("tier", "step")).alias("at"))
    kept = once.withColumn("r", F.row_number().over(Window.partitionBy("pair").orderBy("at", "cand"))).where(F.col("r") <= n)
    return kept.groupBy("pair").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "cand"))), lambda x: x["cand"]).alias("hard_negatives"))


def cited_negatives(cases: DataFrame, laws: DataFrame, n: int, most: int, seed: int = 42) -> DataFrame:
    """pair, hard_negatives.  Tier 1: other articles of the cited laws, in citation order (an article
    is barred where it is the only one of its law that the case cites); tier 2: passages of laws that
    aren't cited; tier 3: whatever else the cited laws hold.  Never a positive.

    Tier 2 goes round a ring of names, not of passages, so that what a case looks at depends on how
    many laws it cites and not on how long they are.  Where the tiers together don't hold ``n``,
    nothing else is left.  ``cases``: case_id, refs, positives (``most`` at most).  ``laws``: id,
    name, article_num.
    """
    article = F.concat_ws("#", "name", "article_num")
    pool = laws.select("id", F.when(F.col("article_num").isNotNull(), article).alias("parent_id"), "name")
    digits = digits_for(pool.count())
    refs = cases.select("case_id", F.posexplode(citations.citations(F.col("refs"))).alias("pos", "ref")).select("case_id", "pos", F.col("ref.law_name").alias("name"), "ref.article_num")
    only = F.when(F.min("article_num") == F.max("article_num"), F.concat_ws("#", "name", F.min("article_num")))
    cited = cut(refs.groupBy("case_id", "name").agg(F.min("pos").alias("pos"), only.alias("only")))  # every branch below reads it

    def named(asked: DataFrame, parent: Column) -> DataFrame:
        return asked.select(F.concat_ws("#", X.zfill(F.col("pos").cast("string"), 6), "case_id").alias("id"), parent.alias("parent_id"), "name")

    def in_order(found: DataFrame, tier: int) -> DataFrame:
        """(pair, cand, tier, step) of candidates found for ``named`` rows, in the order of their ``pos``."""
        return found.select(F.substring("pair", 8, 1000).alias("pair"), "cand", F.lit(tier).alias("tier"), (F.substring("pair", 1, 6).cast("int") * 1_000_000 + F.col("step")).alias("step"))

    none = F.lit(None).cast("string")
    first = in_order(tiered_candidates(named(cited, F.col("only")), pool, [["name"]], n + most, seed), 1)
    names = pool.select(F.col("name").alias("id"), none.alias("parent_id")).distinct()
    own = cited.groupBy("case_id").agg(F.count(F.lit(1)).alias("cites"))
    others = ring(own.select(F.col("case_id").alias("id"), none.alias("parent_id"), "cites"), names, [], F.col("cites") + n, 2, seed, "others", digits)
    others = others.select(F.col("pair").alias("case_id"), F.col("cand").alias("name"), F.col("step").alias("pos")).join(cited.select("case_id", "name"), ["case_id", "name"], "left_anti")
    second = in_order(ring(named(others, none), pool, ["name"], n, 2, seed, "any", digits), 2)
    third = in_order(ring(named(cited, none), pool, ["name"], n + most, 3, seed, "rest", digits), 3)
    barred = cases.select(F.col("case_id").alias("pair"), F.explode("positives").alias("cand"))
    return _take(first.unionByName(second).unionByName(third).join(barred, ["pair", "cand"], "left_anti"), n)


def fallback_negatives(cases: DataFrame, chunks: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """pair, hard_negatives: other chunks of the same precedent in order, then other precedents'.

    ``chunks``: id, case_id, chunk_no; the first chunk is the positive.
    """
    own = cases.select(F.col("case_id").alias("pair")).join(chunks.select(F.col("case_id").alias("pair"), F.col("id").alias("cand"), "chunk_no"), "pair")
    own = own.where("chunk_no > 1").select("pair", "cand", F.lit(1).alias("tier"), F.col("chunk_no").cast("long").alias("step"))
    pool = chunks.select("id", F.col("case_id").alias("parent_id"))
    other = tiered_candidates(cases.select(F.col("case_id").alias("id"), F.col("case_id").alias("parent_id")), pool, [[]], n, seed)
    return _take(own.unionByName(other.select("pair", "cand", F.lit(2).alias("tier"), "step")), n)


def from_files(files: DataFrame, statutes: DataFrame, rules: DataFrame, n: int = 2, max_positives: int = 5, seed: int = 42, size: int = 1200, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """Pairs (``precedent_pairs``) and all chunks of the precedents among files (file, js)."""
    fields = cut(legal.precedent_fields(legal.records(files).where("type = 'prec'")))
    chunks = cut(legal.precedent_passages(fields, size=size, overlap=overlap))
    held = chunks.select("id", F.substring("parent_id", 6, 100).alias("case_id"), "chunk_no", "title")
    return precedent_pairs(fields, held, statutes, rules, n, max_positives, seed), chunks


def precedent_pairs(fields: DataFrame, chunks: DataFrame, statutes: DataFrame, rules: DataFrame, n: int = 2, max_positives: int = 5, seed: int = 42) -> DataFrame:
    """case_id, outcome, query_text, positive_passages, hard_negatives, meta of each precedent.

    Outcomes: ok; no_query; no_ref_law (no citation: dropped by callers); no_matched_passage, where
    the precedent's first chunk is the positive if it has chunks (``prec_fallback``), else nothing.
    """
    query = query_precedent(F.col("headnote"), F.col("summary"), F.col("title"))
    cited = citations.cited_passages(fields.select("case_id", "refs"), statutes, rules, max_positives)
    held = fields.select("case_id", "refs", query.alias("query")).join(cited, "case_id", "left")
    first = chunks.where("chunk_no = 1").select("case_id", F.col("id").alias("chunk"), F.concat(F.lit(""), "title").alias("title"))
    numbers = chunks.groupBy("case_id").agg(F.count(F.lit(1)).alias("num_chunks"))
    held = held.join(first, "case_id", "left").join(numbers, "case_id", "left")
    outcome = F.when(F.col("query").isNull(), "no_query").otherwise(F.col("outcome"))
    held = cut(held.withColumn("outcome", outcome))  # every branch below reads it
    number = citations.article_number(F.col("article")).alias("article_num")
    laws = statutes.select("id", X.normalize_law_name(F.col("law_name")).alias("name"), number).unionByName(rules.select("id", X.py_strip(F.col("rule_name")).alias("name"), number))
    ok = held.where("outcome = 'ok'")
    back = held.where("outcome = 'no_matched_passage' and chunk is not null")
    negatives = cited_negatives(ok.select("case_id", "refs", "positives"), laws, n, max_positives, seed).unionByName(fallback_negatives(back.select("case_id"), chunks.select("id", "case_id", "chunk_no"), n, seed))
    out = held.join(negatives.withColumnRenamed("pair", "case_id"), "case_id", "left")
    none = F.array().cast("array<string>")
    fell_back = (F.col("outcome") == "no_matched_passage") & F.col("chunk").isNotNull()
    positives = F.when(F.col("outcome") == "ok", F.col("positives")).when(fell_back, F.array("chunk")).otherwise(none)
    kind = F.when(F.col("outcome") == "ok", "prec_to_law_admin").when(fell_back, "prec_fallback")
    meta = F.struct(kind.alias("type"), "cited_laws", "cited_rules", "matched_refs", "num_chunks")
    return out.select("case_id", "outcome", F.col("query").alias("query_text"), positives.alias("positive_passages"), F.coalesce("hard_negatives", none).alias("hard_negatives"), meta.alias("meta"))
