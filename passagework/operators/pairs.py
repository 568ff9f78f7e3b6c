"""Query-passage pairs: queries from passages, validation, splits, summaries, training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import text as X
from passagework.functions.order import hash_key, number_rows
from passagework.operators.chunks import valid_passages
from passagework.operators.citations import cap
from passagework.operators.corpus import first_of_text
from passagework.operators.encode import TemplateMode, template
from passagework.operators.negatives import tiered


# Fixed wordings of the questions.
ABOUT, CONTENT = " 관련 내용은 무엇인가?", "의 내용은 무엇인가?"
GIST, NO_GIST = "의 요지는 무엇인가?", "이 판례의 요지는 무엇인가?"
RULING, GROUNDS, APPLIED = "에 대한 법적 판단은?", "에 대한 법적 근거는?", "에 적용되는 법령은?"


def _cut(c: Column, n: int) -> Column:
    return X.short(F.coalesce(c, F.lit("")), n)


def query_law(name: Column, article: Column, title: Column) -> Column:
    """The question on a statute's article; its title is named unless the article's label holds it."""
    name, article, title = _cut(name, 60), _cut(article, 40), _cut(title, 60)
    titled = F.concat(name, F.lit(" "), article, F.lit("("), X.short(title, 40), F.lit(")" + CONTENT))
    return (
        F.when((article != "") & (title != "") & ~F.contains(article, title), titled)
        .when(article != "", F.concat(name, F.lit(" "), article, F.lit(CONTENT)))
        .otherwise(F.concat(name, F.lit(ABOUT)))
    )


def query_rule(name: Column, article: Column, title: Column, appendix: Column) -> Column:
    """The question on a rule's article, else on its appendix, else on the rule."""
    by_appendix = F.concat(_cut(name, 60), F.lit("의 '"), _cut(appendix, 60), F.lit("' 별표 내용은 무엇인가?"))
    return F.when((_cut(article, 40) == "") & (_cut(appendix, 60) != ""), by_appendix).otherwise(query_law(name, article, title))


def query_precedent_passage(title: Column, headnote: Column, summary: Column) -> Column:
    """The question on a precedent's passage: by title, else by head-note or summary."""
    named = X.one_line(F.coalesce(title, F.lit("")), 120)
    other = X.one_line(X.alias(headnote, summary), 120)
    return F.when(named != "", F.concat(named, F.lit(GIST))).when(other != "", F.concat(other, F.lit(GIST))).otherwise(NO_GIST)


def query_precedent(headnote: Column, summary: Column, title: Column) -> Column:
    """The question of a precedent: first section of the head-note, else of the summary, else the
    case's name; null without any."""
    first = X.first_section(X.clean_html(F.coalesce(headnote, F.lit(""))))
    second = X.first_section(X.clean_html(F.coalesce(summary, F.lit(""))))
    name = X.one_line(F.coalesce(title, F.lit("")), 100)
    return (
        F.when(first != "", X.one_line(F.concat(first, F.lit(RULING)), 200))
        .when(second != "", X.one_line(F.concat(second, F.lit(GROUNDS)), 200))
        .when(name != "", F.concat(name, F.lit(APPLIED)))
    )


def self_pairs(passages: DataFrame, query: Column, group: str, kind: str, n: int, seed: int = 42, min_len: int = 50) -> DataFrame:
    """A pair for each passage of ``min_len`` characters: itself as positive, negatives of its group first."""
    pool = valid_passages(passages, "text", min_len)
    negatives = tiered(pool, pool, [[group], []], n, seed)
    own = pool.select(F.col("id").alias("pair"), query.alias("query_text"), F.array("id").alias("positive_passages"), F.struct(F.lit(kind).alias("type"), F.col(group).cast("string").alias("group")).alias("meta"))
    out = own.join(negatives, "pair", "left")
    return out.select("pair", "query_text", "positive_passages", F.coalesce("negatives", F.array().cast("array<string>")).alias("hard_negatives"), "meta")


def precedent_self_pairs(passages: DataFrame, n: int, seed: int = 42, min_len: int = 50) -> DataFrame:
    """Pairs of precedent passages, each its own positive, negatives of the same court first; keeps
    ``source_text`` (what the passage says, 400 characters of one line), where statutes may be mentioned."""
    held = passages.withColumn("court_name", F.coalesce("court_name", F.lit("")))
    query = query_precedent_passage(F.col("title"), F.col("headnote"), F.col("summary"))
    out = self_pairs(held, query, "court_name", "prec", n, seed, min_len)
    said = F.concat_ws(" ", F.coalesce("headnote", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("text", F.lit("")))
    return out.join(held.select(F.col("id").alias("pair"), X.one_line(said, 400).alias("source_text")), "pair")


def finish(pairs: DataFrame, order: list[str]) -> DataFrame:
    """First pair of each query text; ids ``Q_00001`` ... in order; split by number."""
    once = first_of_text(pairs, "query_text", order)
    numbered = number_rows(once, *order, out="i")
    return numbered.withColumn("query_id", F.concat(F.lit("Q_"), X.zfill(F.col("i").cast("string"), 5))).withColumn("split", split_of(F.col("i")))


def split_of(number: Column) -> Column:
    """By the last digit of a row's number (from 1): 8 valid, 9 test, else train."""
    at = F.pmod(number, F.lit(10))
    return F.when(at == 8, "valid").when(at == 9, "test").otherwise("train")


def absent(pairs: DataFrame, corpus: DataFrame, column: str, key: str = "pair", ident: str = "id") -> DataFrame:
    """key and ``absent``: the ids of ``column`` that the corpus lacks, in order."""
    named = pairs.select(key, F.explode(column).alias(ident)).distinct()
    return named.join(corpus.select(ident), ident, "left_anti").groupBy(key).agg(F.sort_array(F.collect_list(ident)).alias("absent"))


def validated(pairs: DataFrame, corpus: DataFrame, key: str = "pair") -> DataFrame:
    """``pairs`` with ``errors``, an array of words: query_text (empty), positive_passages (null or
    empty), absent_positives and absent_negatives (ids that the corpus lacks) with these as
    missing_positives and missing_negatives, the first three of each."""
    out = pairs
    for column, name in (("positive_passages", "missing_positives"), ("hard_negatives", "missing_negatives")):
        found = absent(pairs, corpus, column, key).select(key, F.slice("absent", 1, 3).alias(name))
        out = out.join(found, key, "left")
    errors = F.array(
        F.when(F.coalesce("query_text", F.lit("")) == "", "query_text"),
        F.when(F.coalesce(F.size("positive_passages"), F.lit(0)) <= 0, "positive_passages"),
        F.when(F.col("missing_positives").isNotNull(), "absent_positives"),
        F.when(F.col("missing_negatives").isNotNull(), "absent_negatives"),
    )
    return out.withColumn("errors", F.filter(errors, lambda x: x.isNotNull()))


def structure_errors(query_id: Column, query_text: Column, positives: Column, negatives: Column) -> Column:
    """What a data set's rows may not lack, as an array of words."""
    found = F.array(
        F.when(F.coalesce(query_id, F.lit("")) == "", "query_id"),
        F.when(X.py_strip(F.coalesce(query_text, F.lit(""))) == "", "query_text"),
        F.when(F.coalesce(F.size(positives), F.lit(0)) <= 0, "positive_passages"),
        F.when(F.size(F.array_intersect(positives, negatives)) > 0, "overlap"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def validity(checked: DataFrame) -> DataFrame:
    """total, valid and invalid of ``validated`` pairs, and the share of invalid ones."""
    bad = F.size("errors") > 0
    out = checked.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(~bad, 1)).alias("valid"), F.count(F.when(bad, 1)).alias("invalid"))
    return out.withColumn("invalid_share", F.when(F.col("total") > 0, F.col("invalid") / F.col("total")).otherwise(0.0))


def histograms(checked: DataFrame) -> DataFrame:
    """measure (type, positives, negatives), value and n, over valid pairs."""
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("string")
    rows = F.array(
        F.struct(F.lit("type").alias("measure"), F.coalesce("meta.type", F.lit("unknown")).alias("value")),
        F.struct(F.lit("positives").alias("measure"), size("positive_passages").alias("value")),
        F.struct(F.lit("negatives").alias("measure"), size("hard_negatives").alias("value")),
    )
    return checked.where(F.size("errors") == 0).select(F.explode(rows).alias("r")).groupBy("r.measure", "r.value").agg(F.count(F.lit(1)).alias("n"))


def samples(checked: DataFrame, key: str = "pair", valid: int = 5, invalid: int = 10) -> DataFrame:
    """The first ``valid`` valid pairs of each type, with 5 positives and 3 negatives at most, and the
    first ``invalid`` invalid ones with what is wrong with them."""
    kind = F.coalesce("meta.type", F.lit("unknown"))
    good = cap(checked.where(F.size("errors") == 0).withColumn("type", kind), ["type"], [key], valid)
    bad = cap(checked.where(F.size("errors") > 0).withColumn("type", F.lit("invalid")), ["type"], [key], invalid)
    return good.unionByName(bad).select(key, "type", X.short(F.col("query_text"), 100).alias("query_text"), F.slice("positive_passages", 1, 5).alias("positive_passages"), F.slice("hard_negatives", 1, 3).alias("hard_negatives"), "errors")


def missing_ids(pairs: DataFrame, corpus: DataFrame, column: str = "positive_passages", key: str = "id") -> DataFrame:
    """Ids that pairs name and the corpus lacks, with how often."""
    named = pairs.select(F.explode(column).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    return named.join(corpus.select(key), key, "left_anti")


def example_rows(pairs: DataFrame, corpus: DataFrame, negatives: int) -> DataFrame:
    """query_id, pos_id and texts: the query, a positive, then negatives in order (those that the
    corpus holds).  One row a positive; a pair without any positive in the corpus has none.

    Positives and negatives meet the corpus in one join, so that it is shuffled once; what a pair was
    given comes together in one more shuffle, with its query.
    """
    own = pairs.withColumn("_k", F.xxhash64("query_id", "query_text", "positive_passages"))  # should ids repeat
    named = lambda c, kind: F.transform(c, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.alias("pid")))
    none = F.array().cast("array<struct<kind:int,pos:int,pid:string>>")
    both = F.concat(F.coalesce(named(F.col("positive_passages"), 0), none), F.coalesce(named(F.slice("hard_negatives", 1, negatives), 1), none))
    asked = own.select("query_id", "_k", F.inline(both))
    met = asked.join(corpus.select(F.col("id").alias("pid"), F.col("text").alias("ptext")), "pid").select("query_id", "_k", "kind", "pos", "pid", "ptext")
    said = own.select("query_id", "_k", F.lit(-1).alias("kind"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("pid"), F.col("query_text").alias("ptext"))
    held = met.unionByName(said).groupBy("query_id", "_k").agg(F.sort_array(F.collect_list(F.struct("kind", "pos", "pid", "ptext"))).alias("l"))
    of = lambda kind: F.filter("l", lambda x: x["kind"] == kind)
    texts = lambda rows: F.transform(rows, lambda x: x["ptext"])
    out = held.select("query_id", texts(F.slice(of(-1), 1, 1)).alias("q"), F.explode(of(0)).alias("p"), texts(of(1)).alias("neg"))
    return out.select("query_id", F.col("p.pid").alias("pos_id"), F.concat("q", F.array("p.ptext"), "neg").alias("texts"))


def training_rows(pairs: DataFrame, corpus: DataFrame, negatives: int = 0, normalize: bool = False, mode: TemplateMode = TemplateMode.BGE) -> DataFrame:
    """``example_rows`` under the template of each side, of normalised texts if ``normalize``; pairs
    without any positive in the corpus have no row (``without_positive`` counts them)."""
    said = (lambda c: X.normalize_text(F.col(c))) if normalize else (lambda c: F.coalesce(c, F.lit("")))
    asked = pairs.withColumn("query_text", template(said("query_text"), "query", mode))
    held = corpus.select("id", template(said("text"), "passage", mode).alias("text"))
    return example_rows(asked, held, negatives)


def without_positive(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: pairs, and those that name no passage of the corpus as positive."""
    held = pairs.select("query_id", F.explode("positive_passages").alias("id")).join(corpus.select("id"), "id", "left_semi").select("query_id").distinct()
    met = pairs.select("query_id").join(held.withColumn("held", F.lit(1)), "query_id", "left")
    return met.agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("held").isNull(), 1)).alias("without_positive"))


def multiplied(rows: DataFrame, times: int, key: str, seed: int = 42) -> DataFrame:
    """Each row ``times`` over, in hash order of key and copy."""
    again = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return again.withColumn("order_key", hash_key(seed, F.col(key), F.col("copy")))


def first_batches(rows: DataFrame, batch: int, order: str = "order_key", batches: int = 100) -> DataFrame:
    """The first rows in order, for a trial run: ``batches`` of ``batch``."""
    return rows.orderBy(order).limit(batch * batches)


def batch_plan(examples: int, batch: int, epochs: int) -> dict[str, int]:
    """Batch size, steps and warm-up of a training run."""
    size = max(1, min(batch, examples))
    steps = -(-examples // size) * epochs
    return {"batch_size": size, "total_steps": steps, "warmup_steps": max(10, int(steps * 0.05))}
