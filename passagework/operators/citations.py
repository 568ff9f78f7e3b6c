"""Legal citations: parsing, joining to passages, cross-positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import text as X

# The patterns of the citation grammar (a name, an article, optionally a branch and a paragraph).
LAW = r"([가-힣A-Za-z0-9·\s]+(?:법|법률))\s*제?\s*([0-9]+)\s*조(?:\s*의\s*([0-9]+))?(?:\s*제?\s*([0-9]+)\s*항)?"
RULE = r"([가-힣A-Za-z0-9·\s]+(?:규칙|고시|훈령|예규|지침|규정))\s*제?\s*([0-9]+)\s*조(?:\s*의\s*([0-9]+))?(?:\s*제?\s*([0-9]+)\s*항)?"
MENTION = r"([가-힣A-Za-z0-9·\s]+법)\s*제?\s*([0-9]+)\s*조(?:\s*의\s*([0-9]+))?"
ARTICLE = r"제\s*([0-9]+)\s*조"


def _found(text: Column, pattern: str, kind: str, normalise: bool) -> Column:
    groups = [F.regexp_extract_all(text, F.lit(pattern), i) for i in range(1, 5)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("n", "a", "s", "p"), strict=True)])
    name = (lambda x: X.normalize_law_name(x["n"])) if normalise else (lambda x: X.py_strip(x["n"]))
    refs = F.transform(
        zipped,
        lambda x: F.struct(name(x).alias("law_name"), x["a"].alias("article_num"), F.nullif(x["s"], F.lit("")).alias("sub_article"), F.nullif(x["p"], F.lit("")).alias("paragraph"), F.lit(kind).alias("type")),
    )
    return F.array_distinct(refs)


def citations(text: Column) -> Column:
    """Citations of a text, statutes first, each once: an array of structs."""
    bare = X.strip_tags(F.coalesce(text, F.lit("")))
    return F.concat(_found(bare, LAW, "law", True), _found(bare, RULE, "admin", False))


def mentions(text: Column) -> Column:
    """Statutes that a text mentions, from left to right: an array of (law_name, article_num)."""
    bare = F.coalesce(text, F.lit(""))
    names, numbers = (F.regexp_extract_all(bare, F.lit(MENTION), i) for i in (1, 2))
    return F.transform(F.arrays_zip(names.alias("n"), numbers.alias("a")), lambda x: F.struct(X.one_line(x["n"], 80).alias("law_name"), x["a"].alias("article_num")))


def parts_of(digits: Column) -> Column:
    """Every distinct run of neighbouring digits, so that "contains" becomes an equality."""
    n = F.length(digits)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(F.sequence(F.lit(1), n - a + 1), lambda k: F.substring(digits, a, k))))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def article_number(article: Column) -> Column:
    return F.nullif(F.regexp_extract(article, ARTICLE, 1), F.lit(""))


def index_join(refs: DataFrame, passages: DataFrame, on: list[str]) -> DataFrame:
    """Left equi-join of citations to passages; AQE decides on broadcasting by actual sizes."""
    return refs.join(passages, on, "left")


def refine(joined: DataFrame, ref_keys: list[str], part: str = "paragraph", ident: str = "id") -> DataFrame:
    """Where any candidate's id contains the paragraph's digits only those stay, else all do."""
    meets = F.coalesce(F.contains(F.col(ident), F.col(part)), F.lit(False))
    some = F.max(meets).over(Window.partitionBy(*ref_keys))
    return joined.withColumn("_m", meets).withColumn("_s", some).where(F.col(part).isNull() | F.col("_m") | ~F.col("_s")).drop("_m", "_s")


def cap(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key (a group limit before and after the shuffle)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n).drop("_r")


def cited_passages(precedents: DataFrame, statutes: DataFrame, rules: DataFrame, max_positives: int = 5) -> DataFrame:
    """case_id and its positives (ids in citation order) and counts of cited and matched articles.

    ``precedents``: case_id, refs (text); ``statutes``: id, law_name, article; ``rules``: id,
    rule_name, article.
    """
    refs = precedents.select("case_id", F.posexplode(citations(F.col("refs"))).alias("ref_pos", "ref")).select("case_id", "ref_pos", "ref.*")
    laws = statutes.select(X.normalize_law_name(F.col("law_name")).alias("name"), article_number(F.col("article")).alias("article_num"), "id", F.lit("law").alias("type"))
    admin = rules.select(X.py_strip(F.col("rule_name")).alias("name"), article_number(F.col("article")).alias("article_num"), "id", F.lit("admin").alias("type"))
    target = laws.unionByName(admin).where("article_num is not null")
    # what is cited is looked up once, however many cite it; no case needs more than ``max_positives`` of it
    named = refs.withColumnRenamed("law_name", "name").withColumn("part", F.coalesce("paragraph", F.lit("")))
    keys = ["name", "article_num", "type", "part"]
    asked = named.select(*keys, "paragraph").distinct()
    held = cap(refine(index_join(asked, target, keys[:3]), keys), keys, ["id"], max_positives).select(*keys, "id")
    met = named.join(held, keys)
    hits = met.where("id is not null").groupBy("case_id", "id").agg(F.min("ref_pos").alias("ref_pos"))
    kept = cap(hits, ["case_id"], ["ref_pos", "id"], max_positives)
    lists = kept.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ref_pos", "id"))), lambda x: x["id"]).alias("positives"))
    counts = met.groupBy("case_id").agg(
        F.countDistinct(F.when(F.col("type") == "law", F.col("ref_pos"))).alias("cited_laws"),
        F.countDistinct(F.when(F.col("type") == "admin", F.col("ref_pos"))).alias("cited_rules"),
        F.countDistinct(F.when(F.col("id").isNotNull(), F.col("ref_pos"))).alias("matched_refs"),
    )
    out = precedents.select("case_id").join(counts, "case_id", "left").join(lists, "case_id", "left")
    outcome = F.when(F.col("cited_laws").isNull(), "no_ref_law").when(F.col("positives").isNull(), "no_matched_passage").otherwise("ok")
    return out.withColumn("outcome", outcome)


def cross_positives(pairs: DataFrame, statutes: DataFrame, max_add: int = 2) -> DataFrame:
    """``pairs`` (query_id, source_text, positives) of precedents with statute passages that their
    text mentions: equal trimmed name, and the article's digits contain the number.  The cap counts
    before duplicates are dropped.

    A name and number needs no more than ``max_add`` passages, so the statutes are cut to these
    first: a law that every text mentions is met a few times a mention, not once a passage.
    """
    asked = pairs.select("query_id", F.posexplode(mentions(F.col("source_text"))).alias("m_pos", "m")).select("query_id", "m_pos", "m.*")
    digits = F.regexp_replace(F.coalesce("article", F.lit("")), "[^0-9]", "")
    held = statutes.select(X.py_strip(F.col("law_name")).alias("law_name"), F.explode(parts_of(digits)).alias("article_num"), "id").where("law_name <> ''")
    met = asked.join(cap(held, ["law_name", "article_num"], ["id"], max_add), ["law_name", "article_num"])
    added = cap(met, ["query_id"], ["m_pos", "id"], max_add).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("m_pos", "id"))), lambda x: x["id"]).alias("added"))
    out = pairs.join(added, "query_id", "left")
    return out.withColumn("positives", F.array_distinct(F.concat("positives", F.coalesce("added", F.array().cast("array<string>"))))).drop("added")
