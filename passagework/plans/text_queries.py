"""Queries of the text functions, chunking, filters and profile operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.cluster import spread
from passagework.functions import order as O
from passagework.functions import stats as S
from passagework.functions import text as X
from passagework.operators import chunks as C
from passagework.operators import corpus as K
from passagework.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# The driver's texts hold no white space but blanks and line ends, and are NFKC already.
_WS = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
BODY = _WS.format("text")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


@query(f"SELECT doc_id, {BODY} AS body FROM documents")
def ws_normalize(spark, d):
    return docs(spark, d).select("doc_id", X.normalize_whitespace(F.col("text")).alias("body"))


@query(f"SELECT doc_id, lower({BODY}) AS body FROM documents")
def nfkc_fold(spark, d):
    """Letters and digits are put in full width and zero-width spaces in, which folding undoes."""
    wide = F.replace(F.translate("text", "aeioun0123", "ａｅｉｏｕｎ０１２３"), F.lit("t"), F.lit("t\u200b"))
    return docs(spark, d).select("doc_id", X.normalize_text(wide, lower=True).alias("body"))


@query(f"SELECT doc_id, substr({BODY}, 1, 120) AS line FROM documents")
def one_line_cut(spark, d):
    return docs(spark, d).select("doc_id", X.one_line(F.coalesce("text", F.lit(""))).alias("line"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS body FROM pages""")
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_html(F.col("html")).alias("body"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS tokens FROM documents")
def token_count(spark, d):
    return docs(spark, d).select("doc_id", X.count_tokens(F.col("text")).alias("tokens"))


@query(r"""WITH t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT CASE WHEN n < 10 THEN 'very_short' WHEN n < 20 THEN 'short' WHEN n < 50 THEN 'medium' WHEN n < 100 THEN 'long' ELSE 'very_long' END AS bucket, count(*) AS docs, sum(n)::BIGINT AS tokens FROM t GROUP BY 1""")
def length_bucket(spark, d):
    n = docs(spark, d).select(X.count_tokens(F.col("text")).alias("n"))
    return n.groupBy(X.length_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS cut FROM documents")
def ellipsis_cut(spark, d):
    return docs(spark, d).select("doc_id", X.ellipsis(F.col("text"), 200).alias("cut"))


_CHUNKS = """w AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 200) / 1000.0) AS BIGINT)))) AS k FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, k + 1 AS chunk_no, substr(text, k * 1000 + 1, 1200) AS chunk FROM w)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_no, chunk FROM c")
def chunk_windows(spark, d):
    return C.chunk_rows(docs(spark, d).select("doc_id", "text"), F.col("text")).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk")


@query(rf"""WITH {_CHUNKS}, s AS (SELECT doc_id, chunk_no, regexp_replace(chunk, '^\s+|\s+$', '', 'g') AS chunk FROM c)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) AS chunk_no, chunk FROM s WHERE chunk <> ''""")
def chunk_strip_windows(spark, d):
    rows = C.chunk_rows(docs(spark, d).select("doc_id", "text"), F.col("text"), strip=True)
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk")


@query(f"""WITH n AS (SELECT doc_id, {BODY} AS text FROM documents), {_CHUNKS.replace('FROM documents', 'FROM n')},
f AS (SELECT doc_id, min(chunk_no) AS p, chunk FROM c WHERE length(trim(chunk)) >= 50 GROUP BY doc_id, chunk)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS chunk_no, chunk FROM f""")
def chunk_min_len_dedup(spark, d):
    body = X.normalize_whitespace(F.col("text"), compose=False)
    rows = C.chunk_rows(docs(spark, d).select("doc_id", body.alias("text")), F.col("text"), min_len=50, distinct=True)
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk")


@query(r"""WITH b AS (SELECT item_id, text, '[1] ' || text || ' [2] ' || text AS t FROM benchmark),
p AS (SELECT item_id, text, t, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM b)
SELECT item_id, CASE WHEN length(s) > 200 THEN substr(s, 1, 200) || '...' ELSE s END AS marked, substr(s, 1, 200) AS plain FROM p""")
def first_section_split(spark, d):
    b = table(spark, d, "benchmark")
    marked = F.concat(F.lit("[1] "), F.col("text"), F.lit(" [2] "), F.col("text"))
    return b.select("item_id", X.first_section(marked).alias("marked"), X.first_section(F.col("text")).alias("plain"))


@query(r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50")
def valid_passages(spark, d):
    return C.valid_passages(docs(spark, d)).select("doc_id", F.length(X.py_strip(F.col("text"))).cast("long").alias("n"))


@query(f"SELECT doc_id, length({BODY}) AS n FROM documents WHERE {BODY} <> '' AND NOT contains({BODY}, 'Licensed')")
def keyword_drop(spark, d):
    return C.live_clauses(docs(spark, d), mark="Licensed").select("doc_id", F.length(X.normalize_whitespace(F.col("text"), compose=False)).cast("long").alias("n"))


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.missing'), ''), nullif(event_type, ''), '') AS name FROM events")
def alias_coalesce(spark, d):
    e = table(spark, d, "events")
    js = F.try_parse_json("props")
    return e.select("event_id", X.alias(F.try_variant_get(js, "$.missing", "string"), F.col("event_type")).alias("name"))


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, coalesce(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 0) AS total FROM events GROUP BY event_type")
def json_prop_extract(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("with_k"), F.coalesce(F.sum("k"), F.lit(0.0)).alias("total"))


_TYPE = "CASE WHEN text LIKE '%Licensed%' THEN 'license' WHEN text LIKE '%|%' THEN 'table' WHEN lang = 'en' THEN 'english' ELSE 'other' END"


@query(f"SELECT {_TYPE} AS kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def type_dispatch(spark, d):
    text = F.col("text")
    kind = F.when(F.contains(text, F.lit("Licensed")), "license").when(F.contains(text, F.lit("|")), "table").when(F.col("lang") == "en", "english").otherwise("other")
    return docs(spark, d).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""WITH m AS (SELECT page_id, unnest(list_distinct(list_transform(list_zip(regexp_extract_all(url, '/([a-z]{2})/([0-9]+)', 1), regexp_extract_all(url, '/([a-z]{2})/([0-9]+)', 2)), lambda x: {'name': x[1], 'num': x[2]}))) AS r FROM pages)
SELECT page_id, r.name AS name, r.num AS num FROM m""")
def regex_ref_extract(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    names, numbers = (F.regexp_extract_all("url", F.lit(r"/([a-z]{2})/([0-9]+)"), i) for i in (1, 2))
    refs = F.array_distinct(F.transform(F.arrays_zip(names.alias("n"), numbers.alias("a")), lambda x: F.struct(x["n"].alias("name"), x["a"].alias("num"))))
    return p.select("page_id", F.explode(refs).alias("r")).select("page_id", "r.name", "r.num")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z][a-z]*s ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM l)
SELECT doc_id, CAST(seg AS BIGINT) AS segment, arg_min(line, i) AS header, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT regexp_matches(line, '^[A-Z][a-z]*s ')), '') AS body FROM h WHERE seg > 0 GROUP BY doc_id, seg""")
def line_segment_fold(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return K.fold_segments(lines, ["doc_id"], "i", "line", F.col("line").rlike("^[A-Z][a-z]*s "))


@query("""WITH u AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, 0 AS r, doc_id AS pos FROM documents UNION ALL SELECT CAST(item_id AS VARCHAR), text, 1, item_id FROM benchmark UNION ALL SELECT CAST(conv_id AS VARCHAR), text, 2, turn FROM conversations)
SELECT id, text FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY r, pos) = 1""")
def merge_first_wins(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("pos"))
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", F.col("item_id").alias("pos"))
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("id"), "text", F.col("turn").alias("pos"))
    return K.merge_corpora(a, b, c).select("id", "text")


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def load_last_wins(spark, d):
    return K.last_wins(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"])


@query(f"SELECT md5({BODY}) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_text_first(spark, d):
    rows = docs(spark, d).select("doc_id", K.text_hash(F.col("text")).alias("hash"))
    return K.first_wins(rows, ["hash"], ["doc_id"])


@query(f"""WITH b AS (SELECT doc_id, {BODY} AS body FROM documents), g AS (SELECT md5(body) AS hash, count(*) AS n, min(doc_id) AS first_key, list(doc_id ORDER BY doc_id)[1:1000] AS keys, min(CASE WHEN length(body) > 200 THEN substr(body, 1, 200) || '...' ELSE body END) AS sample
FROM b WHERE body <> '' GROUP BY 1 HAVING count(*) > 1) SELECT hash, n, first_key, keys, sample FROM g ORDER BY n DESC, first_key LIMIT 20""")
def dup_groups(spark, d):
    return K.duplicate_groups(docs(spark, d), "doc_id", top=20)


@query(f"WITH b AS (SELECT doc_id, {BODY} AS body FROM documents) SELECT md5(body) AS hash, doc_id AS key FROM b WHERE body <> '' QUALIFY count(*) OVER (PARTITION BY body) > 1")
def dup_members(spark, d):
    return K.duplicate_members(docs(spark, d), "doc_id")


@query(f"""WITH b AS (SELECT {BODY} AS body FROM documents), g AS (SELECT body, count(*) AS n FROM b GROUP BY body)
SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (WHERE body <> '') AS distinct_texts, CAST(coalesce(sum(n - 1) FILTER (WHERE body <> ''), 0) AS BIGINT) AS duplicates,
CAST(coalesce(sum(n) FILTER (WHERE body = ''), 0) AS BIGINT) AS empty, CAST(coalesce(sum(n) FILTER (WHERE body <> '' AND length(body) < 10), 0) AS BIGINT) AS short,
coalesce(max(n) FILTER (WHERE body <> '' AND n > 1), 0) AS largest, count(*) FILTER (WHERE body <> '' AND n > 1) AS groups, coalesce(round(avg(n) FILTER (WHERE body <> '' AND n > 1), 6), 0) AS mean_size,
round(coalesce(sum(n - 1) FILTER (WHERE body <> ''), 0) / sum(n), 6) AS dup_ratio FROM g""")
def dup_summary(spark, d):
    return K.duplicate_summary(docs(spark, d))


_QUANT = """coalesce({l} + ({h} - {l}) * ({p} * (n + 1) - {j}), {l})"""


def _stats_sql(groups: str, value: str, source: str) -> str:
    g = f"{groups}, " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    part = f"PARTITION BY {groups}" if groups else ""

    def quant(p: float) -> str:
        j = f"greatest(1, least(CAST(floor({p} * (n + 1)) AS BIGINT), n - 1))"
        return f"coalesce(max(v) FILTER (WHERE i = {j}) + (max(v) FILTER (WHERE i = {j} + 1) - max(v) FILTER (WHERE i = {j})) * ({p} * (max(n) + 1) - max({j})), max(v) FILTER (WHERE i = {j}))"

    return f"""WITH s AS (SELECT {g}CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL),
r AS (SELECT {g}v, row_number() OVER ({part} ORDER BY v) AS i, count(*) OVER ({part}) AS n FROM s)
SELECT {g}count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(coalesce(stddev_samp(v), 0), 6) AS stdev, round({quant(0.25)}, 6) AS p25, round({quant(0.75)}, 6) AS p75 FROM r {by}"""


def _rounded(df: DataFrame) -> DataFrame:
    return S.rounded(df, "mean", "median", "stdev", "p25", "p75")


@query(_stats_sql("source", "length(text)", "documents"))
def group_length_stats(spark, d):
    return _rounded(S.summary(docs(spark, d).select("source", F.length("text").alias("v")), ["source"], "v"))


@query(_stats_sql("", "length(text)", "documents"))
def corpus_length_stats(spark, d):
    return _rounded(S.summary(docs(spark, d).select(F.length("text").alias("v")), [], "v"))


@query(_stats_sql("l_returnflag, l_linestatus", "l_quantity", "lineitem"))
def exclusive_quartiles(spark, d):
    return _rounded(S.summary(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("v")), ["l_returnflag", "l_linestatus"], "v"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source")
def source_histogram(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT coalesce(nullif(lang, ''), 'unknown') AS type, count(*) AS n FROM documents GROUP BY 1")
def type_counts(spark, d):
    return docs(spark, d).groupBy(F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS t, length(text) AS c FROM documents),
s AS (SELECT lang, count(*) AS n, sum(t)::BIGINT AS total_tokens, avg(t) AS avg_tokens, avg(c) AS avg_chars FROM t GROUP BY lang), b AS (SELECT avg_tokens AS base FROM s WHERE lang = 'en')
SELECT lang, k, round(avg_tokens * k, 6) AS tokens, round((base - avg_tokens) * k, 6) AS saved, round(CASE WHEN base > 0 THEN (base - avg_tokens) / base * 100 ELSE 0 END, 6) AS saved_percent FROM s, b, (SELECT unnest([10, 20]) AS k)""")
def chunk_token_saving(spark, d):
    from passagework.operators import reports

    stats = reports.chunk_tokens(docs(spark, d), "lang")
    return S.rounded(reports.token_saving(stats, "lang", "en"), "tokens", "saved", "saved_percent")


@query(r"""SELECT conv_id, list_reduce(list(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') ORDER BY turn), lambda a, x: CASE WHEN x = '' OR contains(a, x) THEN a WHEN a = '' THEN x ELSE a || chr(10) || x END, '') AS text FROM conversations GROUP BY conv_id""")
def article_concat(spark, d):
    return K.concat_groups(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, CASE row_number() OVER (ORDER BY doc_id) % 10 WHEN 8 THEN 'valid' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM documents")
def split_mod10(spark, d):
    from passagework.operators.pairs import split_of

    return O.number_rows(docs(spark, d).select("doc_id"), "doc_id").select("doc_id", F.col("n").cast("long").alias("n"), split_of(F.col("n")).alias("split"))
