"""Queries of the legal flatteners and pair builders, with their SQL.

Every document becomes a file of JSON: English ones statutes (a line an article, its sentences
paragraphs, what stands between commas items), German ones administrative rules (two lines an
article), French ones precedents with a body and citations, the others wrapped precedents with a
summary alone.  Files of source ``src0`` hold a list of one, those of ``src1`` don't parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.cluster import cut, spread
from passagework.operators import analysis, citations, legal, precedent_pairs, reports, units
from passagework.operators.corpus import article_passages, merge_corpora
from passagework.operators.pairs import GROUNDS, RULING
from passagework.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
DELETED, CHAPTER = "삭제 <2010.1.1>", "제1장 총칙"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


# --- the files ----------------------------------------------------------------------------------


def _statute(text: Column) -> Column:
    def item(x: Column, k: Column) -> Column:
        return F.struct((k + 1).cast("string").alias("호번호"), x.alias("호내용"))

    def paragraph(s: Column, j: Column) -> Column:
        cuts = F.split(s, ", ")
        items = F.when(F.size(cuts) > 1, F.transform(F.slice(cuts, F.lit(2), F.size(cuts) - 1), item))
        return F.struct((j + 1).cast("string").alias("항번호"), F.when(F.startswith(s, F.lit("Er")), DELETED).otherwise(F.get(cuts, F.lit(0))).alias("항내용"), items.alias("호"))

    def article(line: Column, i: Column) -> Column:
        said = F.split(line, r"\. ")
        several = F.size(said) > 1
        return F.struct((i + 1).cast("string").alias("조문번호"), F.when(several, "").otherwise(line).alias("조문내용"), F.lit("20200101").alias("조문시행일자"), F.when(several, F.transform(said, paragraph)).alias("항"))

    return F.to_json(F.struct(F.col("doc_id").cast("string").alias("법령ID"), F.concat("source", F.lit("법")).alias("법령명"), F.transform(F.split(text, "\n"), article).alias("조문")))


def _rule(text: Column) -> Column:
    def line(x: Column, i: Column) -> Column:
        n = F.floor(i / 2) + 1
        return F.when(i % 2 == 0, F.concat(F.lit("제"), n, F.lit("조(T"), n, F.lit(") "), x)).otherwise(x)

    clauses = F.concat(F.lit(CHAPTER + "\n"), F.array_join(F.transform(F.split(text, "\n"), line), "\n"))
    info = F.struct(F.col("doc_id").alias("행정규칙일련번호"), F.concat("source", F.lit(" 규칙")).alias("행정규칙명"), F.lit("20210101").alias("시행일자"))
    unit = F.struct(F.lit("1").alias("별표번호"), F.lit("00").alias("별표가지번호"), F.concat(F.lit("표 "), "lang").alias("별표제목"), F.array(F.array("source"), F.array("lang")).alias("별표내용"))
    return F.to_json(F.struct(F.struct(info.alias("행정규칙기본정보"), clauses.alias("조문내용"), F.struct(F.array(unit).alias("별표단위")).alias("별표")).alias("AdmRulService")))


def _refs(n: Column) -> Column:
    return F.concat(
        F.lit("[1]"), "source", F.lit("법 제"), n % 7 + 1, F.lit("조 제"), n % 3 + 1, F.lit("항, 제9조 / [2]"), "source", F.lit(" 규칙 "), n % 4 + 1, F.lit("조 의 2<br/>구 SW진흥법 3조"),
    )


def _precedent(text: Column) -> Column:
    n = F.length(text)
    head = [F.col("doc_id").cast("string").alias("판례일련번호"), F.concat("source", F.lit(" 사건")).alias("사건명")]
    full = F.struct(*head, F.concat(F.lit("법원 "), n % 3).alias("법원명"), F.lit("판결").alias("판결유형"), F.concat(F.lit("[1] 요지 "), "source", F.lit(" [2] 둘째")).alias("판시사항"), text.alias("판결본문"), _refs(n).alias("참조조문"))
    brief = F.struct(F.struct(*head, F.when(n % 2 == 0, "결정").otherwise("명령").alias("판결유형"), text.alias("판결요지")).alias("PrecService"))
    return F.when(F.col("lang") == "fr", F.to_json(full)).otherwise(F.to_json(brief))


def files(spark: SparkSession, d: str) -> DataFrame:
    """(file, js) of every document; js is null where the file doesn't parse."""
    docs = spread(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source"))
    text = F.col("text")
    raw = F.when(F.col("lang") == "en", _statute(text)).when(F.col("lang") == "de", _rule(text)).otherwise(_precedent(text))
    raw = F.when(F.col("source") == "src0", F.concat(F.lit("["), raw, F.lit("]"))).when(F.col("source") == "src1", F.concat(F.lit("{"), raw)).otherwise(raw)
    return docs.select(F.concat(F.lit("F"), "doc_id").alias("file"), F.try_parse_json(raw).alias("js"))


def parts(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    """Of ``names`` statutes, rules, fields (of judged precedents) and chunks."""
    typed = cut(legal.records(files(spark, d)))  # files are parsed once, whatever is made of them
    fields = legal.precedent_fields(typed.where("type = 'prec'"), judged_only=True)
    made = {
        "statutes": lambda: legal.statutes(typed.where("type = 'law'")), "items": lambda: legal.statutes(typed.where("type = 'law'"), include_items=True),
        "rules": lambda: legal.rule_passages(typed.where("type = 'admin'")), "fields": lambda: fields, "chunks": lambda: legal.precedent_passages(fields),
    }
    return [made[n]() for n in names]


# --- SQL ----------------------------------------------------------------------------------------


def _ws(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _fill(x: str, n: int) -> str:
    return f"CASE WHEN length(CAST({x} AS VARCHAR)) < {n} THEN lpad(CAST({x} AS VARCHAR), {n}, '0') ELSE CAST({x} AS VARCHAR) END"


_DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents WHERE source <> 'src1')"
_LAW = f"""law AS (SELECT doc_id, {_fill("doc_id", 6)} AS law_id, source || '법' AS law_name, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs WHERE lang = 'en'),
art AS (SELECT *, '제' || i || '조' AS article, 'LAW_' || law_id || '_제' || i || '조' AS aid, string_split(line, '. ') AS said FROM law),
para AS (SELECT *, unnest(said) AS s, generate_subscripts(said, 1) AS j FROM art WHERE len(said) > 1),
cuts AS (SELECT *, {_ws("string_split(s, ', ')[1]")} AS p_text, list_transform(string_split(s, ', ')[2:], lambda x: {_ws("x")}) AS its FROM para),
live AS (SELECT *, aid || '_' || j AS pid, list_filter(its, lambda x: x <> '') AS held FROM cuts WHERE p_text <> '' AND NOT starts_with(s, 'Er')),
alone AS (SELECT doc_id, i, 0 AS j, aid AS id, aid AS parent_id, law_id, law_name, article, {_ws("line")} AS text FROM art WHERE len(said) = 1 AND {_ws("line")} <> ''),
statutes AS (SELECT * FROM alone UNION ALL SELECT doc_id, i, j, pid, aid, law_id, law_name, article, p_text || CASE WHEN len(held) > 0 THEN ' ' || array_to_string(held, ' ') ELSE '' END FROM live)"""
_ITEMS = """items AS (SELECT * FROM alone UNION ALL SELECT doc_id, i, j, pid, aid, law_id, law_name, article, p_text FROM live WHERE len(held) = 0
UNION ALL SELECT doc_id, i, j, pid || '_' || k, pid, law_id, law_name, article, t FROM (SELECT *, unnest(its) AS t, generate_subscripts(its, 1) AS k FROM live WHERE len(held) > 0) WHERE t <> '')"""
_LAW_OUT = "SELECT id, parent_id, '법령' AS type, law_id, law_name, article, '20200101' AS effective_date, text FROM"
_RULE = f"""rl AS (SELECT {_fill("doc_id", 10)} AS rule_id, source || ' 규칙' AS rule_name, doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM docs WHERE lang = 'de'),
ra AS (SELECT rule_id, rule_name, doc_id, i // 2 + 1 AS k, {_strip("string_agg(" + _strip("line") + ", chr(10) ORDER BY i) FILTER (WHERE " + _strip("line") + " <> '')")} AS text FROM rl GROUP BY ALL),
rules AS (SELECT doc_id, 'ADM_' || rule_id || '_제' || k || '조' AS id, 'ADM_' || rule_id || '_제' || k || '조' AS parent_id, '행정규칙' AS type, rule_id, rule_name, '20210101' AS effective_date, '제' || k || '조' AS article, 'T' || k AS title, NULL AS appendix_no, NULL AS appendix_title, text FROM ra WHERE text <> ''
UNION ALL SELECT doc_id, 'ADM_' || {_fill("doc_id", 10)} || '_APPX_00_1', 'ADM_' || {_fill("doc_id", 10)} || '_APPX_00', '행정규칙-별표', {_fill("doc_id", 10)}, source || ' 규칙', '20210101', NULL, NULL, '1', '표 ' || lang, source || chr(10) || lang FROM docs WHERE lang = 'de')"""
_PREC = f"""fields AS (SELECT doc_id, {_fill("doc_id", 6)} AS case_id, source || ' 사건' AS title, source, CASE WHEN lang = 'fr' THEN '법원 ' || length(text) % 3 ELSE '' END AS court_name, CASE WHEN lang = 'fr' THEN '[1] 요지 ' || source || ' [2] 둘째' ELSE '' END AS headnote,
 CASE WHEN lang = 'fr' THEN '' ELSE text END AS summary, CASE WHEN lang = 'fr' THEN text ELSE '' END AS body,
 CASE WHEN lang = 'fr' THEN '[1]' || source || '법 제' || (length(text) % 7 + 1) || '조 제' || (length(text) % 3 + 1) || '항, 제9조 / [2]' || source || ' 규칙 ' || (length(text) % 4 + 1) || '조 의 2<br/>구 SW진흥법 3조' ELSE '' END AS refs
 FROM docs WHERE lang = 'fr' OR (lang NOT IN ('en', 'de') AND length(text) % 2 = 0)),
pt AS (SELECT *, CASE WHEN {_ws("body")} <> '' THEN {_ws("body")} WHEN length({_ws("headnote || chr(10) || summary")}) >= 50 THEN {_ws("headnote || chr(10) || summary")} ELSE '' END AS t FROM fields),
pw AS (SELECT *, unnest(range(0, greatest(0, CAST(ceil((length(t) - 200) / 1000) AS BIGINT) - 1) + 1)) AS w FROM pt WHERE length(t) > 0),
pc AS (SELECT doc_id, case_id, title, court_name, headnote, summary, substr(t, w * 1000 + 1, 1200) AS chunk, min(w) AS w FROM pw WHERE length({_strip("substr(t, w * 1000 + 1, 1200)")}) >= 50 GROUP BY ALL),
chunks AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY w) AS INT) AS chunk_no, {_strip("chunk")} AS text, 'PREC_' || case_id AS parent_id FROM pc)"""
_ALL = f"WITH {_DOCS}, {_LAW}, {_RULE}, {_PREC}"


@query("SELECT 'F' || doc_id AS file, CASE WHEN source = 'src1' THEN 'unknown' WHEN lang = 'en' THEN 'law' WHEN lang = 'de' THEN 'admin' ELSE 'prec' END AS type FROM documents")
def detect_types(spark, d):
    return files(spark, d).select("file", legal.detect_type(F.col("js")).alias("type"))


@query(f"WITH {_DOCS}, {_LAW} {_LAW_OUT} statutes")
def law_flatten(spark, d):
    return parts(spark, d, "statutes")[0].select("id", "parent_id", "type", "law_id", "law_name", "article", "effective_date", "text")


@query(f"WITH {_DOCS}, {_LAW}, {_ITEMS} {_LAW_OUT} items")
def law_flatten_items(spark, d):
    return parts(spark, d, "items")[0].select("id", "parent_id", "type", "law_id", "law_name", "article", "effective_date", "text")


@query(f"WITH {_DOCS}, {_RULE} SELECT id, parent_id, type, rule_id, rule_name, effective_date, article, title, appendix_no, appendix_title, text FROM rules")
def rule_flatten(spark, d):
    return parts(spark, d, "rules")[0].select("id", "parent_id", "type", "rule_id", "rule_name", "effective_date", "article", "title", "appendix_no", "appendix_title", "text")


@query(f"WITH {_DOCS}, {_PREC} SELECT parent_id || '_' || chunk_no AS id, parent_id, '판례' AS type, title, court_name, text, substr({_strip('headnote')}, 1, 1000) AS headnote, substr({_strip('summary')}, 1, 1000) AS summary, chunk_no FROM chunks")
def prec_flatten(spark, d):
    return parts(spark, d, "chunks")[0].select("id", "parent_id", "type", "title", "court_name", "text", "headnote", "summary", F.col("chunk_no").cast("int").alias("chunk_no"))


@query(f"{_ALL} SELECT id, '법령' AS type, text FROM statutes UNION ALL SELECT id, type, text FROM rules UNION ALL SELECT parent_id || '_' || chunk_no, '판례', text FROM chunks")
def corpus_merge_legal(spark, d):
    held = parts(spark, d, "statutes", "rules", "chunks")
    return merge_corpora(*[p.select("id", "type", "text", F.hash("id").alias("pos")) for p in held]).select("id", "type", "text")


_REFS = rf"""bare AS (SELECT case_id, regexp_replace(regexp_replace(refs, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g') AS t FROM fields),
found AS (SELECT case_id, list_concat(list_transform(list_zip(regexp_extract_all(t, '{citations.LAW}', 1), regexp_extract_all(t, '{citations.LAW}', 2), regexp_extract_all(t, '{citations.LAW}', 3), regexp_extract_all(t, '{citations.LAW}', 4)),
 lambda x: {{'law_name': {_strip("regexp_replace(" + _ws("x[1]") + ", '\\([^)]*\\)', '', 'g')")}, 'article_num': x[2], 'sub_article': nullif(x[3], ''), 'paragraph': nullif(x[4], ''), 'type': 'law'}}),
 list_transform(list_zip(regexp_extract_all(t, '{citations.RULE}', 1), regexp_extract_all(t, '{citations.RULE}', 2), regexp_extract_all(t, '{citations.RULE}', 3), regexp_extract_all(t, '{citations.RULE}', 4)),
 lambda x: {{'law_name': {_strip("x[1]")}, 'article_num': x[2], 'sub_article': nullif(x[3], ''), 'paragraph': nullif(x[4], ''), 'type': 'admin'}})) AS l FROM bare),
refs AS (SELECT case_id, CAST(p - 1 AS INT) AS ref_pos, r.* FROM (SELECT case_id, unnest(l) AS r, generate_subscripts(l, 1) AS p FROM found))"""


@query(f"WITH {_DOCS}, {_PREC}, {_REFS} SELECT case_id, ref_pos, law_name, article_num, sub_article, paragraph, type FROM refs")
def citation_parse(spark, d):
    fields = parts(spark, d, "fields")[0]
    return fields.select("case_id", F.posexplode(citations.citations(F.col("refs"))).alias("ref_pos", "ref")).select("case_id", "ref_pos", "ref.*")


_CITED = f"""{_REFS}, target AS (SELECT {_strip("regexp_replace(" + _ws("law_name") + ", '\\([^)]*\\)', '', 'g')")} AS law_name, CAST(i AS VARCHAR) AS article_num, id, 'law' AS type FROM statutes UNION ALL SELECT {_strip("rule_name")}, substr(article, 2, length(article) - 2), id, 'admin' FROM rules WHERE article IS NOT NULL),
met AS (SELECT r.case_id, r.ref_pos, r.type, paragraph, id, coalesce(contains(id, paragraph), false) AS meets FROM refs r LEFT JOIN target t ON r.law_name = t.law_name AND r.article_num = t.article_num AND r.type = t.type),
refined AS (SELECT * FROM (SELECT *, bool_or(meets) OVER (PARTITION BY case_id, ref_pos) AS any_meets FROM met) WHERE paragraph IS NULL OR meets OR NOT any_meets),
firsts AS (SELECT case_id, id, min(ref_pos) AS ref_pos FROM refined WHERE id IS NOT NULL GROUP BY ALL),
hits AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ref_pos, id) <= 5),
lists AS (SELECT case_id, list(id ORDER BY ref_pos, id) AS positives FROM hits GROUP BY case_id),
counts AS (SELECT case_id, count(DISTINCT ref_pos) FILTER (WHERE type = 'law') AS cited_laws, count(DISTINCT ref_pos) FILTER (WHERE type = 'admin') AS cited_rules, count(DISTINCT ref_pos) FILTER (WHERE id IS NOT NULL) AS matched_refs FROM refined GROUP BY case_id),
cited AS (SELECT f.case_id, cited_laws, cited_rules, matched_refs, positives, CASE WHEN cited_laws IS NULL THEN 'no_ref_law' WHEN positives IS NULL THEN 'no_matched_passage' ELSE 'ok' END AS outcome FROM fields f LEFT JOIN counts c ON f.case_id = c.case_id LEFT JOIN lists l ON f.case_id = l.case_id)"""


def _targets(laws: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    return laws.select("id", "law_name", "article"), rules.where("article is not null").select("id", "rule_name", "article")


@query(f"{_ALL}, {_CITED} SELECT case_id, outcome, positives, cited_laws, cited_rules, matched_refs FROM cited")
def cited_positives(spark, d):
    laws, rules, fields = parts(spark, d, "statutes", "rules", "fields")
    return citations.cited_passages(fields.select("case_id", "refs"), *_targets(laws, rules)).select("case_id", "outcome", "positives", "cited_laws", "cited_rules", "matched_refs")


_UNITS = """members AS (SELECT id AS p, parent_id AS unit, 'article' AS kind FROM statutes UNION SELECT CASE WHEN id IN (SELECT id FROM statutes) THEN id ELSE parent_id END, id, 'item' FROM items),
wanted AS (SELECT case_id, unnest(positives) AS p, generate_subscripts(positives, 1) AS pos FROM cited WHERE positives IS NOT NULL),
kinds AS (SELECT unnest(['paragraph', 'item', 'article']) AS kind),
each AS (SELECT case_id, k.kind, coalesce(m.unit, w.p) AS unit, min(pos) AS pos FROM wanted w CROSS JOIN kinds k LEFT JOIN members m ON m.p = w.p AND m.kind = k.kind GROUP BY ALL)"""


@query(f"{_ALL}, {_ITEMS}, {_CITED}, {_UNITS} SELECT case_id, kind, list(unit ORDER BY pos, unit) AS positives FROM each GROUP BY case_id, kind")
def chunk_unit_positives(spark, d):
    """Cited passages of each case, as paragraphs, items and articles."""
    laws, items, rules, fields = map(cut, parts(spark, d, "statutes", "items", "rules", "fields"))
    found = citations.cited_passages(fields.select("case_id", "refs"), *_targets(laws, rules)).where("positives is not null").select("case_id", "positives")
    pairs, members = cut(found), cut(units.hierarchy(laws, items))
    out = [units.remap(pairs, members, u, "case_id", "positives").select("case_id", F.lit(u).alias("kind"), "positives") for u in units.UNITS]
    return out[0].unionAll(out[1]).unionAll(out[2]).where(F.size("positives") > 0)


@query(f"""{_ALL}, {_ITEMS}, articles AS (SELECT law_id, article, list_reduce(list({_strip("text")} ORDER BY j), lambda a, x: CASE WHEN x = '' OR contains(a, x) THEN a WHEN a = '' THEN x ELSE a || chr(10) || x END, '') AS text FROM statutes GROUP BY ALL),
every AS (SELECT 'paragraph' AS unit, text FROM statutes UNION ALL SELECT 'item', text FROM items UNION ALL SELECT 'article', text FROM articles UNION ALL SELECT unit, text FROM rules, (SELECT unnest(['paragraph', 'item', 'article']) AS unit)),
sizes AS (SELECT unit, count(*) AS n, avg(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS tokens FROM every GROUP BY unit)
SELECT unit, k, n, round(tokens * k, 6) AS tokens, round(((SELECT tokens FROM sizes WHERE unit = 'paragraph') - tokens) * k, 6) AS saved FROM sizes, (SELECT unnest([10, 20]) AS k)""")
def chunk_unit_tokens(spark, d):
    """Words that k passages of each unit cost, and save against paragraphs."""
    laws, items, rules = map(cut, parts(spark, d, "statutes", "items", "rules"))
    held = units.corpora(laws, items, rules)
    every = [df.select(F.lit(u).alias("unit"), "text") for u, df in held.items()]
    sizes = cut(reports.chunk_tokens(every[0].unionAll(every[1]).unionAll(every[2]), "unit"))  # a row a unit
    return reports.token_saving(sizes, "unit", "paragraph").join(sizes.select("unit", "n"), "unit").select("unit", "k", "n", F.round("tokens", 6).alias("tokens"), F.round("saved", 6).alias("saved"))


_QUERY = f"""CASE WHEN f.headnote <> '' THEN substr({_ws("'요지 ' || f.source || '" + RULING + "'")}, 1, 200) WHEN {_ws("f.summary")} <> '' THEN substr({_ws("substr(" + _strip(_ws("regexp_replace(regexp_replace(f.summary, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g')")) + ", 1, 200) || '" + GROUNDS + "'")}, 1, 200) ELSE f.title || '에 적용되는 법령은?' END"""


def _start(salt: str, ident: str, total: str) -> str:
    """Where on a ring of ``total`` places the walk of ``ident`` begins."""
    return f"CAST('0x' || substr(md5('42:{salt}:' || {ident}), 1, 8) AS BIGINT) % {total}"


_SIX = lambda x: f"CASE WHEN length(CAST({x} AS VARCHAR)) < 6 THEN lpad(CAST({x} AS VARCHAR), 6, '0') ELSE CAST({x} AS VARCHAR) END"
#: Negatives of precedents, the rings written out whole: candidates of each tier with the step at which a case meets them.
_NEGATIVES = f"""laws AS (SELECT id, law_name AS name, law_name || '#' || article_num AS kin FROM target),
ring AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY md5('42:' || id)) - 1 AS pos, count(*) OVER (PARTITION BY name) AS total FROM laws),
says AS (SELECT r.case_id, r.law_name AS name, min(ref_pos) AS pos, CASE WHEN min(article_num) = max(article_num) THEN r.law_name || '#' || min(article_num) END AS sole FROM refs r JOIN cited c ON r.case_id = c.case_id AND outcome = 'ok' GROUP BY r.case_id, r.law_name),
names AS (SELECT name, row_number() OVER (ORDER BY md5('42:' || name)) - 1 AS pos, count(*) OVER () AS total FROM (SELECT DISTINCT name FROM laws)),
others AS (SELECT c.case_id, n.name, (n.pos - {_start("others", "c.case_id", "n.total")} + n.total) % n.total AS pos FROM (SELECT DISTINCT case_id FROM says) c CROSS JOIN names n WHERE NOT EXISTS (SELECT 1 FROM says s WHERE s.case_id = c.case_id AND s.name = n.name)),
candidates AS (SELECT case_id, id, 1 AS tier, s.pos * 1000000 + (r.pos - {_start("tier1", _SIX("s.pos") + " || '#' || case_id", "total")} + total) % total AS step FROM says s JOIN ring r ON s.name = r.name WHERE coalesce(sole <> kin, true)
UNION ALL SELECT case_id, id, 2, o.pos * 1000000 + (r.pos - {_start("any", _SIX("o.pos") + " || '#' || case_id", "r.total")} + r.total) % r.total FROM others o JOIN ring r ON o.name = r.name
UNION ALL SELECT case_id, id, 3, s.pos * 1000000 + (r.pos - {_start("rest", _SIX("s.pos") + " || '#' || case_id", "total")} + total) % total FROM says s JOIN ring r ON s.name = r.name
UNION ALL SELECT c.case_id, k.parent_id || '_' || k.chunk_no, 1, k.chunk_no FROM cited c JOIN chunks k ON c.case_id = k.case_id AND outcome = 'no_matched_passage' AND k.chunk_no > 1
UNION ALL SELECT c.case_id, k.id, 2, (k.pos - {_start("tier1", "c.case_id", "total")} + total) % total FROM (SELECT case_id FROM cited WHERE outcome = 'no_matched_passage' AND case_id IN (SELECT case_id FROM chunks)) c JOIN (SELECT parent_id || '_' || chunk_no AS id, case_id, row_number() OVER (ORDER BY md5('42:' || parent_id || '_' || chunk_no)) - 1 AS pos, count(*) OVER () AS total FROM chunks) k ON c.case_id <> k.case_id),
once AS (SELECT case_id, id, min(tier * 10000000000000 + step) AS spot FROM candidates GROUP BY ALL),
free AS (SELECT o.* FROM once o LEFT JOIN cited c ON o.case_id = c.case_id WHERE NOT coalesce(list_contains(c.positives, o.id), false)),
negatives AS (SELECT case_id, list(id ORDER BY spot, id) AS hard FROM (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY spot, id) <= 2) GROUP BY case_id)"""


@query(f"""{_ALL}, {_CITED}, {_NEGATIVES} SELECT c.case_id, outcome, {_QUERY} AS query_text, CASE WHEN outcome = 'ok' THEN positives WHEN outcome = 'no_matched_passage' AND k.text IS NOT NULL THEN [k.parent_id || '_1'] ELSE [] END AS positive_passages,
CASE WHEN outcome = 'ok' THEN 'prec_to_law_admin' WHEN outcome = 'no_matched_passage' AND k.text IS NOT NULL THEN 'prec_fallback' END AS kind, coalesce(n.hard, []) AS hard_negatives
FROM cited c JOIN fields f ON c.case_id = f.case_id LEFT JOIN chunks k ON c.case_id = k.case_id AND k.chunk_no = 1 LEFT JOIN negatives n ON c.case_id = n.case_id""")
def citation_pairs(spark, d):
    """Queries, positives, and which negatives, of every precedent."""
    laws, rules, fields, chunks = map(cut, parts(spark, d, "statutes", "rules", "fields", "chunks"))  # each is read several times
    held = chunks.select("id", F.substring("parent_id", 6, 100).alias("case_id"), "chunk_no", "title")
    out = precedent_pairs.precedent_pairs(fields, held, *_targets(laws, rules))
    return out.select("case_id", "outcome", "query_text", "positive_passages", F.col("meta.type").alias("kind"), "hard_negatives")


@query(f"""{_ALL}, {_CITED}, held AS (SELECT DISTINCT law_name, article_num, type FROM target), known AS (SELECT law_name, type, list(article_num ORDER BY article_num)[1:5] AS known FROM held GROUP BY ALL)
SELECT r.law_name, r.article_num, r.type, count(DISTINCT case_id) AS cases, CASE WHEN any_value(k.known) IS NULL THEN 'law' ELSE 'article' END AS reason, coalesce(any_value(k.known), []) AS known
FROM refs r LEFT JOIN known k ON r.law_name = k.law_name AND r.type = k.type WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.law_name = r.law_name AND h.article_num = r.article_num AND h.type = r.type) GROUP BY r.law_name, r.article_num, r.type""")
def failed_citations(spark, d):
    """What precedents cite and the passages lack, and why."""
    laws, rules, fields = parts(spark, d, "statutes", "rules", "fields")
    return analysis.failed_citations(fields.select("case_id", "refs"), *_targets(laws, rules))


@query(f"""{_ALL}, {_CITED}, o AS (SELECT c.outcome, count(*) AS cases, count(*) FILTER (WHERE outcome = 'ok' OR (outcome = 'no_matched_passage' AND k.case_id IS NOT NULL)) AS pairs FROM cited c LEFT JOIN chunks k ON c.case_id = k.case_id AND k.chunk_no = 1 GROUP BY c.outcome)
SELECT outcome, cases, pairs, round(CASE WHEN outcome <> 'ok' THEN cases / (SELECT sum(cases) FROM o WHERE outcome <> 'ok') END, 6) AS share FROM o""")
def precedent_outcomes(spark, d):
    """Outcomes of building precedents' pairs, and how the failures divide."""
    laws, rules, fields, chunks = map(cut, parts(spark, d, "statutes", "rules", "fields", "chunks"))
    held = chunks.select("id", F.substring("parent_id", 6, 100).alias("case_id"), "chunk_no", "title")
    counted = analysis.outcome_counts(precedent_pairs.precedent_pairs(fields, held, *_targets(laws, rules)))
    return counted.withColumn("share", F.round("share", 6))


def _said(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '', 'g')"


@query(f"""WITH {_DOCS}, {_LAW}, asked AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, '앞 ' || source || '법 ' || (length(text) % 7 + 1) || '조와 ' || source || '법 제2조의3' AS said FROM docs),
mm AS (SELECT case_id, unnest(regexp_extract_all(said, '{citations.MENTION}', 1)) AS n, unnest(regexp_extract_all(said, '{citations.MENTION}', 2)) AS a, generate_subscripts(regexp_extract_all(said, '{citations.MENTION}', 1), 1) AS m FROM asked),
met AS (SELECT case_id, m, s.id FROM mm JOIN statutes s ON substr({_ws("n")}, 1, 80) = {_strip("law_name")} AND contains({_said("article")}, a) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY m, s.id) <= 2),
l AS (SELECT case_id, list(id ORDER BY m, id) AS added FROM met GROUP BY case_id)
SELECT asked.case_id AS query_id, list_sort(list_distinct(list_concat(['own'], coalesce(added, [])))) AS positives FROM asked LEFT JOIN l ON asked.case_id = l.case_id""")
def cross_positives(spark, d):
    """Every document asks with a text that mentions two statutes, one with words before its name."""
    said = F.concat(F.lit("앞 "), "source", F.lit("법 "), F.length(F.coalesce("text", F.lit(""))) % 7 + 1, F.lit("조와 "), "source", F.lit("법 제2조의3"))
    asked = table(spark, d, "documents").where("source <> 'src1'").select(F.col("doc_id").cast("string").alias("query_id"), said.alias("source_text"), F.array(F.lit("own")).alias("positives"))
    found = citations.cross_positives(asked, parts(spark, d, "statutes")[0].select("id", "law_name", "article"))
    return found.select("query_id", F.sort_array("positives").alias("positives"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS file, total, conv_id || '-' || turn AS case_id, role AS title, CASE role WHEN 'user' THEN '판결' ELSE '' END AS judgment_type
FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) WHERE role <> 'system' AND (role <> 'assistant' OR turn % 2 = 1)""")
def search_responses(spark, d):
    """A conversation is a response, its turns are what was found; one turn alone is no list."""
    kind = F.when(F.col("role") == "user", "판결").when((F.col("role") == "assistant") & (F.col("turn") % 2 == 1), "").otherwise("명령")
    hit = F.struct(F.concat_ws("-", "conv_id", "turn").alias("판례일련번호"), F.col("role").alias("사건명"), kind.alias("판결유형"))
    by = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(hit).alias("l"))
    whole = F.to_json(F.struct(F.struct(F.size("l").cast("string").alias("totalCnt"), F.col("l").alias("prec")).alias("PrecSearch")))
    single = F.to_json(F.struct(F.struct(F.size("l").cast("string").alias("totalCnt"), F.get("l", F.lit(0)).alias("prec")).alias("PrecSearch")))
    raw = F.when(F.size("l") == 1, single).otherwise(whole)
    return legal.search_rows(by.select(F.col("conv_id").cast("string").alias("file"), F.try_parse_json(raw).alias("js")))


@query(f"""WITH {_DOCS}, {_LAW} SELECT law_id, article, any_value(aid) AS id, any_value(law_name) AS law_name, '20200101' AS effective_date,
list_reduce(list({_strip("text")} ORDER BY j), lambda a, x: CASE WHEN x = '' OR contains(a, x) THEN a WHEN a = '' THEN x ELSE a || chr(10) || x END, '') AS text FROM (SELECT *, parent_id AS aid FROM statutes) GROUP BY law_id, article""")
def article_merge(spark, d):
    laws = parts(spark, d, "statutes")[0].withColumn("pos", F.struct("file", "rec_no", "a_pos", "p_pos", "i_pos"))
    return article_passages(laws, ["law_id", "article"], "pos")


@query("SELECT CASE WHEN source = 'src1' THEN 'invalid_json' WHEN source = 'src0' THEN 'list_top' WHEN lang IN ('en', 'de') THEN 'dict_other' WHEN lang = 'fr' THEN 'dict_flat' ELSE 'dict_PrecService' END AS shape, count(*) AS files FROM documents GROUP BY 1")
def shape_census(spark, d):
    return reports.shape_census(files(spark, d))


@query(f"""{_ALL}, own AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM statutes UNION ALL SELECT doc_id FROM rules UNION ALL SELECT doc_id FROM chunks) GROUP BY 1),
t AS (SELECT doc_id, CASE WHEN source = 'src1' THEN 'unknown' WHEN lang = 'en' THEN 'law' WHEN lang = 'de' THEN 'admin' ELSE 'prec' END AS type FROM documents)
SELECT type, count(*) AS files, count(*) FILTER (WHERE n IS NULL) AS empty, CAST(coalesce(sum(n), 0) AS BIGINT) AS passages FROM t LEFT JOIN own ON t.doc_id = own.doc_id GROUP BY type""")
def file_counts(spark, d):
    held = parts(spark, d, "statutes", "rules", "chunks")
    every = held[0].select("file").unionAll(held[1].select("file")).unionAll(held[2].select("file"))
    return reports.file_counts(files(spark, d), every)


@query(f"""{_ALL} SELECT source, count(*) AS n FROM (SELECT '법령' AS source FROM statutes UNION ALL SELECT CASE type WHEN '행정규칙' THEN '행정규칙' ELSE '기타' END FROM rules UNION ALL SELECT '판례' FROM chunks) GROUP BY source""")
def passage_sources(spark, d):
    held = parts(spark, d, "statutes", "rules", "chunks")
    every = held[0].select("id", "type").unionAll(held[1].select("id", "type")).unionAll(held[2].select("id", "type"))
    return every.groupBy(reports.passage_source(F.col("id"), F.col("type")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
