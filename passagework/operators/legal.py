"""Flattening statutes, administrative rules and precedents into passages; type detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import text as X
from passagework.functions import variant as V
from passagework.operators.chunks import chunk_rows

# Fixed values of the source formats.
PREC_KEYS = ("판례일련번호", "판결요지", "판시사항", "사건명", "법원명")
PREC_SERVICE_KEYS = ("판례기본정보", "판결요지", "판시사항", "판결본문")
PREC_LIST_KEYS = ("판례목록", "precList", "prec_list")
JUDGMENTS = ("판결", "판결 : 확정", "결정")
DELETED = "삭제"
HEADER = r"^제\s*(\d+)\s*조(?:\(([^)]*)\))?"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: A string of JSON text and, if it is a key, its colon; the loop is possessive and doesn't recurse.
JSON_STRING = r'"(?:[^"\\]++|\\.)*+"\s*+:?'


def _has(v: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | V.at(v, k).isNotNull()
    return out


def _object_type(v: Column) -> Column:
    service = V.at(v, "PrecService")
    return (
        F.when(_has(v, ("법령", "법령ID")), "law")
        .when(_has(v, ("AdmRulService",)) | F.contains(F.to_json(v), F.lit("행정규칙기본정보")), "admin")
        .when(_has(v, PREC_KEYS) | _has(service, PREC_SERVICE_KEYS) | _has(v, PREC_LIST_KEYS), "prec")
        .otherwise("unknown")
    )


def detect_type(v: Column) -> Column:
    """law, admin, prec or unknown; a list has its first member's type."""
    first = F.get(V.members(v), F.lit(0))
    return F.when(V.is_object(v), _object_type(v)).when(V.is_array(v) & V.is_object(first), _object_type(first)).otherwise("unknown")


def records(files: DataFrame) -> DataFrame:
    """file, rec_no, type, js: one row an object; arrays of objects are taken apart."""
    typed = files.select("file", detect_type(F.col("js")).alias("type"), "js")
    return typed.select("file", "type", F.posexplode(V.members(F.col("js"))).alias("rec_no", "js"))


def deleted(text: Column, anchored: bool = False) -> Column:
    """Repealed: empty, or with the mark anywhere (or, ``anchored``, at the start only)."""
    mark = text.rlike(rf"^\(?{DELETED}\)?") if anchored else F.contains(text, F.lit(DELETED))
    return (text == "") | mark


def article_label(number: Column) -> Column:
    n = X.py_strip(number)
    whole = F.startswith(n, F.lit("제")) & F.endswith(n, F.lit("조"))
    return F.when(whole, n).when(n != "", F.concat(F.lit("제"), n, F.lit("조"))).otherwise("")


def _objects(**fields: str) -> str:
    """A pattern of ``schema_of_variant`` of a list of objects of these fields, any of which may lack."""
    return "ARRAY<OBJECT<" + "".join(f"(`?{name}`?: {kind}(, |(?=>)))?" for name, kind in sorted(fields.items())) + ">>"


_ITEMS = {"호번호": "STRING", "호내용": "STRING"}
_PARAGRAPHS = {"항번호": "STRING", "항내용": "STRING", "호": _objects(**_ITEMS)}
#: The articles of a regular statute: lists of objects of strings alone, and what they are read as.
REGULAR = "^" + _objects(**{"조문번호": "STRING", "조문내용": "STRING", "조문시행일자": "STRING", "항": _objects(**_PARAGRAPHS)}) + "$"
REGULAR_TYPE = "array<struct<`조문번호`:string,`조문내용`:string,`조문시행일자`:string,`항`:array<struct<`항번호`:string,`항내용`:string,`호`:array<struct<`호번호`:string,`호내용`:string>>>>>>"


def _articles(js: Column, law: Column, wrapped: Column) -> Column:
    """The articles of a statute as structs of number, effective_date, body and raw, its paragraphs (no,
    text, items); null for what is no object.  Those of a regular statute are read by one cast of the
    whole list, all others member by member."""
    held = F.when(wrapped, V.at(V.at(law, "조문"), "조문단위")).otherwise(V.at(js, "조문"))
    regular = V.let(held, lambda x: F.when(V.kind(x).rlike(REGULAR), F.try_variant_get(x, "$", REGULAR_TYPE)))
    every = F.when(wrapped, V.members(V.pick(V.at(law, "조문"), "조문단위"))).otherwise(V.members_picked(js, "조문", "articles"))
    return V.let(regular, lambda x: F.coalesce(F.transform(x, _regular_article), F.transform(F.when(x.isNull(), every), lambda a: F.when(V.is_object(a), _article(a)))))


def _filled(no: Column, place: Column) -> Column:
    return X.py_strip(F.coalesce(F.nullif(no, F.lit("")), (place + 1).cast("string")))


def _regular_article(a: Column) -> Column:
    """As ``_article``; a text that lacks is its number, the only other string."""

    def item(i: Column, k: Column) -> Column:
        return F.struct(_filled(i["호번호"], k).alias("no"), F.coalesce(i["호내용"], i["호번호"], F.lit("")).alias("text"))

    def paragraph(p: Column, j: Column) -> Column:
        inner = F.coalesce(F.transform(p["호"], item), F.array().cast("array<struct<no:string,text:string>>"))
        return F.struct(_filled(p["항번호"], j).alias("no"), F.coalesce(p["항내용"], p["항번호"], F.lit("")).alias("text"), inner.alias("items"))

    raw = F.coalesce(F.transform(a["항"], paragraph), F.array().cast("array<struct<no:string,text:string,items:array<struct<no:string,text:string>>>>"))
    said = lambda c: F.coalesce(c, F.lit(""))
    made = F.struct(X.py_strip(said(a["조문번호"])).alias("number"), said(a["조문시행일자"]).alias("effective_date"), said(a["조문내용"]).alias("body"), raw.alias("raw"))
    return F.when(a.isNotNull(), made)


def _article(a: Column) -> Column:
    def item(i: Column, k: Column) -> Column:
        return V.let(V.is_object(i), lambda own: _item(i, k, own))

    def _item(i: Column, k: Column, own: Column) -> Column:
        no = F.coalesce(F.when(own, V.string(V.pick(i, "호번호", "item_no"))), (k + 1).cast("string"))
        said = V.coerce_text(F.when(own, F.coalesce(V.pick(i, "호내용", "item_text"), i)).otherwise(i))
        return F.struct(X.py_strip(no).alias("no"), said.alias("text"))

    def paragraph(p: Column, j: Column) -> Column:
        return V.let(V.is_object(p), lambda own: _paragraph(p, j, own))

    def _paragraph(p: Column, j: Column, own: Column) -> Column:
        place = (j + 1).cast("string")
        no = F.when(own, X.py_strip(F.coalesce(V.string(V.pick(p, "항번호", "paragraph_no")), place))).otherwise(place)
        said = V.coerce_text(F.when(own, F.coalesce(V.pick(p, "항내용", "paragraph_text"), p)).otherwise(p))
        inner = F.when(own, V.members_at(p, "호")).otherwise(F.array().cast("array<variant>"))
        return F.struct(no.alias("no"), said.alias("text"), F.transform(inner, item).alias("items"))

    return F.struct(
        X.py_strip(V.text_at(a, "조문번호", "article_no")).alias("number"),
        V.text_at(a, "조문시행일자", "effective_date").alias("effective_date"),
        V.coerce_text(V.pick(a, "조문내용", "article_text")).alias("body"),
        F.transform(V.members_at(a, "항"), paragraph).alias("raw"),
    )


def statutes(laws: DataFrame, include_items: bool = False, anchored: bool = False) -> DataFrame:
    """Passages of statutes (file, rec_no, js): articles without paragraphs, else paragraphs with
    their items (or, with ``include_items``, the items alone)."""
    js = F.col("js")
    law, info = V.at(js, "법령"), V.at(V.at(js, "법령"), "기본정보")
    wrapped = law.isNotNull()
    heads = laws.select(
        "file", "rec_no",
        X.zfill(F.when(wrapped, V.text_at(info, "법령ID")).otherwise(V.text_at(js, "법령ID", "law_id")), 6).alias("law_id"),
        F.when(wrapped, V.text_at(info, "법령명_한글", "법령명")).otherwise(V.text_at(js, "법령명", "law_name")).alias("law_name"),
        F.posexplode(_articles(js, law, wrapped)).alias("a_pos", "a"),
    )
    # an article is one row throughout: its paragraphs and items stay in it as arrays
    keys = ["file", "rec_no", "a_pos", "law_id", "law_name"]
    articles = heads.select(*keys, "a.number", "a.effective_date", "a.body", "a.raw").where("number <> ''")
    # its texts as groups: the body alone, then each paragraph's text before those of its items
    said = F.concat(F.array(F.array("body")), F.transform("raw", lambda p: F.concat(F.array(p["text"]), F.transform(p["items"], lambda i: i["text"]))))
    texts = articles.withColumn("said", said).withColumn("said", X.normalize_groups(F.col("said")))

    def items_of(p: Column, j: Column) -> Column:
        made = F.transform(p["items"], lambda i, k: F.struct(k.alias("i_pos"), i["no"].alias("i_no"), F.get(F.get("said", j + 1), k + 1).alias("i_text")))
        return F.filter(made, lambda x: x["i_text"] != "")

    paras = F.transform("raw", lambda p, j: F.struct(j.alias("p_pos"), p["no"].alias("p_no"), F.get(F.get("said", j + 1), F.lit(0)).alias("p_text"), items_of(p, j).alias("items")))
    by_article = texts.select(
        *keys, "effective_date", article_label(F.col("number")).alias("article"), F.get(F.get("said", F.lit(0)), F.lit(0)).alias("body"),
        F.filter(paras, lambda x: x["p_text"] != "").alias("paras"),
    )
    article_id = F.concat(F.lit("LAW_"), F.col("law_id"), F.lit("_"), F.col("article"))

    def row(ident: Column, parent: Column, text: Column, para: Column, item: Column) -> Column:
        return F.struct(ident.alias("id"), parent.alias("parent_id"), text.alias("text"), para.cast("int").alias("p_pos"), item.cast("int").alias("i_pos"))

    def of_para(x: Column) -> Column:
        ident = F.concat(article_id, F.lit("_"), x["p_no"])
        live = F.filter(x["items"], lambda y: ~deleted(y["i_text"], anchored))
        joined = F.when(F.size(live) > 0, F.concat(x["p_text"], F.lit(" "), F.array_join(F.transform(live, lambda y: y["i_text"]), " "))).otherwise(x["p_text"])
        whole = F.array(row(ident, article_id, joined, x["p_pos"], F.lit(0)))
        if not include_items:
            return whole
        each = F.transform(live, lambda y: row(F.concat(ident, F.lit("_"), y["i_no"]), ident, y["i_text"], x["p_pos"], y["i_pos"]))
        return F.when(F.size(x["items"]) > 0, each).otherwise(whole)

    alone = F.array(row(article_id, article_id, F.col("body"), F.lit(0), F.lit(0)))
    empty = F.slice(alone, 1, 0)
    rows = F.when((F.size("paras") == 0) & ~deleted(F.col("body"), anchored), alone).otherwise(
        F.coalesce(F.flatten(F.transform(F.filter("paras", lambda x: ~deleted(x["p_text"], anchored)), of_para)), empty)
    )
    out = by_article.select("file", "rec_no", "a_pos", "law_id", "law_name", "article", "effective_date", F.explode(rows).alias("r"))
    return out.select("r.id", "r.parent_id", F.lit("법령").alias("type"), "law_id", "law_name", "article", "effective_date", "r.text", "file", "rec_no", "a_pos", "r.p_pos", "r.i_pos")


def flatten_blocks(texts: Column) -> Column:
    """Strings of nested JSON of any depth, in order and stripped, empty ones dropped; none of a null.

    Those of the text that no colon follows; they are read as one flat list."""
    held = F.filter(F.regexp_extract_all(texts, F.lit(JSON_STRING), 0), lambda x: ~F.endswith(x, F.lit(":")))
    said = F.from_json(F.concat(F.lit("["), F.array_join(held, ","), F.lit("]")), "array<string>")
    return F.coalesce(F.filter(F.transform(said, X.py_strip), lambda x: x != ""), F.array().cast("array<string>"))


def lines_of(v: Column, raw: Column) -> Column:
    """A string's lines, or the strings of nested lists; ``raw`` is ``v`` as JSON (null for a string)."""
    return F.when(V.is_string(v), F.split(V.string(v), LINE_END)).otherwise(flatten_blocks(raw))


def rule_passages(rules: DataFrame, number_appendices: bool = False) -> DataFrame:
    """Passages of administrative rules (file, rec_no, js): articles by header lines, appendices.

    Appendix ids name the branch number only, as the source format has it; ``number_appendices``
    adds the appendix's own number, so that they don't collide.
    """
    service = V.at(F.col("js"), "AdmRulService")
    info = V.at(service, "행정규칙기본정보")
    number = F.coalesce(F.nullif(V.text_at(info, "행정규칙일련번호", "행정규칙ID"), F.lit("")), F.lit("0"))
    heads = rules.select(
        "file", "rec_no", X.zfill(number, 10).alias("rule_id"), V.text_at(info, "행정규칙명", "제목").alias("rule_name"),
        V.text_at(info, "시행일자", "발령일자", "제정일자").alias("effective_date"), V.pick(service, "조문내용").alias("clauses"), V.at(service, "별표").alias("appx"),
    )
    named = ["file", "rec_no", "rule_id", "rule_name", "effective_date"]
    # the clauses go through an explode, so that filters below don't take them out of the variant again
    whole = heads.select(*named, F.explode(F.array(F.struct("clauses", F.when(~V.is_string(F.col("clauses")), F.to_json("clauses")).alias("raw")))).alias("c"))
    lines = whole.withColumn("lines", lines_of(F.col("c.clauses"), F.col("c.raw"))).withColumn("lines", F.transform("lines", X.py_strip))
    starts = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(HEADER), i)), lambda i: i.isNotNull())
    cut = lines.withColumn("starts", starts).select(*named, "lines", "starts", F.posexplode("starts").alias("k", "start"))
    head = F.get("lines", F.col("start"))
    until = F.coalesce(F.get("starts", F.col("k") + 1), F.size("lines"))
    rest = X.py_strip(F.regexp_replace(head, HEADER, ""))
    body = X.join_lines(F.concat(F.array(rest), F.slice("lines", F.col("start") + 2, until - F.col("start") - 1)))
    label = F.concat(F.lit("제"), F.regexp_extract(head, HEADER, 1), F.lit("조"))
    articles = cut.select(*named, label.alias("article"), F.regexp_extract(head, HEADER, 2).alias("title"), body.alias("text"), F.col("k").alias("pos")).where("text <> ''")
    article_id = F.concat(F.lit("ADM_"), F.col("rule_id"), F.lit("_"), F.col("article"))
    articles = articles.select(article_id.alias("id"), article_id.alias("parent_id"), F.lit("행정규칙").alias("type"), "*")
    x, u = F.col("x"), F.col("w.u")
    each = heads.select(*named, F.posexplode(V.members(F.col("appx"))).alias("x_pos", "x")).where(V.is_object(x))
    # the content goes through the explode as text, so that filters below don't write it again
    held = F.transform(V.members(F.coalesce(V.at(x, "별표단위"), x)), lambda y: F.struct(y.alias("u"), F.to_json(V.pick(y, "별표내용", "내용")).alias("raw")))
    units = each.select(*named, "x_pos", F.posexplode(held).alias("u_pos", "w")).where(V.is_object(u))
    parts = units.select(*named, "x_pos", "u_pos", V.text_at(u, "별표제목", "제목").alias("appendix_title"), V.text_at(u, "별표번호", "번호").alias("appendix_no"), V.text_at(u, "별표가지번호", "가지번호").alias("branch"), X.join_lines(flatten_blocks(F.col("w.raw"))).alias("text"))
    own = F.concat(F.col("appendix_no"), F.lit("-")) if number_appendices else F.lit("")
    parent = F.concat(F.lit("ADM_"), F.col("rule_id"), F.lit("_APPX_"), own, F.when(F.col("branch") != "", F.col("branch")).otherwise("0"))
    appendices = parts.where("text <> ''").select(F.concat(parent, F.lit("_1")).alias("id"), parent.alias("parent_id"), F.lit("행정규칙-별표").alias("type"), *named, "appendix_no", "appendix_title", "text", (F.lit(1_000_000) + F.col("x_pos") * 1000 + F.col("u_pos")).alias("pos"))
    return articles.unionByName(appendices, allowMissingColumns=True)


def unwrapped(js: Column) -> Column:
    """A precedent's own object, in or out of its wrappers."""
    inner = F.coalesce(V.at(js, "판례"), V.at(js, "PrecService"))
    return F.when(V.is_object(inner), inner).otherwise(js)


def precedent_fields(precs: DataFrame, judged_only: bool = False) -> DataFrame:
    """The flat fields of precedents (file, rec_no, js), all strings; ``judged_only`` keeps those of
    an accepted kind of judgment."""
    p = unwrapped(F.col("js"))
    fields = {
        "case_id": ("판례일련번호", "case_id", "id"), "title": ("사건명", "title"), "case_number": ("사건번호", "case_number"), "court_name": ("법원명", "court_name"),
        "judgment_date": ("선고일자", "judgment_date"), "judgment_type": ("판결유형", "판결종류"), "headnote": ("판시사항", "headnote"), "summary": ("판결요지", "summary"),
        "body": ("판결본문", "text"), "refs": ("참조조문", "ref_law"), "source": ("source",),
    }
    out = precs.select("file", "rec_no", *[V.text_at(p, *keys).alias(name) for name, keys in fields.items()])
    out = out.withColumn("case_id", X.zfill(F.coalesce(F.nullif("case_id", F.lit("")), F.lit("000000")), 6))
    return out.where(X.py_strip(F.col("judgment_type")).isin(*JUDGMENTS)) if judged_only else out


def precedent_passages(fields: DataFrame, min_len: int = 50, size: int = 1200, overlap: int = 200, prefer_body: bool = True) -> DataFrame:
    """Chunks of the body; of head-note and summary where there is none (and they are long enough)."""
    alt = X.normalize_whitespace(F.concat("headnote", F.lit("\n"), "summary"))
    body = X.normalize_whitespace(F.col("body")) if prefer_body else F.lit("")
    held = fields.withColumn("_b", body).withColumn("_a", alt)
    held = held.withColumn("_t", F.when(F.col("_b") != "", F.col("_b")).when(F.length("_a") >= min_len, F.col("_a")).otherwise(""))
    cut = chunk_rows(held, F.col("_t"), size, overlap, min_len=min_len, distinct=True)
    base = F.concat(F.lit("PREC_"), F.col("case_id"))
    return cut.select(
        F.concat(base, F.lit("_"), F.col("chunk_no")).alias("id"), base.alias("parent_id"), "source", F.lit("판례").alias("type"), "title", "case_number", "court_name", "judgment_date",
        X.py_strip(F.col("chunk")).alias("text"), X.short(F.col("headnote"), 1000).alias("headnote"), X.short(F.col("summary"), 1000).alias("summary"), F.array(F.lit("판례")).alias("tags"), "file", "rec_no", "chunk_no",
    )


def search_rows(js: DataFrame) -> DataFrame:
    """file, total, case_id, title, judgment_type of paged search responses in any of their shapes;
    rows of another kind of judgment are dropped, those without one are kept."""
    v = F.col("js")
    result, service = V.at(v, "검색결과"), V.at(v, "PrecSearch")
    found = (
        F.when(V.at(v, "total").isNotNull(), V.at(v, "prec")).when(result.isNotNull(), F.coalesce(V.at(result, "판례"), V.at(result, "prec")))
        .when(service.isNotNull(), V.at(service, "prec")).when(V.is_array(v), v).otherwise(F.coalesce(V.at(v, "list"), V.at(v, "items")))
    )
    total = X.alias(V.string(V.at(v, "total")), V.text_at(result, "총건수", "total"), V.text_at(service, "totalCnt", "total"))
    rows = js.select("file", F.coalesce(F.when(total != "", total.cast("long")), F.lit(0)).alias("total"), F.explode(V.members(found)).alias("p")).where(V.is_object(F.col("p")))
    p = F.col("p")
    out = rows.select("file", "total", X.py_strip(V.text_at(p, "판례일련번호", "ID", "id")).alias("case_id"), X.py_strip(V.text_at(p, "사건명", "title")).alias("title"), X.py_strip(V.text_at(p, "판결유형", "판결종류")).alias("judgment_type"))
    return out.where((F.col("case_id") != "") & ((F.col("judgment_type") == "") | F.col("judgment_type").isin(*JUDGMENTS)))
