from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from passagework.functions import variant as V
from passagework.operators import citations, legal, pairs, precedent_pairs
from passagework.sources import tables
from passagework.streaming import ingest
from tests import legal_records as L


def rows(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_types(spark):
    assert rows(L.files(spark).select("file", legal.detect_type(F.col("js")).alias("type")), "file", "type") == {
        ("law_flat", "law"), ("law_wrapped", "law"), ("rule_text", "admin"), ("rule_nested", "admin"), ("prec_body", "prec"), ("prec_wrapped", "prec"), ("prec_list", "prec"), ("search", "unknown"), ("other", "unknown"),
    }


def test_statutes(spark):
    assert rows(L.parts(spark)[0], "id", "parent_id") == {
        ("LAW_001706_제750조", "LAW_001706_제750조"), ("LAW_001706_제751조_①", "LAW_001706_제751조"), ("LAW_001706_제752조_1", "LAW_001706_제752조"), ("LAW_001706_제753조_1", "LAW_001706_제753조"), ("LAW_000012_제355조_1", "LAW_000012_제355조"),
    }
    text = {r["id"]: r["text"] for r in L.parts(spark)[0].collect()}
    assert text["LAW_001706_제753조_1"] == "다음 각 호의 경우에는 첫째 경우"


def test_items(spark):
    found = rows(legal.statutes(legal.records(L.files(spark)).where("type = 'law'"), include_items=True), "id", "parent_id")
    assert ("LAW_001706_제753조_1_1", "LAW_001706_제753조_1") in found
    assert ("LAW_001706_제753조_1", "LAW_001706_제753조") not in found


def test_rules(spark):
    found = {r["id"]: (r["title"], r["text"]) for r in L.parts(spark)[1].collect()}
    assert found["ADM_0000000021_제1조"] == ("목적", "이 규칙은 안전을 정한다.\n둘째 줄")
    assert found["ADM_0000000007_제1조"] == ("적용", "본문이다.\n이어지는 줄\n더 깊은 줄")
    assert found["ADM_0000000021_APPX_00_1"][1] == "┌─┐\n│가│"
    assert len(found) == 4


def test_precedents(spark):
    found = L.parts(spark)[3].orderBy("id").collect()
    assert [(r["id"], len(r["text"])) for r in found] == [("PREC_000077_1", 52), ("PREC_149920_1", 1200), ("PREC_149920_2", 1200), ("PREC_149920_3", 439)]


def test_precedent_pairs(spark):
    laws, rules, fields, chunks = L.parts(spark)
    held = chunks.select("id", F.substring("parent_id", 6, 100).alias("case_id"), "chunk_no", "title")
    found = {r["case_id"]: r for r in precedent_pairs.precedent_pairs(fields, held, laws.select("id", "law_name", "article"), rules.where("article is not null").select("id", "rule_name", "article")).collect()}
    ok, back = found["149920"], found["000077"]
    assert ok["positive_passages"] == ["LAW_001706_제750조", "ADM_0000000021_제1조"]
    assert ok["query_text"] == "불법행위의 성립요건에 대한 법적 판단은?"
    assert len(ok["hard_negatives"]) == 2 and not set(ok["positive_passages"]) & set(ok["hard_negatives"])
    assert back["meta"]["type"] == "prec_fallback" and back["positive_passages"] == ["PREC_000077_1"]


def test_cited_negatives_in_tiers(spark):
    laws = [(f"A{i}", "가법", str(i)) for i in range(3)] + [("B0", "나법", "1"), ("C0", "다법", "1")]
    pool = spark.createDataFrame(laws, "id string, name string, article_num string")
    cases = spark.createDataFrame([("c", "가법 제1조", ["A1"]), ("d", "가법 제1조, 나법 제1조, 다법 제1조", ["A1"]), ("e", "라법 제2조", [])], "case_id string, refs string, positives array<string>")
    found = {r["pair"]: r["hard_negatives"] for r in precedent_pairs.cited_negatives(cases, pool, 4, 5).collect()}
    assert set(found["c"][:2]) == {"A0", "A2"} and set(found["c"][2:]) == {"B0", "C0"}  # its law's other articles first
    assert set(found["d"][:2]) == {"A0", "A2"} and set(found["d"]) == {"A0", "A2", "B0", "C0"}
    assert len(found["e"]) == 4


def test_cross_positives(spark):
    laws = spark.createDataFrame([("L1", " 민법 ", "제750조"), ("L2", "민법", "제751조"), ("L3", "민법", "제75조의2"), ("L4", "상법", None)], "id string, law_name string, article string")
    asked = spark.createDataFrame([("q1", "민법 제750조, 민법 751조", ["p"]), ("q2", "민법 75조", ["p"]), ("q3", "상법 제1조", ["p"]), ("q4", None, ["p"]), ("q5", "민법 제750조 및 민법 제750조", ["L1"])], "query_id string, source_text string, positives array<string>")
    found = {r["query_id"]: r["positives"] for r in citations.cross_positives(asked, laws).collect()}
    assert found == {"q1": ["p", "L1", "L2"], "q2": ["p", "L1", "L2"], "q3": ["p"], "q4": ["p"], "q5": ["L1"]}


def test_precedent_passages_stand_for_themselves(spark):
    rows = [(f"P{i}", f"case{i}", "court" if i < 4 else None, f"title {i}", "head", None, "x" * 60) for i in range(8)]
    passages = spark.createDataFrame(rows, "id string, parent_id string, court_name string, title string, headnote string, summary string, text string")
    found = {r["pair"]: r for r in pairs.precedent_self_pairs(passages, 2).collect()}
    assert len(found) == 8 and found["P1"]["meta"]["type"] == "prec" and found["P1"]["source_text"] == "head " + "x" * 60
    assert set(found["P1"]["hard_negatives"]) <= {"P0", "P2", "P3"} and found["P1"]["query_text"] == "title 1의 요지는 무엇인가?"


def test_search_shapes(spark):
    shapes = [{"total": 2, "prec": [{"ID": "1"}]}, {"검색결과": {"총건수": 3, "판례": [{"id": "2"}]}}, {"PrecSearch": {"totalCnt": "4", "prec": {"ID": 3}}}, [{"ID": "4"}], {"list": [{"ID": "5", "판결유형": "명령"}, {"ID": "6", "판결유형": "결정"}]}]
    js = spark.createDataFrame([(str(i), json.dumps(s, ensure_ascii=False)) for i, s in enumerate(shapes)], "file string, raw string").select("file", F.try_parse_json("raw").alias("js"))
    assert rows(legal.search_rows(js), "file", "total", "case_id") == {("0", 2, "1"), ("1", 3, "2"), ("2", 4, "3"), ("3", 0, "4"), ("4", 0, "6")}


@pytest.mark.parametrize(("value", "text"), [("x", "x"), (["a", 1, "b"], "a b"), ({"내용": "c", "z": "d"}, "c"), ({"y": "e", "z": "f"}, "e f"), (3, ""), (None, "")])
def test_coerce_text(spark, value, text):
    assert spark.range(1).select(V.coerce_text(F.parse_json(F.lit(json.dumps(value))))).first()[0] == text


def test_question_wordings(spark):
    lit = F.lit
    q = spark.range(1).select(
        pairs.query_law(lit("민법"), lit("제1조"), lit("목적")), pairs.query_law(lit("민법"), lit("제1조"), lit("")), pairs.query_law(lit("민법"), lit(""), lit("x")),
        pairs.query_rule(lit("규칙"), lit(""), lit(""), lit("표")), pairs.query_precedent_passage(lit(""), lit(""), lit("")), pairs.query_precedent(lit(""), lit(""), lit("사건")),
    ).first()
    assert list(q) == ["민법 제1조(목적)의 내용은 무엇인가?", "민법 제1조의 내용은 무엇인가?", "민법 관련 내용은 무엇인가?", "규칙의 '표' 별표 내용은 무엇인가?", "이 판례의 요지는 무엇인가?", "사건에 적용되는 법령은?"]


def test_files_and_rejects(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_text(json.dumps(L.RECORDS["law_flat"], ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text("{broken", encoding="utf-8")
    good, bad = tables.read_json_files(spark, str(tmp_path))
    assert (good.count(), bad.count()) == (1, 1)
    with gzip.open(tmp_path / "c.jsonl.gz", "wt", encoding="utf-8") as out:
        out.write('{"id": "1", "text": "x"}\n\n{"id": "1", "text": "y"}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "c.jsonl.gz"), "id string, text string").count() == 2
    (tmp_path / "d.txt").write_text("z" * 1300)
    assert rows(tables.read_texts(spark, str(tmp_path)), "id") == {("d::p0000",), ("d::p0001",)}
    with pytest.raises(ValueError):
        tables.corpus_texts(spark.createDataFrame([], "id string, text string"))
    tables.write_jsonl(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_incremental_ingest(spark, tmp_path):
    folder, out, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    (tmp_path / "in").mkdir()

    def put(name):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(L.RECORDS[name], ensure_ascii=False), encoding="utf-8")

    def run():
        ingest.ingest(spark, folder, out, point).awaitTermination(120)
        return spark.read.parquet(out).count()

    put("law_flat")
    assert run() == 4
    put("rule_text")
    assert run() == 7
    assert run() == 7
