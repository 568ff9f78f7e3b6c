"""Authored records of each source shape, and the flatteners over them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators import legal

LONG = "피고인이 위 법률을 위반하여 타인의 재산을 침해한 사실이 인정되고 그 손해를 배상할 책임이 있다고 판단한다. " * 40

RECORDS = {
    "law_flat": {"법령ID": "1706", "법령명": "민법", "조문": [
        {"조문번호": "750", "조문내용": "고의 또는 과실로 인한 위법행위로 타인에게 손해를 가한 자는 그 손해를 배상할 책임이 있다. 이 조항은 불법행위의 일반 원칙이다.", "조문시행일자": "20200101"},
        {"조문번호": "제751조", "조문내용": "", "항": [{"항번호": "①", "항내용": "타인의 신체, 자유 또는 명예를 해하거나 기타 정신상 고통을 가한 자는 재산 이외의 손해에 대하여도 배상할 책임이 있다."}, {"항번호": "②", "항내용": "삭제 <2010.1.1>"}]},
        {"조문번호": "752", "조문내용": "본문", "항": ["생명침해로 인한 위자료에 관한 첫째 항의 내용이다. 직계존속, 직계비속 및 배우자에 대하여 손해배상의 책임이 있다.", ""]},
        {"조문번호": "753", "항": {"항번호": "1", "항내용": "다음 각 호의 경우에는", "호": [{"호번호": "1", "호내용": "첫째 경우"}, {"호번호": "2", "호내용": "(삭제)"}]}},
    ]},
    "law_wrapped": {"법령": {"기본정보": {"법령ID": 12, "법령명_한글": "형법"}, "조문": {"조문단위": {"조문번호": "355", "항": [{"항내용": "타인의 재물을 보관하는 자가 그 재물을 횡령하거나 그 반환을 거부한 때에는 처벌한다. 이 규정은 횡령과 배임에 관한 것이다.", "호": "단일 호"}]}}}},
    "rule_text": {"AdmRulService": {"행정규칙기본정보": {"행정규칙일련번호": "21", "행정규칙명": "산업안전보건기준에 관한 규칙", "시행일자": "20210101"}, "조문내용": "제1장 총칙\n제1조(목적) 이 규칙은 안전을 정한다.\n둘째 줄\n제2조 정의는 다음과 같다.", "별표": {"별표단위": [{"별표번호": "1", "별표가지번호": "00", "별표제목": "표 하나", "별표내용": [["┌─┐", "│가│"]]}, {"별표번호": "2", "별표내용": []}]}}},
    "rule_nested": {"AdmRulService": {"행정규칙기본정보": {"행정규칙ID": 7, "행정규칙명": "고용 지침"}, "조문내용": [["제1조(적용) 본문이다."], ["이어지는 줄", ["더 깊은 줄"]]]}},
    "prec_body": {"판례일련번호": "149920", "사건명": "손해배상", "사건번호": "2019다1", "법원명": "대법원", "선고일자": "20190101", "판결유형": "판결", "판시사항": "[1] 불법행위의 성립요건<br/>[2] 배상의 범위", "판결요지": "", "판결본문": LONG[:2900], "참조조문": "[1]민법 제750조 / [2]산업안전보건기준에 관한 규칙 제1조"},
    "prec_wrapped": {"PrecService": {"판례일련번호": "77", "사건명": "횡령", "판결유형": "결정", "판결요지": "횡령죄의 성립에 관한 판단과 그 근거를 설시한 사안으로서 보관자의 지위에 관한 법리를 밝힌다.", "참조조문": "상법 제999조"}},
    "prec_list": [{"판례일련번호": "5", "사건명": "명예훼손", "판결유형": "기타", "판시사항": "쟁점", "참조조문": ""}],
    "search": {"PrecSearch": {"totalCnt": "3", "prec": [{"판례일련번호": "1", "사건명": "가"}, {"판례일련번호": "2", "사건명": "나", "판결종류": "명령"}, {"판례일련번호": "3", "판결유형": "판결"}]}},
    "other": {"x": 1},
}


def files(spark: SparkSession, *names: str) -> DataFrame:
    """The records as (file, js)."""
    chosen = {k: v for k, v in RECORDS.items() if not names or k in names}
    rows = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in chosen.items()], "file string, raw string")
    return rows.select("file", F.try_parse_json("raw").alias("js"))


def parts(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Statutes, rules, fields of precedents and their chunks."""
    typed = legal.records(files(spark))
    fields = legal.precedent_fields(typed.where("type = 'prec'"), judged_only=True)
    return legal.statutes(typed.where("type = 'law'")), legal.rule_passages(typed.where("type = 'admin'")), fields, legal.precedent_passages(fields)
