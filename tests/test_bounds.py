"""What keeps Python's memory and the shuffles of the flatteners in bounds."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from passagework.cluster import ship
from passagework.functions import text as X
from passagework.functions import variant as V
from passagework.operators import corpus, encode, legal
from passagework.plans import legal_queries


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_stays_under_nfkc(spark):
    changes = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", X.changing()))
    stays = [chr(c) for c in range(0xD800) if not changes.search(chr(c))]
    assert len(stays) > 40_000
    assert all(unicodedata.is_normalized("NFKC", c) and not unicodedata.combining(c) for c in stays)
    assert unicodedata.is_normalized("NFKC", "".join(stays)) and unicodedata.is_normalized("NFKC", "".join(reversed(stays)))
    texts = ["plain", "déjà vu à Zürich «non» – “oui” ’", "法律 한글 かな Ελλάς", "e\u0301", "\ufb01n", "가\u11a8", "a\u00a0b", "１２", "𝐀", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", X.nfkc_stays(F.col("t")).alias("stays"), X.nfkc(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert [r["stays"] for r in rows] == [True] * 3 + [False] * 6 + [None]


def test_whole_texts_are_matched_fast():
    """What says that NFKC changes nothing is one loop of possessive runs, common ranges first (F13 to F16)."""
    pattern = X.unchanged()
    assert pattern.startswith(r"\A(?:[\x{0}-\x{9f}]++|") and pattern.endswith(r"]++)*+\z")
    assert all(part.count("-") == 1 for part in pattern.split("|")[:-1])
    mine = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern).replace(r"\z", r"\Z"))
    changes = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", X.changing()))
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]):
        assert bool(mine.match(f"a{c}é")) != bool(changes.search(c))


def test_long_texts_do_not_overflow(spark):
    text = "é법a漢 " * 200_000
    df = spark.createDataFrame([(text,), (text + "\ufb01",)], "t string")
    assert [r[0] for r in df.select(X.nfkc_stays(F.col("t"))).collect()] == [True, False]


def test_blanks_collapse(spark):
    kinds = [*map(chr, range(0x2100)), "\u3000", "\ufeff", "𝐀"]
    df = spark.createDataFrame([(i, f"{c}a{c}{c} b{c}") for i, c in enumerate(kinds)], "i int, t string")
    assert [r[0] for r in df.select("i", X.collapse_ws(F.col("t")).alias("t")).orderBy("i").select("t").collect()] == [" ".join(f"{c}a{c}{c} b{c}".split()) for c in kinds]


def test_regular_statutes_are_as_others(spark):
    """Those read by one cast give the rows of the way for any shape (F10, F11)."""
    pieces = ['{"조문번호": "1", "조문내용": "whole", "조문시행일자": "20200101"}', '{"조문번호": " 2 ", "항": [{"항번호": "1", "항내용": "p", "호": [{"호번호": "1", "호내용": "i"}, {"호번호": "b"}, {"호내용": ""}, null, {}]}, {"항번호": "9"}, {"항내용": "no number"}, null, {"항내용": "", "호": [{"호내용": "lost"}]}]}',
        '{"조문번호": "", "조문내용": "unnumbered"}', '{"조문내용": "no number"}', "null", '{"조문번호": "5", "조문내용": "삭제", "항": []}', '{"조문번호": "6", "조문내용": null, "항": null}', '{"조문번호": "7", "항": [{"항내용": "x", "호": []}]}']
    docs, odd = [], ', {"조문번호": "99", "항": {"항내용": 1}}'  # a member that no regular statute has
    for i in range(len(pieces)):
        held = ", ".join(pieces[i:] + pieces[:i])
        for k, more in enumerate(("", odd)):
            docs += [(f"{i} plain {k}", f'{{"법령ID": "1", "법령명": "A법", "조문": [{held}{more}]}}'), (f"{i} wrapped {k}", f'{{"법령": {{"기본정보": {{"법령ID": "1"}}, "조문": {{"조문단위": [{held}{more}]}}}}}}')]
    laws = legal.records(spark.createDataFrame(docs, "file string, raw string").select("file", F.try_parse_json("raw").alias("js"))).where("type = 'law'")
    assert laws.count() == len(docs)
    js = F.col("js")
    said = F.coalesce(V.at(V.at(V.at(js, "법령"), "조문"), "조문단위"), V.at(js, "조문"))
    assert {(r[0][-1], r[1]) for r in laws.select("file", V.kind(said).rlike(legal.REGULAR)).collect()} == {("0", True), ("1", False)}
    for items in (False, True):
        rows = {}
        for r in legal.statutes(laws, include_items=items).where("article <> '제99조'").collect():
            rows.setdefault(r["file"], []).append(tuple(r[c] for c in ("id", "parent_id", "article", "effective_date", "text", "a_pos", "p_pos", "i_pos")))
        assert len(rows) == len(docs)
        assert all(sorted(rows[f]) == sorted(rows[f[:-1] + "1"]) for f in rows)


def _laws(spark):
    js = '{"법령ID": "1", "법령명": "A법", "조문": [{"조문번호": "1", "조문내용": "\ufb01ne", "항": []}, {"조문번호": "2", "항": [{"항번호": "1", "항내용": "e\u0301  x", "호": ["\ufb01rst", {"호번호": "b", "호내용": " ２ "}, ""]}, "alone", {"항내용": "", "호": ["lost"]}]}]}'
    return legal.records(spark.createDataFrame([("f", js), ("g", js)], "file string, raw string").select("file", F.try_parse_json("raw").alias("js"))).where("type = 'law'")


def test_statutes_stay_in_their_rows(spark):
    laws = _laws(spark)
    for items, wanted in ((False, [("LAW_000001_제1조", "fine"), ("LAW_000001_제2조_1", "é x first 2"), ("LAW_000001_제2조_2", "alone")]), (True, [("LAW_000001_제1조", "fine"), ("LAW_000001_제2조_1_1", "first"), ("LAW_000001_제2조_1_b", "2"), ("LAW_000001_제2조_2", "alone")])):
        made = legal.statutes(laws, include_items=items)
        assert "Exchange" not in _plan(made)
        for file in ("f", "g"):
            assert [(r["id"], r["text"]) for r in made.where(F.col("file") == file).orderBy("a_pos", "p_pos", "i_pos").collect()] == wanted


def test_articles_are_shuffled_once(spark):
    merged = corpus.article_passages(legal.statutes(_laws(spark)).withColumn("pos", F.struct("file", "a_pos", "p_pos")), ["file", "article"], "pos")
    assert "Join" not in _plan(merged) and _plan(merged).count("Exchange") == 1
    assert {(r["file"], r["article"]): r["text"] for r in merged.collect()}["g", "제2조"] == "é x first 2\nalone"


class Narrow(encode.HashingEncoder):
    """Refuses more text at a time than it should be given."""

    def encode(self, texts):
        assert len(texts) == 1 or sum(map(len, texts)) <= encode.AT_ONCE
        return super().encode(texts)


def test_encoders_get_bounded_pieces(spark):
    texts = [f"word{i} " * 30_000 for i in range(12)] + ["", "a b", None, "long " * 90_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    for kind in ({"max_words": 1000, "pool_long": True}, {}):
        found = {r["i"]: r["vector"] for r in encode.encode(df, F.col("t"), Narrow(16), double=True, **kind).collect()}
        assert len(found) == len(texts)
        for i in (0, 11, 13, 15):
            assert np.allclose(found[i], encode.HashingEncoder(16).encode([texts[i]])[0])
        assert not any(found[12]) and not any(found[14])
    assert encode.pieces(pd.Series(["aaa", "b", None, "cccc"]), 6) == [(0, 2), (2, 4)]


def test_batches_are_bounded(spark):
    ship(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def _strings(x) -> list[str]:
    """What ``flatten_blocks`` gives, by recursion."""
    if isinstance(x, str):
        return [x.strip()] if x.strip() else []
    return [y for e in (x.values() if isinstance(x, dict) else x) for y in _strings(e)] if isinstance(x, (dict, list)) else []


def test_nested_blocks_are_flattened_without_python(spark):
    """Rules and their appendices, however nested, never leave the JVM (F12, F14)."""
    deep: object = "bottom"
    for i in range(400):
        deep = [deep, f"up{i}"] if i % 2 else {"k:": deep}
    odd = ['":', '"', "\\", '\\"', "a\":b", ":", "{", "},[", "null", "\u0000\t\x7f", "  \n c\u3000", "\u2028 é법𝐀/", ""]
    values = ["alone", "", 3, None, True, [], {}, odd, {x: odd for x in odd}, [1, [2.5, [None, False, ["x "]], {"a": [{"b": "y:"}, "z"]}]], deep, ['"\\\n' * 300_000, "after"]]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0)) for i, v in enumerate(values)] + [(len(values), None)], "i int, t string")
    found = df.select("i", F.to_json(F.try_parse_json("t")).alias("own"), legal.flatten_blocks(F.to_json(F.try_parse_json("t"))).alias("l"), legal.flatten_blocks(F.col("t")).alias("as_given"))
    rows = found.orderBy("i").collect()
    assert [r["l"] for r in rows] == [[] if r["own"] is None else _strings(json.loads(r["own"])) for r in rows]
    assert [r["as_given"] for r in rows] == [_strings(v) for v in [*values, None]]
    assert len(rows[values.index(deep)]["l"]) == 201
    nested = {"AdmRulService": {"행정규칙기본정보": {"행정규칙일련번호": "1"}, "조문내용": [["제1조(가) 나"], {"x": ["다"]}], "별표": {"별표단위": [{"별표번호": "1", "별표내용": [["라"], "마"]}]}}}
    js = spark.createDataFrame([("f", json.dumps(nested))], "file string, t string").select("file", F.lit(0).alias("rec_no"), F.parse_json("t").alias("js"))
    made = legal.rule_passages(js)
    assert {(r["id"], r["text"]) for r in made.collect()} == {("ADM_0000000001_제1조", "나\n다"), ("ADM_0000000001_APPX_0_1", "라\n마")}
    assert "EvalPython" not in _plan(made)


def test_a_task_has_one_python_worker_at_most(spark, data):
    """Whatever is made of the files, no stage of it holds a second Python function (F14)."""
    made = legal_queries.parts(spark, data, "statutes", "items", "rules", "fields", "chunks")
    assert [_plan(df).count("ArrowEvalPython") for df in made] == [1, 1, 0, 0, 1]
