from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from passagework import cli, config
from passagework.functions.text import metric_key
from passagework.operators import reports
from passagework.operators.corpus import article_id
from passagework.operators.encode import TemplateMode, template
from tests import legal_records as L


def test_config():
    assert config.overridden({"a": {"b": 1, "c": 2}}, ["a.b=3", "d.e=x"]) == {"a": {"b": 3, "c": 2}, "d": {"e": "x"}}
    at = lambda h: datetime(2024, 1, 1, h, 30)
    assert config.opening(at(3), 1, 8) is None and config.opening(at(23), 22, 6) is None and config.opening(at(3), None, None) is None
    assert config.opening(at(9), 1, 8) == datetime(2024, 1, 2, 1) and config.opening(at(12), 22, 6) == datetime(2024, 1, 1, 22)


def test_small_expressions(spark):
    lit = F.lit
    row = spark.range(1).select(
        metric_key(lit("val_cosine_ndcg@10")), article_id(lit("LAW_1_2"), lit("")), article_id(lit("LAW_1_2"), lit("P")), article_id(lit("x"), lit("P")),
        template(lit("t"), "query", TemplateMode.NONE), template(lit("t"), "query", TemplateMode.of("odd")), reports.query_source(lit("prec_fallback")), reports.query_source(lit("prec_fallback"), mined=True),
        reports.passage_source(lit("ADM_1"), lit("행정규칙-별표")),
    ).first()
    assert list(row) == ["ndcg_at_10", "LAW_1", "P", "x", "t", "Represent this sentence for searching relevant passages: t", "기타", "판례", "기타"]


def test_reports(spark, tmp_path):
    assert {(r["shape"], r["files"]) for r in reports.shape_census(L.files(spark)).collect()} == {("dict_other", 6), ("dict_flat", 1), ("dict_PrecService", 1), ("list_top", 1)}
    laws, rules, _, chunks = L.parts(spark)
    made = laws.select("file").unionAll(rules.select("file")).unionAll(chunks.select("file"))
    counts = {r["type"]: (r["files"], r["empty"], r["passages"]) for r in reports.file_counts(L.files(spark), made).collect()}
    assert counts == {"law": (2, 0, 5), "admin": (2, 0, 4), "prec": (3, 1, 4), "unknown": (2, 2, 0)}
    (tmp_path / "article_a_b.json").write_text(json.dumps({"metrics": {"val_cosine_ndcg@10": 0.5, "note": "x"}}))
    (tmp_path / "item_c.json").write_text(json.dumps({"mrr@10": 1}))
    found = {tuple(r) for r in reports.evaluation_results(spark, str(tmp_path)).collect()}
    assert found == {("article", "a/b", "ndcg_at_10", 0.5), ("item", "c", "mrr_at_10", 1.0)}
    assert [r["model"] for r in reports.leaderboard(reports.evaluation_results(spark, str(tmp_path))).collect()] == ["a/b", "c"]
    log = reports.MetricsLog(str(tmp_path / "log" / "m.jsonl"))
    log.params(k=1)
    log.metrics({"val_cosine_ndcg@10": 0.5}, 3)
    assert json.loads((tmp_path / "log" / "m.jsonl").read_text().splitlines()[1])["eval/ndcg_at_10"] == 0.5
    assert "| a | 0.5000 |" in reports.markdown([{"m": "a", "v": 0.5}], "t")


def test_commands_end_to_end(spark, tmp_path, capsys):
    src, mid, out = (str(tmp_path / x) for x in ("src", "mid", "out"))
    (tmp_path / "src").mkdir()
    for name, record in L.RECORDS.items():
        (tmp_path / "src" / f"{name}.json").write_text(json.dumps(record, ensure_ascii=False), encoding="utf-8")
    cli.main(["preprocess", "--src", src, "--out", mid])
    cli.main(["merge", "--inputs", f"{mid}/law", f"{mid}/admin", f"{mid}/prec", "--out", f"{mid}/corpus"])
    assert spark.read.json(f"{mid}/corpus").count() == 13
    cli.main(["gen-data", "--folder", mid, "--out", f"{out}/own", "--prec-passages"])
    cli.main(["gen-data", "--folder", mid, "--out", out, "--hn-per-q", "2", "--use-admin-for-prec"])
    cli.main(["validate", "--corpus", f"{mid}/corpus", "--pairs", f"{out}/pairs_train"])
    cli.main(["embed", "--input", f"{mid}/corpus", "--out", f"{out}/vectors"])
    assert spark.read.parquet(f"{out}/vectors").count() == 13
    cli.main(["eval", "--passages", f"{mid}/corpus", "--pairs", f"{out}/pairs_train", "--k-values", "1,5"])
    report = tmp_path / "report.md"
    cli.main(["eval", "--passages", f"{mid}/corpus", "--pairs", f"{out}/pairs_train", "--detailed", "--report", str(report), "--template", "none"])
    assert "By source" in report.read_text() and "very_" in report.read_text()
    cli.main(["eval", "--passages", f"{mid}/corpus", "--pairs", f"{out}/pairs_train", "--compare-dims", "32", "64"])
    cli.main(["eval", "--passages", f"{mid}/corpus", "--pairs", f"{out}/pairs_train", "--compare-models", "words-64", "grams-64", "pieces-64:16"])
    cli.main(["failed", "--passages", f"{mid}/corpus", "--pairs", f"{out}/pairs_train", "--k-values", "1"])
    cli.main(["concat", "--inputs", f"{out}/pairs_train", f"{out}/pairs_valid", "--out", f"{out}/both", "--gzip"])
    assert spark.read.json(f"{out}/both").count() == spark.read.json(f"{out}/pairs_train").count() + (spark.read.json(f"{out}/pairs_valid").count() if any((tmp_path / "out" / "pairs_valid").glob("*.json")) else 0)
    cli.main(["analyze-passages", "--corpus", f"{mid}/corpus"])
    cli.main(["analyze-pairs", "--pairs", f"{out}/pairs_train"])
    printed = capsys.readouterr().out
    assert "accuracy" in printed and "pieces-64:16" in printed


def test_search_commands(spark, tmp_path, capsys):
    src, mid, out = (str(tmp_path / x) for x in ("src", "mid", "out"))
    (tmp_path / "src").mkdir()
    for name, record in L.RECORDS.items():
        (tmp_path / "src" / f"{name}.json").write_text(json.dumps(record, ensure_ascii=False), encoding="utf-8")
    cli.main(["preprocess", "--src", src, "--out", mid, "--types", "law", "admin"])
    cli.main(["preprocess", "--src", src, "--out", mid, "--types", "law", "--glob", "none*.json", "--append"])
    assert not (tmp_path / "mid" / "prec").exists()
    laws = spark.read.json(f"{mid}/law")
    paths = sorted(str(p) for p in (tmp_path / "src").glob("*.json"))
    for r in laws.select("file", "file_no").distinct().collect():
        assert 0 <= r["file_no"] < len(paths)
    cli.main(["merge", "--inputs", f"{mid}/law", f"{mid}/admin", "--out", f"{mid}/corpus"])
    texts = {r["id"]: r["text"] for r in spark.read.json(f"{mid}/corpus").collect()}
    cli.main(["chunk", "--input", f"{mid}/corpus", "--out", f"{out}/cuts", "--max-tokens", "3"])
    cuts = spark.read.json(f"{out}/cuts").collect()
    for ident, text in texts.items():
        assert "".join(r["text"] for r in sorted((r for r in cuts if r["parent_id"] == ident), key=lambda r: r["start"])) == text
    cli.main(["embed", "--input", f"{mid}/corpus", "--out", f"{out}/vectors", "--model", "grams-64", "--normalize", "--template", "none", "--index", f"{out}/index", "--cells", "2"])
    (tmp_path / "asked.json").write_text("".join(json.dumps({"id": i, "question": t}, ensure_ascii=False) + "\n" for i, t in texts.items()), encoding="utf-8")
    cli.main(["search", "--index", f"{out}/index", "--queries", str(tmp_path / "asked.json"), "--out", f"{out}/found", "--model", "grams-64", "--k", "1", "--template", "none"])
    assert {r["query_id"]: texts[r["doc_id"]] for r in spark.read.json(f"{out}/found").collect()} == texts
    rows = [{"query_id": f"q{i}", "query_text": t, "positive_passages": [x], "hard_negatives": [], "meta": {"type": "law"}} for i, (x, t) in enumerate(sorted(texts.items()))]
    (tmp_path / "pairs.json").write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    cli.main(["chunk-study", "--src", src, "--pairs", str(tmp_path / "pairs.json"), "--out", f"{out}/study", "--models", "grams-32", "--k-values", "1,3"])
    assert {(r["unit"], r["k"]) for r in spark.read.json(f"{out}/study").collect()} == {(u, k) for u in ("paragraph", "item", "article") for k in (1, 3)}
    cli.main(["visualize", "--corpus", f"{mid}/corpus", "--pairs", str(tmp_path / "pairs.json"), "--out", f"{out}/pictures", "--model", "grams-32"])
    assert spark.read.json(f"{out}/pictures/projection").groupBy("side").count().count() == 2
    kinds = {r["kind"]: r["count"] for r in spark.read.json(f"{out}/pictures/similarity").groupBy("kind").count().collect()}
    assert kinds["positive"] == len(rows) and kinds["negative"] >= len(rows)
    assert "Units of chunking" in capsys.readouterr().out


def test_models_by_name(tmp_path):
    import pytest

    from passagework.operators import models

    assert models.named("pieces-32:7").max_tokens == 7
    assert models.named("grams-16").max_tokens == models.DEFAULT_LENGTH
    with pytest.raises(ValueError, match="dimensions"):
        models.named("odd-1")
    (tmp_path / "training_config.json").write_text('{"max_len": 99}')
    assert models.length(str(tmp_path)) == 99 and models.length(str(tmp_path), 12) == 12 and models.length() == models.DEFAULT_LENGTH
    (tmp_path / "training_config.json").write_text("[")
    assert models.length(str(tmp_path)) == models.DEFAULT_LENGTH
    near = models.GramEncoder(256).encode(["walking home", "walked home", "zebra crossing"])
    assert near[0] @ near[1] > near[0] @ near[2] + 0.2


def test_sources(spark, tmp_path):
    from passagework.operators import pairs
    from passagework.sources import tables

    (tmp_path / "a.jsonl").write_text('{"id": "1", "question": "why"}\n\n{"id": "2", "question": null}\n')
    assert [tuple(r) for r in tables.read_queries(spark, str(tmp_path / "a.jsonl")).orderBy("query_id").collect()] == [("1", "why"), ("2", None)]
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("a", 4), (None, 5)], "file string, n int")
    assert {r["n"]: r["file_no"] for r in tables.in_file_order(rows).collect()} == {2: 0, 4: 0, 1: 1, 3: 2, 5: None}
    many = spark.range(50).select("id", F.md5(F.col("id").cast("string")).alias("order_key"))
    first = [r["id"] for r in pairs.first_batches(many, 4, batches=3).collect()]
    assert first == [r["id"] for r in many.orderBy("order_key").limit(12).collect()]


def test_ingest_takes_its_own_place_again(spark, tmp_path):
    from passagework.streaming import ingest

    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for name, record in L.RECORDS.items():
        (src / f"{name}.json").write_text(json.dumps(record, ensure_ascii=False), encoding="utf-8")
    ingest.ingest(spark, str(src), out, str(tmp_path / "checkpoint")).awaitTermination()
    before = sorted(tuple(r) for r in spark.read.parquet(out).select("id", "text").collect())
    assert len(before) == len({i for i, _ in before}) > 5
    # the same files as a batch of the same number again, as after a crash before the checkpoint's commit
    ingest.ingest(spark, str(src), out, str(tmp_path / "other")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("id", "text").collect()) == before


def test_crawl_over_files(spark, tmp_path):
    from passagework.sources.web import crawl

    for page in (1, 2):
        (tmp_path / f"s{page}.json").write_text(json.dumps({"total": 4, "prec": [{"ID": f"{page}1"}, {"ID": f"{page}2", "판결유형": "명령"}, {"ID": f"{page}3"}]}, ensure_ascii=False), encoding="utf-8")
        (tmp_path / f"d{page}1.json").write_text(json.dumps({"PrecService": {"판례일련번호": f"{page}1", "판결유형": "판결", "사건명": "가"}}, ensure_ascii=False), encoding="utf-8")
        (tmp_path / f"d{page}3.json").write_text(json.dumps({"판례일련번호": f"{page}3", "사건명": "나"}, ensure_ascii=False), encoding="utf-8")
    found = crawl(spark, f"file://{tmp_path}/s{{page}}.json", f"file://{tmp_path}/d{{id}}.json", 1, 3, delay=0)
    assert {(r["case_id"], r["title"]) for r in found.collect()} == {("000011", "가"), ("000021", "가")}


def test_exports():
    import subprocess
    import sys

    said = "import sys, passagework; assert 'pyspark' not in sys.modules; from passagework import *; print(named('grams-8').name, top_k.__name__, search_index.__name__)"
    done = subprocess.run([sys.executable, "-c", said], capture_output=True, text=True, check=True)
    assert done.stdout.split() == ["grams-8", "top_k", "search"]
