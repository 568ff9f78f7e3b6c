from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from passagework.functions import text as X
from passagework.functions.order import digits_for, hash_key, number_rows, positions
from passagework.functions.stats import summary
from passagework.operators import blocked, citations, corpus, encode, metrics, vectors
from passagework.operators.negatives import tiered, tiered_candidates, with_runs
from passagework.operators.pairs import batch_plan, split_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["a\xa0b　c  d", " \x1ca\x1fb\x85", "", "  ", "plain", "a​b", "㈜ ＡＢ"])
def test_white_space_is_pythons(spark, text):
    import unicodedata

    assert one(spark, X.collapse_ws(F.lit(text))) == " ".join(text.split())
    assert one(spark, X.py_strip(F.lit(text))) == text.strip()
    assert one(spark, X.normalize_whitespace(F.lit(text))) == " ".join(unicodedata.normalize("NFKC", text).split())
    assert one(spark, X.count_tokens(F.lit(text))) == len(text.split())


@pytest.mark.parametrize(("length", "starts"), [(0, []), (10, [0]), (1200, [0]), (1201, [0, 1000]), (2900, [0, 1000, 2000])])
def test_windows(spark, length, starts):
    text = "".join(chr(97 + i % 26) for i in range(length))
    assert one(spark, X.windows(F.lit(text), 1200, 200)) == [text[s : s + 1200] for s in starts]


def test_windows_need_a_step():
    with pytest.raises(ValueError):
        X.windows(F.lit("x"), 10, 10)


@pytest.mark.parametrize(("text", "expected"), [("[1] one [2] two", "one"), ("none", "none"), ("", ""), ("[1]" + "x" * 300, "x" * 200 + "..."), ("a" * 300, "a" * 200)])
def test_first_section(spark, text, expected):
    assert one(spark, X.first_section(F.lit(text))) == expected


def test_zfill_never_cuts(spark):
    assert [one(spark, X.zfill(F.lit(x), 4)) for x in ("7", "12345")] == ["0007", "12345"]


@pytest.mark.parametrize(("values", "low", "high"), [([1], 1, 1), ([1, 2], 0.75, 2.25), ([1, 2, 4, 8], 1.25, 7), ([3, 3, 3], 3, 3)])
def test_exclusive_quartiles(spark, values, low, high):
    row = summary(spark.createDataFrame([(v,) for v in values], "v int"), [], "v").first()
    assert (row["p25"], row["p75"], row["n"]) == (low, high, len(values))
    assert row["stdev"] == 0 if len(set(values)) == 1 else row["stdev"] > 0


CITED = [
    ("[1]형법 제355조 제1항,제356조 / [2]산업안전보건기준에 관한 규칙 제1조", [("형법", "355", None, "1", "law"), ("산업안전보건기준에 관한 규칙", "1", None, None, "admin")]),
    ("민법 제750조 / 민법 제750조", [("민법", "750", None, None, "law")]),
    ("민법 제750조<br/>상법 제42조", [("민법 제750조 상법", "42", None, None, "law")]),
    ("상법 제401조의2 제1항", [("상법", "401", "2", "1", "law")]),
    ("위반으로 형법 제355조", [("위반으로 형법", "355", None, None, "law")]),
    ("산업안전보건법 시행령 제3조", []),
    ("민법 750조", [("민법", "750", None, None, "law")]),
    ("5·18민주화운동 등에 관한 특별법 제3조", [("5·18민주화운동 등에 관한 특별법", "3", None, None, "law")]),
    ("구 SW진흥법 제2조", [("구 SW진흥법", "2", None, None, "law")]),
    ("민법 제750조 1항", [("민법", "750", None, "1", "law")]),
    ("민법 제750조 제 2 항", [("민법", "750", None, "2", "law")]),
    ("민법 제750조 의 2", [("민법", "750", "2", None, "law")]),
    ("민법 제 750 조의 3 제1항", [("민법", "750", "3", "1", "law")]),
    ("상법(2011년 개정) 제42조", []),
    ("개인정보 보호법(구법) 제1조, 형법 제2조", [("형법", "2", None, None, "law")]),
    ("저작권법  제1조", [("저작권법", "1", None, None, "law")]),
    ("독점규제 및 공정거래에 관한 법률 제3조의2 제1항", [("독점규제 및 공정거래에 관한 법률", "3", "2", "1", "law")]),
    ("EU법 제1조", [("EU법", "1", None, None, "law")]),
    ("전기통신사업법2조", [("전기통신사업법", "2", None, None, "law")]),
    ("특정범죄 가중처벌 등에 관한 법률 제5조의4 제5항 제1호", [("특정범죄 가중처벌 등에 관한 법률", "5", "4", "5", "law")]),
    ("[1] 민법 제1조 / [2] 민법 제2조", [("민법", "1", None, None, "law"), ("민법", "2", None, None, "law")]),
    ("민법 제1조; 민법 제1조 제1항", [("민법", "1", None, None, "law"), ("민법", "1", None, "1", "law")]),
    ("금융감독원 고시 제12조", [("금융감독원 고시", "12", None, None, "admin")]),
    ("업무처리 지침 3조의2", [("업무처리 지침", "3", "2", None, "admin")]),
    ("행정업무 훈령 제1조, 예규 제2조", [("행정업무 훈령", "1", None, None, "admin"), ("예규", "2", None, None, "admin")]),
    ("인사 규정 제7조 2항", [("인사 규정", "7", None, "2", "admin")]),
    ("A·B 규칙 제1조", [("A·B 규칙", "1", None, None, "admin")]),
    ("민법 제1조 및 시행규칙 제2조", [("민법", "1", None, None, "law"), ("민법 제1조 및 시행규칙", "2", None, None, "admin")]),
    ("민법\n제1조", [("민법", "1", None, None, "law")]),
    ("<b>민법</b> 제1조", [("민법", "1", None, None, "law")]),
    ("법 제1조", []),
    ("민법 조", []),
    ("제750조", []),
    ("민법 제조", []),
    ("수표법 제1조 제2조", [("수표법", "1", None, None, "law")]),
    ("", []),
]


@pytest.mark.parametrize(("text", "expected"), CITED)
def test_citations(spark, text, expected):
    assert [tuple(r) for r in one(spark, citations.citations(F.lit(text)))] == expected


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", 1, False), ("q", 2, True), ("q", 3, False), ("q", 4, True)], "query_id string, rank int, hit boolean")
    row = metrics.per_query(ranked, spark.createDataFrame([("q", 2), ("none", 0)], "query_id string, n_rel int"), [4]).where("query_id = 'q'").first()
    assert (row["accuracy"], row["precision"], row["recall"], row["mrr"], row["map_all"]) == (1, 0.5, 1, 0.5, 0.5)
    assert round(row["ndcg_first"], 4) == 0.6309
    assert round(row["ndcg_full"], 4) == 0.6509


def test_metric_helpers():
    assert metrics.normalize_ks(None, 4) == [1, 3]
    assert metrics.normalize_ks(50, 4) == [1]
    assert metrics.parse_ks("5,x,1") == [5, 1]
    assert metrics.primary_metric(["mrr@5", "ndcg@5", "ndcg@10"]) == "ndcg@10"
    assert metrics.early_stopping([1, 2, 2, 2, 2], 3, 0) == 5
    assert metrics.early_stopping([1, 2, 3], 2, 0) is None
    assert batch_plan(130, 64, 2) == {"batch_size": 64, "total_steps": 6, "warmup_steps": 10}


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, None)], "id string, pos int, text string")
    assert {(r["id"], r["text"]) for r in corpus.first_wins(df, ["id"], ["pos"]).collect()} == {("a", "x"), ("b", None)}
    assert {(r["id"], r["text"]) for r in corpus.last_wins(df, ["id"], ["pos"]).collect()} == {("a", "y"), ("b", None)}


def test_concat_skips_contained(spark):
    df = spark.createDataFrame([("g", 1, "one two"), ("g", 2, "two"), ("g", 3, "three"), ("g", 4, None)], "k string, pos int, text string")
    assert corpus.concat_groups(df, ["k"], "pos", "text").first()["text"] == "one two\nthree"


def test_numbers_and_positions(spark):
    df = spark.range(1000).withColumn("h", hash_key(42, F.col("id")))
    assert sorted(r["n"] for r in number_rows(df, "id", out="n").collect()) == list(range(1, 1001))
    placed = positions(df.withColumn("g", F.col("id") % 3), ["g"], "h").orderBy("g", "h").collect()
    for g in range(3):
        own = [r for r in placed if r["g"] == g]
        assert [r["pos"] for r in own] == list(range(len(own)))
        assert {r["total"] for r in own} == {len(own)}
    assert [digits_for(n) for n in (10, 800_001, 10**9)] == [1, 2, 4]


def test_numbers_have_no_gaps_in_wide_tables(spark):
    df = spark.range(200_000).select(hash_key(1, F.col("id")).alias("key"), "id", F.repeat(F.lit("x"), 30).alias("text"))
    n = number_rows(df, "key", out="n", parts=8).select("key", "n", "text")
    row = n.agg(F.countDistinct("n"), F.min("n"), F.max("n"), F.min(F.length("text"))).first()
    assert tuple(row) == (200_000, 1, 200_000, 30)
    ahead = n.alias("a").join(n.alias("b"), F.expr("b.n = a.n + 1")).where("a.key >= b.key").count()
    assert ahead == 0


def test_quantiles_of_groups(spark):
    import statistics

    rows = [(None if i % 4 == 0 else f"g{i % 3}", float(i * i % 97) if i % 11 else None) for i in range(900)]
    found = {r["g"]: r for r in summary(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in (None, "g0", "g1", "g2"):
        own = sorted(v for k, v in rows if k == g and v is not None)
        low, mid, high = statistics.quantiles(own, n=4)
        assert found[g]["n"] == len(own) and [found[g][c] for c in ("p25", "median", "p75")] == pytest.approx([low, mid, high])


def slow_negatives(rows, tiers, n, seed=42):
    """The rings written out: each pair walks its whole ring of every tier."""
    import hashlib

    md = lambda x: hashlib.md5(f"{seed}:{x}".encode()).hexdigest()
    out = {}
    for r in rows:
        taken, used = [], []
        for t, group in enumerate(tiers, 1):
            held = sorted((x for x in rows if all(x[g] == r[g] for g in group)), key=lambda x: md(x["id"]))
            start = int(md(f"tier{t}:{r['id']}")[:8], 16) % len(held)
            for x in held[start:] + held[:start]:
                kin = x["id"] == r["id"] or (x["parent_id"] is not None and x["parent_id"] == r["parent_id"])
                if len(taken) < n and not kin and x["id"] not in taken:
                    taken.append(x["id"])
                    used.append(t)
        if taken:
            out[r["id"]] = (taken, used)
    return out


@pytest.mark.parametrize("hot", [0.0, 0.4, 0.97])
def test_negatives_by_brute_force(spark, hot):
    import random

    draw = random.Random(7)
    rows = [{"id": f"d{i}", "parent_id": "hot" if draw.random() < hot else None if i % 29 == 0 else f"p{draw.randrange(40)}", "grp": draw.choice("abc")} for i in range(400)]
    df = spark.createDataFrame(rows, "id string, parent_id string, grp string")
    found = {r["pair"]: (r["negatives"], r["tiers_used"]) for r in tiered(df, df, [["grp"], []], 3).collect()}
    assert found == slow_negatives(rows, [["grp"], []], 3)


def test_runs_chain_over_buckets(spark):
    parents = (["a"] * 9_990 + ["b"] * 25_000 + [None, None, "b"]) + ["c", "a"] * 50
    placed = spark.createDataFrame([(i, p) for i, p in enumerate(parents)], "pos long, parent_id string")
    found = [(r["run"], r["at"]) for r in with_runs(placed, []).orderBy("pos").select("run", "at").collect()]
    run, at, expected = -1, 0, []
    for i, p in enumerate(parents):
        same = i > 0 and p is not None and p == parents[i - 1]
        run, at = (run, at + 1) if same else (run + 1, 0)
        expected.append((run, at))
    assert found == expected


def test_negatives_of_a_large_family_cost_no_square(spark):
    df = spark.range(20_000).select(F.concat(F.lit("D"), "id").alias("id"), F.when(F.col("id") < 15_000, "hot").otherwise(F.col("id").cast("string")).alias("parent_id"), F.lit("g").alias("grp"))
    found = tiered_candidates(df, df, [["grp"]], 2, 42)
    assert found.count() < 20 * 20_000
    assert tiered(df, df, [["grp"]], 2).where(F.size("negatives") == 2).count() == 20_000


def test_negatives_are_never_self_or_family(spark):
    df = spark.range(60).select(F.concat(F.lit("D"), "id").alias("id"), (F.col("id") / 5).cast("int").alias("parent_id"), F.when(F.col("id") < 6, "small").otherwise("big").alias("grp"))
    rows = tiered(df, df, [["grp"], []], 3).collect()
    parent = {r["id"]: r["parent_id"] for r in df.collect()}
    assert len(rows) == 60
    for r in rows:
        assert len(set(r["negatives"])) == 3
        assert all(parent[x] != parent[r["pair"]] for x in r["negatives"])
        assert r["tiers_used"] == sorted(r["tiers_used"])


def test_split_shares(spark):
    counts = dict(spark.range(100).groupBy(split_of(F.col("id"))).count().collect())
    assert counts == {"train": 80, "valid": 10, "test": 10}


def test_encoder_pools_long_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "a b")], "id int, t string")
    coded = {r["id"]: r["vector"] for r in encode.encode(df, F.col("t"), encode.HashingEncoder(16), max_words=2, pool_long=True).collect()}
    assert abs(sum(x * x for x in coded[1]) - 1) < 1e-5
    assert not any(coded[2])


def test_top_k_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, vector array<float>")
    queries = df.where("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    whole = sorted(map(tuple, vectors.top_k(queries, df, 4).collect()))
    monkeypatch.setattr(blocked, "PART_ROWS", 9)
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 2)
    assert sorted(map(tuple, vectors.top_k(queries, df, 4).collect())) == whole
    for q, v in rows[:9]:
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), d) for d, w in rows))[:4]
        assert [r[1] for r in sorted((x for x in whole if x[0] == q), key=lambda x: x[3])] == [d for _, d in best]
