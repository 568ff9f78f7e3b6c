"""The registered queries at the smallest scale: SQL where there is some, brute force elsewhere."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from passagework.llm import bpe_tree, queries_tokens, registry
from tests.compare import duck_rows, spark_rows
from tests.llm.test_llm import slow_components, slow_hits


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, data, name):
    assert spark_rows(registry.QUERIES[name](spark, data)) == duck_rows(registry.ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"pipeline"}))
def test_one_row_each(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    key = "page_id" if "page_id" in df.columns else "doc_id"
    source = "pages" if key == "page_id" else "documents"
    ids = sorted(r[0] for r in df.select(key).collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{data}/{source}.parquet").select(key).collect())


PARTIAL = {
    "op4_bpe_round_trip": (["doc_id", "decoded_sha256"], "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"),
    "op7_fingerprints": (["doc_id", "n_chars", "edited_sha256"], """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), (SELECT arg_min(t, doc_id) FROM d)) AS x FROM d)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(x, 1, length(t) // 4)) AS edited_sha256 FROM n"""),
    "op1_url_filter": (["page_id", "host", "path", "rule"], r"""WITH u AS (SELECT page_id, regexp_extract(url, '^.*?://(.*)$', 1) AS r FROM pages), h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT unnest(['com', 'example.com', 'net', 'example.net', 'org']) AS e, unnest(['/en/', '/en/7', '/de/', '/de/8', '/es/']) AS s)
SELECT page_id, host, path, (SELECT arg_max(e || s, length(e || s)) FROM k WHERE (host = e OR ends_with(host, '.' || e)) AND starts_with(path, s)) AS rule FROM h"""),
}


@pytest.mark.parametrize("name", sorted(PARTIAL))
def test_columns_against_sql(spark, data, name):
    columns, sql = PARTIAL[name]
    assert spark_rows(registry.QUERIES[name](spark, data).select(columns)) == duck_rows(sql, data)


def test_tokens_are_the_libraries(spark, data):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    encoder, _ = bpe_tree.load(queries_tokens.public(queries_tokens.RANK_FILE), queries_tokens.pattern())
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in registry.QUERIES["op4_bpe_round_trip"](spark, data).collect()}
    assert found == {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ((i, encoder.encode_ordinary(t)) for i, t in docs.items())}
    library, at, expected = Tokenizer.from_file(queries_tokens.public(queries_tokens.TOKENIZER_FILE)), 0, {}
    for i in sorted(docs):
        ids = [*library.encode(docs[i], add_special_tokens=False).ids, queries_tokens.END_ID]
        expected[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in registry.QUERIES["op10_token_shards"](spark, data).collect()} == expected


def test_near_duplicates_by_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in registry.QUERIES["op9_near_duplicates"](spark, data).collect())
    assert found == slow_components(rows, 4, 80)


def test_stages_tell_texts_of_one_id_apart(spark, tmp_path):
    prose = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(5)]
    near = prose[0] + " more"
    rows = [(1, prose[0]), (2, near), (2, prose[1]), (3, prose[2]), (3, prose[2] + " more"), (4, prose[3]), (5, None), (5, ""), (None, prose[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_distinct(spark, docs, "").collect()]
    assert sorted(i for i, _ in kept if i) == [1, 2, 3, 4, 5, 5] and (2, prose[1]) in kept and (None, prose[4]) in kept
    items = [(1, " ".join(prose[0].split()[5:20]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.cut_benchmarks(spark, docs, str(tmp_path)).collect()]
    assert len(clean) == len(rows) - 2 and not {(1, prose[0]), (2, near)} & set(clean) and (2, prose[1]) in clean


def test_pipeline_by_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    first = named["quality"](spark, docs, data)
    second = named["toxicity"](spark, first, data)
    assert first.columns == second.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in second.collect()]
    kept = {i for i, _, c in slow_components(rows, 5, 80) if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {i: t for i, t in rows if i in kept and not slow_hits(t, items, 10)[1]}
    encoder, _ = bpe_tree.load(queries_tokens.public(queries_tokens.RANK_FILE), queries_tokens.pattern())
    expected = sorted((i, len(ids := encoder.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in clean.items())
    found = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, data).collect())
    assert found == expected and found
