"""Command line: preprocess, merge, concat, gen-data, validate, chunk, embed, search, eval, failed, chunk-study,
visualize, analyze-passages, analyze-pairs, crawl, config."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework import config
from passagework.cluster import cut, ship
from passagework.operators import analysis, citations, corpus, encode, evaluation, index, legal, metrics, models, pairs, precedent_pairs, reports, similarity, tokens, units, vectors
from passagework.sources import tables
from passagework.sources.web import crawl

PASSAGE = "id string, parent_id string, type string, law_id string, law_name string, rule_id string, rule_name string, article string, title string, effective_date string, appendix_no string, appendix_title string, source string, case_number string, court_name string, judgment_date string, headnote string, summary string, text string"
PAIR = "query_id string, query_text string, positive_passages array<string>, hard_negatives array<string>, meta struct<type: string>"


def preprocess(spark: SparkSession, src: str, out: str, items: bool, anchored: bool = False, glob: str = "*.json", append: bool = False, kinds: list[str] | None = None, size: int = 1200, overlap: int = 200) -> None:
    """Passages of all files below ``src`` by type, each with the place of its file in ``file_no``;
    ``kinds`` of law, admin and prec (default all)."""
    files, bad = tables.read_json_files(spark, src, glob)
    typed = cut(legal.records(files))  # files are parsed once for all that is written
    fields = legal.precedent_fields(typed.where("type = 'prec'"))
    made = {
        "law": lambda: {"law": legal.statutes(typed.where("type = 'law'"), items, anchored)},
        "admin": lambda: {"admin": legal.rule_passages(typed.where("type = 'admin'"))},
        "prec": lambda: {"prec": legal.precedent_passages(fields, size=size, overlap=overlap), "prec_fields": fields},
    }
    for kind in kinds or list(made):
        for name, df in made[kind]().items():
            tables.write_jsonl(tables.in_file_order(df) if "file" in df.columns else df, f"{out}/{name}", "append" if append else "overwrite")
    tables.write_jsonl(bad, f"{out}/rejects", "append" if append else "overwrite")


def study(spark: SparkSession, src: str, pair_path: str, names: list[str], ks: list[int]) -> DataFrame:
    """Chunk units of the files below ``src`` by models, for pairs that name paragraphs."""
    files, _ = tables.read_json_files(spark, src)
    typed = cut(legal.records(files))
    laws = typed.where("type = 'law'")
    held = [models.named(n) for n in names]
    parts = map(cut, (legal.statutes(laws), legal.statutes(laws, include_items=True), legal.rule_passages(typed.where("type = 'admin'"))))
    return units.study(*parts, tables.read_jsonl(spark, pair_path, PAIR), {m.name: m for m in held}, ks, models.information(spark, held))


def visualize(spark: SparkSession, corpus_path: str, pair_path: str, model: models.Model, out: str) -> None:
    """The tables behind pictures of an embedding space: ``projection`` (two components), ``similarity``
    (positives and as many others) and ``histogram``."""
    docs = corpus.last_wins(read(spark, corpus_path).select("id", "text"), ["id"], ["text"])
    asked = tables.read_jsonl(spark, pair_path, PAIR).where(F.size("positive_passages") > 0)
    c = cut(model.encode_passages(docs.withColumnRenamed("id", "doc_id"), F.col("text")).select("doc_id", "vector"))
    q = cut(model.encode_queries(asked.select("query_id", "query_text"), F.col("query_text")).select("query_id", "vector"))
    found = similarity.principal(c, 2)
    both = q.select(F.col("query_id").alias("id"), F.lit("query").alias("side"), "vector").unionByName(c.select(F.col("doc_id").alias("id"), F.lit("passage").alias("side"), "vector"))
    tables.write_jsonl(both.select("id", "side", found.place(F.col("vector")).alias("place")), f"{out}/projection")
    wanted = asked.select("query_id", F.explode(F.array_distinct("positive_passages")).alias("doc_id"))
    positive = wanted.join(q, "query_id").join(c.select("doc_id", F.col("vector").alias("v")), "doc_id").select("query_id", vectors.dot(F.col("vector"), F.col("v")).alias("score"))  # as many rows as pairs name
    others = vectors.top_k(q, c, 100).join(wanted, ["query_id", "doc_id"], "left_anti")
    counts = asked.select("query_id").distinct().join(positive.groupBy("query_id").agg(F.count(F.lit(1)).alias("positives")), "query_id", "left")
    taken = similarity.balanced_sample(others, counts)
    rows = cut(positive.select(F.lit("positive").alias("kind"), "score").unionByName(taken.select(F.lit("negative").alias("kind"), "score")))
    tables.write_jsonl(rows, f"{out}/similarity")
    tables.write_jsonl(evaluation.histogram(rows, "score", 50, "kind"), f"{out}/histogram")


def read(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_jsonl(spark, path, PASSAGE)


def gen_data(spark: SparkSession, folder: str, out: str, n: int, max_positives: int, seed: int, cross: bool = True, rules_for_precedents: bool = True, mine: bool = True) -> DataFrame:
    """Pairs of statutes, rules and precedents: cross positives, first of equal queries, numbered, split, written.

    ``mine`` takes precedents' positives from what they cite (``prec_fields``), rules among it with
    ``rules_for_precedents``; otherwise precedent passages stand for themselves and ``cross`` adds
    the statutes that their text mentions.
    """
    laws, rules = read(spark, f"{folder}/law"), read(spark, f"{folder}/admin")
    law_q = pairs.query_law(F.col("law_name"), F.col("article"), F.col("title"))
    rule_q = pairs.query_rule(F.col("rule_name"), F.col("article"), F.col("title"), F.col("appendix_title"))
    found = [
        pairs.self_pairs(laws.withColumn("law_name", F.coalesce("law_name", F.lit(""))), law_q, "law_name", "law", n, seed),
        pairs.self_pairs(rules.withColumn("rule_name", F.coalesce("rule_name", F.lit(""))), rule_q, "rule_name", "admin", n, seed),
    ]
    if mine:
        chunks = spark.read.json(f"{folder}/prec").select("id", F.substring("parent_id", 6, 100).alias("case_id"), "chunk_no", "title")
        cited = rules.where("article is not null").select("id", "rule_name", "article")
        mined = precedent_pairs.precedent_pairs(spark.read.json(f"{folder}/prec_fields"), chunks, laws.select("id", "law_name", "article"), cited if rules_for_precedents else cited.limit(0), n, max_positives, seed)
        found.append(mined.where(F.size("positive_passages") > 0).withColumnRenamed("case_id", "pair"))
    else:
        own = pairs.precedent_self_pairs(read(spark, f"{folder}/prec"), n, seed)
        if cross:
            named = own.withColumnsRenamed({"pair": "query_id", "positive_passages": "positives"})
            own = citations.cross_positives(named, laws.select("id", "law_name", "article")).withColumnsRenamed({"query_id": "pair", "positives": "positive_passages"})
        found.append(own)
    flat = [p.select("pair", "query_text", "positive_passages", "hard_negatives", F.struct(F.col("meta.type").alias("type")).alias("meta")) for p in found]
    done = pairs.finish(corpus.union_ranked(*flat), ["src_rank", "pair"])
    for split in ("train", "valid", "test"):
        tables.write_jsonl(done.where(F.col("split") == split).drop("split", "i", "src_rank", "pair"), f"{out}/pairs_{split}")
    tables.write_jsonl(done.where("split = 'valid'").drop("split", "i", "src_rank", "pair"), f"{out}/pairs_eval")
    return done


def report_validity(p: DataFrame, docs: DataFrame, key: str) -> None:
    """Totals, what is wrong, histograms and samples of pairs."""
    checked = cut(pairs.validated(p, docs, key))  # every report reads it
    totals = pairs.validity(checked)
    totals.show()
    if totals.first()["invalid_share"] > 0.1:
        print("more than a tenth of the pairs are invalid")
    checked.select(F.explode("errors").alias("error")).groupBy("error").count().show()
    pairs.histograms(checked).orderBy("measure", F.desc("n")).show(100, truncate=False)
    pairs.samples(checked, key).show(100, truncate=60)


def evaluate(spark: SparkSession, passages: str, pair_path: str, ks: list[int], model: int | str, template: str = "bge") -> evaluation.Search:
    """What a model (or the hashing encoder of so many dimensions) finds over a corpus for its pairs."""
    docs = corpus.last_wins(read(spark, passages).select("id", "text"), ["id"], ["text"])
    asked = tables.read_jsonl(spark, pair_path, PAIR)
    mode = encode.TemplateMode.of(template)
    return evaluation.search(models.named(model, mode=mode) if isinstance(model, str) else encode.HashingEncoder(model), docs, asked, ks, mode)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="passagework", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    add = lambda name, *flags: [(p := sub.add_parser(name)), [p.add_argument(f, **o) for f, o in flags]][0]
    need, flag = {"required": True}, {"action": "store_true"}
    add("preprocess", ("--src", need), ("--out", need), ("--include-items", flag), ("--anchored", flag), ("--glob", {"default": "*.json"}), ("--append", flag), ("--types", {"nargs": "+", "choices": ["law", "admin", "prec"]}), ("--chunk-size", {"type": int, "default": 1200}), ("--chunk-overlap", {"type": int, "default": 200}))
    add("merge", ("--inputs", need | {"nargs": "+"}), ("--out", need))
    add("gen-data", ("--folder", need), ("--out", need), ("--hn-per-q", {"type": int, "default": 2}), ("--max-positives-per-prec", {"type": int, "default": 5}), ("--seed", {"type": int, "default": 42}), ("--no-cross", flag), ("--use-admin-for-prec", flag), ("--prec-passages", flag))
    add("concat", ("--inputs", need | {"nargs": "+"}), ("--out", need), ("--gzip", flag))
    add("validate", ("--corpus", need), ("--pairs", need))
    add("embed", ("--input", need), ("--out", need), ("--type", {"choices": ["passage", "query"], "default": "passage"}), ("--id-field", {"default": "id"}), ("--text-field", {"default": "text"}), ("--dims", {"type": int, "default": 256}), ("--limit", {"type": int}), ("--template", {"default": "bge"}), ("--max-words", {"type": int}), ("--npz", {"default": ""}), ("--arrays", {"default": ""}), ("--output-format", {"choices": ["npz", "npy", "both"], "default": "npz"}), ("--model", {"default": ""}), ("--tokenizer", {"default": ""}), ("--normalize", flag), ("--index", {"default": ""}), ("--cells", {"type": int}))
    add("chunk", ("--input", need), ("--out", need), ("--tokenizer", {"default": ""}), ("--max-tokens", {"type": int, "default": 384}), ("--overlap", {"type": int, "default": 0}))
    add("search", ("--index", need), ("--queries", need), ("--out", need), ("--model", {"default": "words-256"}), ("--k", {"type": int, "default": 10}), ("--probes", {"type": int}), ("--id-field", {"default": "id"}), ("--text-field", {"default": "question"}), ("--template", {"default": "bge"}))
    add("chunk-study", ("--src", need), ("--pairs", need), ("--out", need), ("--models", {"nargs": "+", "default": ["words-256", "grams-256"]}), ("--k-values", {"default": ""}))
    add("visualize", ("--corpus", need), ("--pairs", need), ("--out", need), ("--model", {"default": "words-256"}))
    add("eval", ("--passages", need), ("--pairs", need), ("--k-values", {"default": ""}), ("--dims", {"type": int, "default": 256}), ("--template", {"default": "bge"}), ("--detailed", flag), ("--report", {"default": ""}), ("--compare-dims", {"nargs": "+", "type": int}), ("--compare-models", {"nargs": "+"}), ("--model", {"default": ""}))
    add("failed", ("--passages", need), ("--pairs", need), ("--k-values", {"default": ""}), ("--dims", {"type": int, "default": 256}))
    add("analyze-passages", ("--corpus", need), ("--min-text-length", {"type": int, "default": 10}), ("--tokenizer", {"default": ""}))
    add("analyze-pairs", ("--pairs", need), ("--corpus", {"default": ""}), ("--tokenizer", {"default": ""}), ("--samples", {"type": int, "default": 5}))
    add("crawl", ("--search-url", need), ("--detail-url", need), ("--first", {"type": int, "default": 1}), ("--last", need | {"type": int}), ("--delay", {"type": float, "default": 1.0}), ("--out", need))
    add("config", ("--file", {"default": ""}), ("--set", {"nargs": "*", "default": []}))
    a = parser.parse_args(args)
    if a.command == "config":
        held = json.loads(Path(a.file).read_text(encoding="utf-8")) if a.file else {}
        print(json.dumps(config.overridden(held, a.set), ensure_ascii=False, indent=2))
        return
    spark = SparkSession.builder.appName("passagework").getOrCreate()
    ship(spark)
    if a.command == "preprocess":
        preprocess(spark, a.src, a.out, a.include_items, a.anchored, a.glob, a.append, a.types, a.chunk_size, a.chunk_overlap)
    elif a.command == "chunk":
        rows = tables.corpus_texts(spark.read.json(a.input))
        held = tokens.FileTokenizer(a.tokenizer) if a.tokenizer else tokens.PieceTokenizer()
        cuts = tokens.token_windows(rows, "text", held, a.max_tokens, a.overlap)
        tables.write_jsonl(cuts.select(F.concat_ws("_", "id", F.col("window_no") + 1).alias("id"), F.col("id").alias("parent_id"), "start", "n_tokens", F.col("chunk").alias("text")), a.out)
    elif a.command == "search":
        asked = tables.read_queries(spark, a.queries, a.id_field, a.text_field)
        coded = models.named(a.model, mode=encode.TemplateMode.of(a.template)).encode_queries(asked, F.col("query_text"))
        tables.write_jsonl(index.search(index.open_index(spark, a.index), coded, a.k, a.probes), a.out)
    elif a.command == "chunk-study":
        rows = cut(study(spark, a.src, a.pairs, a.models, metrics.parse_ks(a.k_values)))
        tables.write_jsonl(rows, a.out)
        print(reports.markdown([r.asDict() for r in rows.orderBy("unit", "model", "k").collect()], "Units of chunking"))  # a row a unit, model and k
    elif a.command == "visualize":
        visualize(spark, a.corpus, a.pairs, models.named(a.model), a.out)
    elif a.command == "merge":
        parts = [read(spark, p).withColumn("pos", F.monotonically_increasing_id()) for p in a.inputs]
        tables.write_jsonl(corpus.merge_corpora(*parts), a.out)
    elif a.command == "concat":
        tables.concat_jsonl(spark, a.inputs, a.out, a.gzip)
    elif a.command == "gen-data":
        done = gen_data(spark, a.folder, a.out, a.hn_per_q, a.max_positives_per_prec, a.seed, not a.no_cross, a.use_admin_for_prec, not a.prec_passages)
        done.groupBy("split").count().show()
        parts = [read(spark, f"{a.folder}/{name}").select("id") for name in ("law", "admin", "prec")]
        report_validity(done.select("query_id", "query_text", "positive_passages", "hard_negatives", "meta"), corpus.union_ranked(*parts).select("id").distinct(), "query_id")
    elif a.command == "validate":
        p, docs = tables.read_jsonl(spark, a.pairs, PAIR), read(spark, a.corpus)
        found = pairs.structure_errors(F.col("query_id"), F.col("query_text"), F.col("positive_passages"), F.col("hard_negatives"))
        p.select(F.explode(found).alias("error")).groupBy("error").count().show()
        p.groupBy("query_id").count().where("count > 1").show()
        for column in ("positive_passages", "hard_negatives"):
            pairs.missing_ids(p, docs, column).show()
        report_validity(p, docs, "query_id")
    elif a.command == "embed":
        rows = tables.corpus_texts(spark.read.json(a.input), a.id_field, a.text_field, a.limit)
        mode = encode.TemplateMode.of(a.template)
        if a.model:
            model = models.named(a.model, a.tokenizer or None, mode)
            coded = (model.encode_queries if a.type == "query" else model.encode_passages)(rows, F.col("text"))
        else:
            coded = encode.encode(rows.withColumn("t", encode.template(F.col("text"), a.type, mode)), F.col("t"), encode.HashingEncoder(a.dims), max_words=a.max_words)
        tables.write_embeddings(coded.withColumn("vector", vectors.l2_normalize(F.col("vector")).cast("array<float>")) if a.normalize else coded, a.out)
        if a.index:
            index.build(spark.read.parquet(a.out).withColumnRenamed("id", "doc_id"), a.index, a.cells)
        if a.npz:
            tables.export_npz(spark.read.parquet(a.out), a.npz)
        if a.arrays:
            tables.export_arrays(spark.read.parquet(a.out), a.arrays, a.output_format)
    elif a.command == "eval":
        ks = metrics.parse_ks(a.k_values)
        if a.compare_models:
            text = evaluation.comparison_report({n: evaluate(spark, a.passages, a.pairs, ks, n, a.template) for n in a.compare_models})
        elif a.compare_dims:
            text = evaluation.comparison_report({f"hashing-{n}": evaluate(spark, a.passages, a.pairs, ks, n, a.template) for n in a.compare_dims})
        else:
            found = evaluate(spark, a.passages, a.pairs, ks, a.model or a.dims, a.template)
            text = evaluation.detailed_report(found) if a.detailed or a.report else reports.markdown([r.asDict() for r in found.means().collect()], "Evaluation")
        print(text)
        if a.report:
            Path(a.report).write_text(text, encoding="utf-8")
    elif a.command == "failed":
        evaluate(spark, a.passages, a.pairs, metrics.parse_ks(a.k_values), a.dims).failed().orderBy("query_id").show(truncate=60)
    elif a.command == "analyze-passages":
        docs = read(spark, a.corpus)
        corpus.duplicate_summary(docs, min_len=a.min_text_length).show()
        analysis.passage_statistics(docs, tokens.FileTokenizer(a.tokenizer) if a.tokenizer else None).orderBy("measure", "source").show()
        corpus.duplicate_groups(docs, "id", top=20).show()
    elif a.command == "crawl":
        tables.write_jsonl(crawl(spark, a.search_url, a.detail_url, a.first, a.last, a.delay), a.out)
    else:
        p = cut(tables.read_jsonl(spark, a.pairs, PAIR))
        held = read(spark, a.corpus).select("id", "text") if a.corpus else spark.createDataFrame([], "id string, text string")
        analysis.type_summary(p).orderBy(F.desc("pairs"), "type").show()
        analysis.pair_statistics(p, held, tokens.FileTokenizer(a.tokenizer) if a.tokenizer else None).orderBy("measure").show()
        analysis.sample_pairs(p, a.samples).show(truncate=60)


if __name__ == "__main__":
    main()
