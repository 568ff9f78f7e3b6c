"""Sources of passages and queries, censuses of files, token costs, evaluation results, sinks."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import text as X
from passagework.functions import variant as V
from passagework.operators import legal

#: Fixed names of sources by type.
SOURCES = {"법령": ("법령", "law"), "행정규칙": ("행정규칙", "admin"), "판례": ("판례", "prec")}
OTHER = "기타"


def query_source(kind: Column, mined: bool = False) -> Column:
    """The source of a query by its type; ``mined`` counts mined precedent pairs as precedents."""
    out = F.when(kind.isin("prec_to_law_admin", "prec_fallback"), "판례") if mined else None
    for name, kinds in SOURCES.items():
        out = F.when(kind.isin(*kinds), name) if out is None else out.when(kind.isin(*kinds), name)
    return out.otherwise(OTHER)


def passage_source(ident: Column, kind: Column) -> Column:
    """The source of a passage by its id's prefix, else by its type."""
    out = F.when(ident.startswith("LAW_"), "법령").when(ident.startswith("ADMIN_"), "행정규칙").when(ident.startswith("PREC_"), "판례")
    return out.otherwise(query_source(kind))


def shape_census(files: DataFrame) -> DataFrame:
    """shape and number of (file, js), js null where a file doesn't parse."""
    js = F.col("js")
    has = lambda *keys: F.coalesce(*[F.when(V.at(js, k).isNotNull(), True) for k in keys], F.lit(False))
    shape = (
        F.when(js.isNull(), "invalid_json")
        .when(V.is_array(js), "list_top")
        .when(~V.is_object(js), "other_top")
        .when(has("PrecService"), "dict_PrecService")
        .when(has(*legal.PREC_LIST_KEYS), "dict_list_wrapper")
        .when(has(*legal.PREC_KEYS), "dict_flat")
        .otherwise("dict_other")
    )
    return files.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("files"))


def file_counts(files: DataFrame, passages: DataFrame) -> DataFrame:
    """type, files, empty ones and passages of preprocessed files; ``passages`` has their file."""
    own = passages.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    typed = files.select("file", legal.detect_type(F.col("js")).alias("type")).join(own, "file", "left")
    return typed.groupBy("type").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("n").isNull(), 1)).alias("empty"), F.coalesce(F.sum("n"), F.lit(0)).alias("passages"))


def chunk_tokens(df: DataFrame, unit: str) -> DataFrame:
    """n, total and mean words and mean characters of each unit of chunking."""
    tokens = df.select(unit, X.count_tokens(F.col("text")).alias("t"), F.length("text").alias("c"))
    return tokens.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("total_tokens"), F.avg("t").alias("avg_tokens"), F.avg("c").alias("avg_chars"))


def token_saving(stats: DataFrame, unit: str, base: str, ks: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Context of k passages of each unit, and what it saves against ``base`` (a row a unit)."""
    against = stats.where(F.col(unit) == base).select(F.col("avg_tokens").alias("base_tokens"))
    rows = stats.crossJoin(F.broadcast(against)).withColumn("k", F.explode(F.array(*map(F.lit, ks))))  # one row against few
    saved = (F.col("base_tokens") - F.col("avg_tokens")) * F.col("k")
    return rows.select(unit, "k", (F.col("avg_tokens") * F.col("k")).alias("tokens"), saved.alias("saved"), F.when(F.col("base_tokens") > 0, saved / (F.col("base_tokens") * F.col("k")) * 100).otherwise(0.0).alias("saved_percent"))


def evaluation_results(spark: SparkSession, folder: str) -> DataFrame:
    """unit, model, metric, value of the ``{unit}_{model}.json`` files of a folder."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    named = raw.select(F.regexp_extract("_metadata.file_name", r"^(paragraph|item|article)_(.*)\.json$", 1).alias("unit"), F.regexp_extract("_metadata.file_name", r"^(paragraph|item|article)_(.*)\.json$", 2).alias("model"), F.try_parse_json("value").alias("js"))
    js = F.col("js")
    values = F.try_variant_get(F.coalesce(V.at(js, "metrics"), js), "$", "map<string,variant>")
    rows = named.where("unit <> '' and js is not null").select("unit", F.replace("model", F.lit("_"), F.lit("/")).alias("model"), F.explode(values).alias("metric", "v"))
    return rows.select("unit", "model", X.metric_key(F.col("metric")).alias("metric"), F.try_variant_get("v", "$", "double").alias("value")).where("value is not null")


def leaderboard(results: DataFrame, metric: str = "ndcg_at_10") -> DataFrame:
    """Models by their value of ``metric``, missing ones as 0."""
    return results.groupBy("unit", "model").agg(F.coalesce(F.max(F.when(F.col("metric") == metric, F.col("value"))), F.lit(0.0)).alias(metric)).orderBy(F.desc(metric), "model", "unit")


class MetricsLog:
    """Parameters and metrics of runs as JSON lines on the driver."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def _put(self, kind: str, step: int | None, values: dict) -> None:
        with self.path.open("a", encoding="utf-8") as out:
            out.write(json.dumps({"kind": kind, "time": time.time(), "step": step, **values}, ensure_ascii=False) + "\n")

    def params(self, **values: object) -> None:
        self._put("params", None, values)

    def metrics(self, values: dict[str, float], step: int | None = None) -> None:
        clean = {f"eval/{k.removeprefix('val_').removeprefix('cosine_').replace('@', '_at_')}": float(v) for k, v in values.items()}
        self._put("metrics", step, clean)


def markdown(rows: list[dict], title: str) -> str:
    """A table of a few rows."""
    names = list(rows[0]) if rows else []
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(f"{r[n]:.4f}" if isinstance(r[n], float) else str(r[n]) for n in names) + " |" for r in rows)]) + "\n"
