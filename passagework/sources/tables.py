"""Reading tables, JSON and text corpora; writing corpora, embeddings and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.cluster import spread
from passagework.functions import text as X
from passagework.functions.order import number_rows
from passagework.operators.chunks import chunk_rows
from passagework.operators.corpus import last_wins

#: Rows that an export to a single local file may have.
MAX_EXPORT = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` seen as passages: id, parent_id, grp, type, text."""
    d = spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    return d.select("doc_id", F.concat(F.lit("DOC_"), F.col("doc_id").cast("string")).alias("id"), F.expr("doc_id div 5").alias("parent_id"), F.col("source").alias("grp"), F.col("lang").alias("type"), "text")


def read_json_files(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Whole-file JSON below ``path``: (file, js as VARIANT) and the files that don't parse."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).withColumn("js", F.try_parse_json("raw"))
    return rows.where("js is not null").select("file", "raw", "js"), rows.where("js is null").select("file", "raw")


def in_file_order(rows: DataFrame, out: str = "file_no", file: str = "file") -> DataFrame:
    """``rows`` with ``out``, the place of their file among all files in order of the path (from 0).

    Only the paths are sorted; the numbers are joined back to the rows.
    """
    numbered = number_rows(rows.select(file).where(F.col(file).isNotNull()).distinct(), file, out=out, first=0)
    return rows.join(numbered, file, "left")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, gzipped or not; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_queries(spark: SparkSession, path: str, id_field: str = "id", text_field: str = "question") -> DataFrame:
    """query_id and query_text of a file of questions."""
    raw = read_jsonl(spark, path, f"`{id_field}` string, `{text_field}` string")
    return raw.select(F.col(id_field).alias("query_id"), F.col(text_field).alias("query_text"))


def concat_jsonl(spark: SparkSession, paths: list[str], out: str, gzip: bool = False) -> None:
    """JSON-lines files one after the other into one folder, line by line, nothing dropped but blank lines."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    lines.write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(out)


def load_passages(spark: SparkSession, path: str, schema: T.StructType | str, order: str) -> DataFrame:
    """A corpus by id; the last row of an id, by ``order``, wins."""
    return last_wins(read_jsonl(spark, path, schema), ["id"], [order])


def read_texts(spark: SparkSession, path: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Chunks of the ``*.txt`` files below ``path``: id ``stem::p0000``, source, text."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    stem = F.regexp_replace(F.element_at(F.split("_metadata.file_name", "/"), -1), r"\.txt$", "")
    cut = chunk_rows(raw.select(stem.alias("stem"), F.col("_metadata.file_name").alias("source"), "value"), F.col("value"), size, overlap, strip=True)
    number = X.zfill((F.col("chunk_no") - 1).cast("string"), 4)
    return cut.select(F.concat("stem", F.lit("::p"), number).alias("id"), "source", F.col("chunk").alias("text"))


def corpus_texts(df: DataFrame, id_field: str = "id", text_field: str = "text", limit: int | None = None) -> DataFrame:
    """id and text as strings for an encoder; an empty corpus is an error."""
    out = df.select(F.col(id_field).cast("string").alias("id"), F.col(text_field).cast("string").alias("text"))
    out = out.orderBy("id").limit(limit) if limit else out
    if out.isEmpty():
        raise ValueError("the corpus is empty")
    return out


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", gzip: bool = False) -> None:
    if mode == "append" and gzip:
        raise ValueError("compressed files can't be appended to")
    df.write.mode(mode).option("compression", "gzip" if gzip else "none").json(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    """id and vector as Parquet, the form that search reads."""
    df.select("id", "vector").write.mode("overwrite").parquet(path)


def export_arrays(df: DataFrame, folder: str, kind: str = "npy", limit: int = MAX_EXPORT) -> int:
    """Embeddings in order of id as local files, for sets of a bounded size: ``embeddings.npz`` (both
    arrays), or ``embeddings.npy`` with ``ids.npy``, or all (``both``); always ``ids.txt``, an id a line."""
    import numpy as np

    if kind not in ("npz", "npy", "both"):
        raise ValueError("the kind of file is npz, npy or both")
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    n = export_npz(df, str(target / "embeddings.npz"), limit)
    with np.load(target / "embeddings.npz", allow_pickle=True) as held:
        ids, vectors = held["ids"], held["embeddings"]
    (target / "ids.txt").write_text("".join(f"{i}\n" for i in ids), encoding="utf-8")
    if kind != "npz":
        np.save(target / "embeddings.npy", vectors)
        np.save(target / "ids.npy", ids)
    if kind == "npy":
        (target / "embeddings.npz").unlink()
    return n


def export_npz(df: DataFrame, path: str, limit: int = MAX_EXPORT) -> int:
    """ids and embeddings as one local ``.npz``, for sets of a bounded size."""
    import numpy as np

    n = df.count()
    if n > limit:
        raise ValueError(f"{n} rows are more than {limit}; read the Parquet table instead")
    rows = df.select("id", "vector").orderBy("id").collect()
    np.savez(path, ids=np.array([r["id"] for r in rows], dtype=object), embeddings=np.array([r["vector"] for r in rows], np.float32))
    return n


def write_report(report: dict, path: str) -> None:
    """A small report of the driver as readable JSON."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(report, ensure_ascii=False, indent=2), encoding="utf-8")
