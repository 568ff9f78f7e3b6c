"""Incremental preprocessing: new source files become passages, each id once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagework.operators import legal

ID, TEXT = "id", "text"


def source_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(file, js) of JSON files as they arrive, with their time of change; unreadable ones are left out."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    meta = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"), F.try_parse_json("value").alias("js"))
    return meta.where("js is not null")


def passages_of(files: DataFrame) -> DataFrame:
    """id, type and text of all passages of (file, js), whatever their type."""
    typed = legal.records(files.select("file", "js"))
    parts = (
        legal.statutes(typed.where("type = 'law'")),
        legal.rule_passages(typed.where("type = 'admin'")),
        legal.precedent_passages(legal.precedent_fields(typed.where("type = 'prec'"))),
    )
    first, *rest = [p.select(ID, "type", TEXT) for p in parts]
    for p in rest:
        first = first.unionByName(p)
    return first


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the passages of files that weren't seen before to the Parquet table ``out``, then stop.

    A passage id that the table has already is left out: the first one stays.  Each batch is a folder of
    its own, named by the batch's number and written as a whole, and compared with the batches before
    it alone: one that is repeated after a crash takes its own place again.
    """

    def add(batch: DataFrame, number: int) -> None:
        new = passages_of(batch).dropDuplicates([ID])
        try:
            known = spark.read.parquet(out).where(F.col("batch") < number).select(ID)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = None
        new = new if known is None else new.join(known, ID, "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = source_stream(spark, folder)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(spark: SparkSession, folder: str, lateness: str = "1 hour", every: str = "10 minutes") -> DataFrame:
    """Files by type and window of their time of change; later ones than ``lateness`` are dropped."""
    stream = source_stream(spark, folder).withWatermark("changed", lateness)
    return stream.groupBy(F.window("changed", every), legal.detect_type(F.col("js")).alias("type")).agg(F.count(F.lit(1)).alias("files"))
