"""Shared folders, batch limits and small expressions used by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.cluster import shared_root, ship

#: Rows in one Arrow batch handed to Python; texts may be long, so batches are small.  One number for
#: all operators, as the setting is the session's and plans are run later than they are built.
BATCH_ROWS = 200


def batch_rows(spark: SparkSession) -> None:
    """Bound the rows (and so the bytes) that one Python worker holds at once."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._passagework_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no plan reads any more."""
    for df in tables:
        path = getattr(df, "_passagework_path", None)
        if path:
            context = df.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_print(text: Column) -> Column:
    """Hash that tells texts under one identifier apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
