"""What executors need before Python functions of this package can run there; the shared folder; cutting lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of one Arrow batch handed to Python, if the session sets none (Spark's own bound is eight times that).
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, so that they need no install; and bound what
    their Python holds at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_passagework_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="passagework-")), "passagework.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "passagework").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(archive)
    context._passagework_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and everything runs on one machine (``local`` masters) a folder of its
    own is made; on a cluster the lack of the setting is an error, as other machines wouldn't see it.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='passagework-')}"
    context.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder, so that plans built on it stay small."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its files make fewer tasks than that (a small table in one
    row group); a table of more tasks than cores is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
