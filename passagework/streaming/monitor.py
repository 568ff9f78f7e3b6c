"""Early stopping on a stream of evaluations: the state of each run is kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from passagework.operators.stopping import Seen

LOG = "run string, step long, metric string, value double"
OUT = "run string, step long, value double, improved boolean, best double, best_step long, waited long, allowed long, stops boolean"


def log_stream(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """Metric logs (``LOG``) as JSON lines that arrive in ``folder``; ``files`` a batch at most."""
    reader = spark.readStream.schema(LOG)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(folder)


def watch(log: DataFrame, metric: str, patience: int = 3, warmup: int = 0, larger_is_better: bool = True, min_delta: float = 0.0) -> DataFrame:
    """A row for each evaluation of ``metric`` (its exact name) as of ``stopping.early_stopping``.

    Evaluations of a run are expected batch by batch in order of their steps; within a batch they are
    sorted.  A run's state is three numbers, so it stays small however long the run is.
    """
    sign = 1.0 if larger_is_better else -1.0

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, step, waited = state.get if state.exists else (-np.inf, None, 0)
        seen = Seen(best, step, waited)
        rows = pd.concat(list(frames)).sort_values(["step", "value"])  # of one run and batch
        out = []
        for at, value in zip(rows["step"].tolist(), rows["value"].tolist(), strict=True):
            better = seen.then(at, sign * value, min_delta)
            allowed = int(patience * 1.5) if warmup > 0 and at <= 2 * warmup else patience
            out.append((key[0], at, value, better, None if seen.step is None else sign * seen.best, seen.step, seen.waited, allowed, seen.waited >= allowed))
        state.update((float(seen.best), seen.step, seen.waited))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    rows = log.where(F.col("run").isNotNull() & F.col("step").isNotNull() & F.col("value").isNotNull() & (F.col("metric") == metric)).select("run", "step", "value")
    return rows.groupBy("run").applyInPandasWithState(fold, OUT, "best double, step long, waited long", "append", GroupStateTimeout.NoTimeout)
