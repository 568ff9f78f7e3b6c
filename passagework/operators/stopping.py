"""Early stopping over logs of metrics: which metric counts, and when a run would have stopped.

A log has a row for each metric of an evaluation (run, step, metric, value).  ``chosen`` takes the metric that
a key means.  ``early_stopping`` goes over the evaluations of each run in order of their steps, as a
fold whose state is the best value so far and how many evaluations ago it was.  With a margin
(``min_delta``) the best value isn't the largest so far, so no window function has it; and a run
may be most of the log.  The log is therefore dealt out by range of (run, step): every task sums up what
its first and last run make of any state before them, those few summaries are chained, and every task
then folds its rows from the state that reached it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.cluster import cut


def search_keys(key: str) -> list[str]:
    """Names under which the metric ``key`` may be logged, the likeliest first; losses only if ``key`` is one."""
    at = key.replace("@", "_at_")
    names = [key, f"val_{key}", f"cosine_{key}", at, f"val_{at}"]
    if "cosine_" in key:
        bare = key.replace("cosine_", "")
        names += [f"val_{bare}", bare.replace("@", "_at_"), f"val_{bare.replace('@', '_at_')}"]
    return [n for n in dict.fromkeys(names) if "loss" in key.lower() or "loss" not in n.lower()]


def chosen(log: DataFrame, key: str, run: str = "run", step: str = "step", metric: str = "metric", value: str = "value") -> DataFrame:
    """run, step and value of the metric that ``key`` means: of an evaluation's names the first of
    ``search_keys``; evaluations without any are left out, as are null values, runs and steps.  Of several
    values under one name the largest counts."""
    place = F.array_position(F.array(*map(F.lit, search_keys(key))), F.col(metric))
    rows = log.select(F.col(run).alias("run"), F.col(step).alias("step"), place.alias("_p"), F.col(value).cast("double").alias("value"))
    rows = rows.where("_p > 0 and value is not null and run is not null and step is not null")
    best = rows.groupBy("run", "step").agg(F.min(F.struct("_p", -F.col("value"))).alias("_v"))
    return best.select("run", "step", (-F.col("_v.col2")).alias("value"))


@dataclass
class Seen:
    """The state after some evaluations: the best value, its step, and how many have passed since."""

    best: float = -np.inf
    step: int | None = None
    waited: int = 0

    def then(self, step: int, value: float, delta: float) -> bool:
        """One more evaluation; whether it was better."""
        if value > self.best + delta:
            self.best, self.step, self.waited = value, step, 0
            return True
        self.waited += 1
        return False


@dataclass
class Summary:
    """What a stretch of one run makes of any state before it.

    Only rows above all before them can be better whatever the state was; ``tops`` are these (value,
    step, place), in order, so the first that beats a state starts the rest of the chain.
    """

    tops: list[tuple[float, int, int]]
    rows: int = 0

    def add(self, step: int, value: float) -> None:
        if value == value and (not self.tops or value > self.tops[-1][0]):
            self.tops.append((value, step, self.rows))
        self.rows += 1

    def after(self, seen: Seen, delta: float) -> Seen:
        out, last = Seen(seen.best, seen.step, seen.waited), None
        for value, step, place in self.tops:
            if value > out.best + delta:
                out.best, out.step, last = value, step, place
        out.waited = out.waited + self.rows if last is None else self.rows - 1 - last
        return out


def early_stopping(evaluations: DataFrame, patience: int = 3, warmup: int = 0, larger_is_better: bool = True, min_delta: float = 0.0, parts: int | None = None) -> DataFrame:
    """run, step, value, improved, best, best_step, waited, allowed and stops, a row an evaluation.

    ``evaluations``: run, step (a whole number), value; equal steps of a run in order of the value.
    ``allowed`` is the patience, half as much again (rounded down) up to twice the warm-up; ``stops``
    is true from the first evaluation on at which that many have passed without gain, and until
    the next gain.  NaN is never a gain.
    """
    sign = 1.0 if larger_is_better else -1.0
    parts = parts or int(evaluations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = evaluations.select("run", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value")).where("run is not null and step is not null and value is not null")
    dealt = cut(rows.repartitionByRange(parts, "run", "step", "value").sortWithinPartitions("run", "step", "value").withColumn("part", F.spark_partition_id()))
    kind = rows.schema["run"].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> Iterator[tuple[object, int, float]]:
        return zip(batch.column("run").to_pylist(), batch.column("step").to_pylist(), (sign * batch.column("value").to_numpy()).tolist(), strict=True)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The summaries of a task's first and last run: no other can go on elsewhere."""
        first: tuple[object, Summary] | None = None
        now: tuple[object, Summary] | None = None
        part = None
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for run, step, value in each(batch):
                if now is None or now[0] != run:
                    first, now = first or now, (run, Summary([]))
                now[1].add(step, value)
        held = [x for x in (first, now) if x is not None]
        if held:
            tops = [[{"v": v, "s": s, "p": p} for v, s, p in x.tops] for _, x in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(held), pa.int32()), pa.array([r for r, _ in held], runs), pa.array([x.rows for _, x in held]), pa.array(tops, pa.list_(pa.struct([("v", pa.float64()), ("s", pa.int64()), ("p", pa.int64())])))],
                ["part", "run", "rows", "tops"],
            )

    runs = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    summaries = dealt.mapInArrow(ends, f"part int, run {kind}, rows long, tops array<struct<v: double, s: long, p: long>>")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple[object, Seen] | None = None
        for batch in batches:
            for r in batch.to_pylist():
                seen = state[1] if state is not None and state[0] == r["run"] else Seen()
                if seen.step is not None or seen.waited:
                    yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["run"]], runs), pa.array([seen.best]), pa.array([seen.step], pa.int64()), pa.array([seen.waited])], ["part", "run", "best", "step", "waited"])
                state = r["run"], Summary([(t["v"], t["s"], t["p"]) for t in r["tops"]], r["rows"]).after(seen, min_delta)

    # two summaries a task, one after the other
    entered = summaries.repartition(1).sortWithinPartitions("part", "run").mapInArrow(chain, f"part int, run {kind}, best double, step long, waited long")
    begins = {(r["part"], r["run"]): (r["best"], r["step"], r["waited"]) for r in entered.collect()}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_now, seen = None, Seen()
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else None
            out: list[tuple] = []
            for run, step, value in each(batch):
                if run != run_now:
                    run_now, seen = run, Seen(*begins.get((part, run), (-np.inf, None, 0)))
                better = seen.then(step, value, min_delta)
                allowed = int(patience * 1.5) if warmup > 0 and step <= 2 * warmup else patience
                out.append((better, sign * seen.best if seen.step is not None else None, seen.step, seen.waited, allowed, seen.waited >= allowed))
            made = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("run", "step", "value")), *(pa.array(x, t) for x, t in zip(made, kinds, strict=True))], ["run", "step", "value", "improved", "best", "best_step", "waited", "allowed", "stops"])

    return dealt.mapInArrow(fold, f"run {kind}, step long, value double, improved boolean, best double, best_step long, waited long, allowed long, stops boolean")


def stops(folded: DataFrame) -> DataFrame:
    """run, evaluations, stopped (the step of the first stop, or null), and best and best_step as they were then
    (or at the end)."""
    at = F.min(F.when(F.col("stops"), F.struct("step", "best", "best_step")))
    last = F.max(F.struct("step", "value", "best", "best_step"))
    rows = folded.groupBy("run").agg(F.count(F.lit(1)).alias("evaluations"), at.alias("a"), last.alias("l"))
    return rows.select("run", "evaluations", F.col("a.step").alias("stopped"), F.coalesce("a.best", "l.best").alias("best"), F.coalesce("a.best_step", "l.best_step").alias("best_step"))
