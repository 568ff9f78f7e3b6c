"""Streams: early stopping with state between batches, arrivals by window."""

from __future__ import annotations

import json
import random

from passagework.streaming import ingest, monitor
from tests import legal_records as L
from tests.test_stopping import loop


def test_state_lives_between_batches(spark, tmp_path):
    draw = random.Random(3)
    rows = {run: [(s, float(draw.randrange(5))) for s in range(1, n + 1)] for run, n in (("a", 25), ("b", 9), ("c", 1))}
    (tmp_path / "log").mkdir()
    for part in range(3):
        lines = [{"run": run, "step": s, "metric": m, "value": v} for run, held in rows.items() for s, v in held if s % 25 // 9 == part for m in ("ndcg", "loss")]
        draw.shuffle(lines)
        (tmp_path / "log" / f"{part}.json").write_text("".join(json.dumps(x) + "\n" for x in [*lines, {"run": "a", "step": None, "metric": "ndcg", "value": 1.0}]))
        found = monitor.watch(monitor.log_stream(spark, f"file://{tmp_path}/log"), "ndcg", 2, warmup=3, min_delta=0.5)
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    seen = [tuple(r) for r in spark.read.schema(monitor.OUT).parquet(str(tmp_path / "out")).collect()]
    in_order = {run: sorted(held, key=lambda x: (x[0] % 25 // 9, x[0])) for run, held in rows.items()}
    for run, held in in_order.items():
        assert sorted(r[1:] for r in seen if r[0] == run) == sorted(loop(held, 2, 3, True, 0.5))


def test_arrivals_by_window(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, record in L.RECORDS.items():
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(record, ensure_ascii=False), encoding="utf-8")
    stream = ingest.arrivals(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").outputMode("complete")
    stream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    counts = {r["type"]: r["n"] for r in spark.sql("select type, sum(files) as n from arrived group by type").collect()}
    assert counts == {"law": 2, "admin": 2, "prec": 3, "unknown": 2}
