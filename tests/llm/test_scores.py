"""The registered classifiers: folds, thresholds and held-out accuracy."""

from __future__ import annotations

import zlib
from pathlib import Path

import pytest

from passagework.llm import registry


@pytest.mark.parametrize(("name", "label", "folds", "held", "least"), [("op5_quality", "quality", 5, 0, 0.95), ("op8_toxicity", "toxic", 4, 2, 0.9)])
def test_registered_scores(spark, data, name, label, folds, held, least):
    folder = Path(data).parent / "sf0.01"
    folder = str(folder) if folder.is_dir() else data
    found = {r["doc_id"]: r for r in registry.QUERIES[name](spark, folder).collect()}
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % folds == held)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    unseen = [found[i]["predicted"] == y for i, y in known.items() if found[i]["held_out"]]
    assert len(unseen) > 50
    assert sum(unseen) / len(unseen) >= least
