"""Rounding keeps the mass, the caps and the shares; buckets and the tree lose no document."""

import numpy as np
import pytest

from folio.llm import mixing as M

DOCS = "doc_id long, source string, text string, copies int"
TARGETS = "source string, target_share double, max_repeats int"


def test_pivot_keeps_mass():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(0, 60))
        p, w = rng.random(n), rng.integers(1, 500, n).astype(float)
        out = M.pivot(p, w, rng)
        assert np.isclose((p * w).sum(), (out * w).sum()) and ((out > 0) & (out < 1)).sum() <= 1 and ((out >= 0) & (out <= 1)).all()


def test_pivot_keeps_expectation():
    p, w = np.array([0.2, 0.5, 0.7, 0.4]), np.array([1.0, 7.0, 3.0, 2.0])
    mean = np.mean([M.pivot(p, w, np.random.default_rng(k)) for k in range(20_000)], axis=0)
    assert np.abs(mean - p).max() < 0.02


@pytest.mark.parametrize("bucket", [20_000, 11])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET", bucket)
    monkeypatch.setattr(M, "FAN_IN", 3)
    rows = [(i, "big" if i % 4 else "small", "some words " * (1 + i % 9), 1) for i in range(400)]
    rows += [(1000, "big", None, 1), (1001, "big", "", 1), (1002, None, "text", 1), (1003, "other", "text", 1), (1004, "nan", "text", 1)]
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.5, 3), ("gone", 0.0, 2), (None, 0.3, 1), ("nan", float("nan"), 2)], TARGETS)
    mixed = M.mix(spark.createDataFrame(rows, DOCS), targets)
    got = mixed.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and {r["source"] for r in got} == {"big", "small"}
    assert all(1 <= r["copies"] <= (2 if r["source"] == "big" else 3) for r in got)
    shares = {r["source"]: r for r in M.shares(mixed, targets).collect()}
    assert abs(shares["big"]["reached_share"] - 0.5) < 0.01
    # the scarce source is used to its cap
    assert shares["small"]["copies"] == 300


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mixed = M.mix(docs, targets)
    assert mixed.count() == 0 and [r["tokens"] for r in M.shares(mixed, targets).collect()] == [0]
