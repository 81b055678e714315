"""Exact top-k search against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import knn


def brute(rows, queries, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i in queries}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shape", ["clusters", "one vector", "odd"])
def test_against_all_pairs(spark, monkeypatch, shape):
    monkeypatch.setattr(knn, "BLOCK_ROWS", (16, 32))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 8)
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + r.normal(size=8) * 0.3).tolist()) for i in range(400)]
    if shape == "one vector":
        rows = [(i, [1.0, 2.0] if i % 3 else v[:2]) for i, v in rows]
    if shape == "odd":
        rows = rows[:60] + [(20, rows[20][1]), (500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8),
                            (None, rows[0][1]), (504, []), (510, []), (510, [1e12] * 8), (511, [3.0] * 3), (520, [1.0] * 3)]
    queries = {i for i, _ in rows if i is not None and i % 10 == 0}
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = sorted(map(tuple, knn.top_k(df, F.col("vec_id") % 10 == 0, 7).collect()))
    assert got == brute(rows, queries, 7)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.top_k(df, F.col("vec_id") % 10 == 0).count() == 0
