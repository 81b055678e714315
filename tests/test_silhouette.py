"""Euclidean silhouette against all pairs of rows."""

import numpy as np
import pandas as pd
import pytest

from tabweave.operators.silhouette import silhouette_euclidean


def brute(x, g):
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    out = []
    for i, own in enumerate(g):
        same = g == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, g == k].mean() for k in set(g) - {own})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(out)


@pytest.fixture(scope="module")
def frame():
    r = np.random.default_rng(5)
    g = r.integers(0, 3, 900)
    x = np.array([[0, 0, 0], [4, 1, 0], [1, 5, 2]])[g] + r.normal(size=(900, 3))
    x[g == 2] = np.where(r.uniform(size=((g == 2).sum(), 1)) < 0.6, [1.0, 5.0, 2.0], x[g == 2])  # a hot point
    out = pd.DataFrame(x, columns=["x", "y", "z"]).assign(g=np.array(["a", "b", "c"])[g])
    return pd.concat([out, pd.DataFrame({"x": [9.0], "y": [9.0], "z": [0.0], "g": ["alone"]})], ignore_index=True)


@pytest.mark.parametrize("tolerance, cells", [(0.0, 50_000), (0.01, 50_000), (0.05, 500), (0.01, 20)])
def test_within_the_stated_error(spark, frame, tolerance, cells):
    got = silhouette_euclidean(spark.createDataFrame(frame).repartition(5), "g", ["x", "y", "z"], tolerance, cells).first()
    want = brute(frame[["x", "y", "z"]].to_numpy(), frame.g.to_numpy())
    assert abs(got.silhouette - want) <= got.error + 1e-9
    assert got.n_clusters == 4 and got.n_used == 901
    if cells == 50_000:
        assert got.error <= 2 * tolerance + 1e-6
    if cells == 20:
        # too few cells for the tolerance: the error says so
        assert got.error > tolerance


def test_noise_missing_values_and_errors(spark):
    rows = [(1.0, 0), (None, 0), (5.0, 1), (5.0, 1), (99.0, -1), (3.0, None), (5.5, 2)]
    df = spark.createDataFrame(rows, "`a.b` double, k int")
    got = silhouette_euclidean(df, "k", ["a.b"], 0.0).first()
    want = brute(np.array([[1.0], [0.0], [5.0], [5.0], [5.5]]), np.array([0, 0, 1, 1, 2]))
    assert got.n_used == 5 and got.n_clusters == 3 and got.silhouette == pytest.approx(want, abs=1e-6)
    for bad in (df.where("k = 0"), df.limit(0)):
        with pytest.raises(ValueError):
            silhouette_euclidean(bad, "k", ["a.b"])
    many = spark.range(3000).selectExpr("cast(id as double) x", "id k")
    with pytest.raises(ValueError):
        silhouette_euclidean(many, "k", ["x"], cells=1000)
    assert silhouette_euclidean(many, "k", ["x"]).first().silhouette == 0
