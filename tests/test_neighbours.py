"""Nearest-neighbour mutual information against brute force over all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabweave.operators.neighbours import neighbour_distances, neighbour_information, psi


def harmonic(n):
    return np.concatenate([[np.nan], np.concatenate([[0], np.cumsum(1 / np.arange(1, n + 1))]) - np.euler_gamma])


def brute(x, y, k):
    x, y = (v / (v.std() or 1.0) + 0.0 for v in (np.asarray(x, float), np.asarray(y, float)))
    d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    np.fill_diagonal(d, np.inf)
    e = np.sort(d, axis=1)[:, k - 1]
    table = harmonic(len(x))

    def count(v):
        near = np.abs(v[:, None] - v) < (e * (1 - 1e-12) - 1e-14 * np.abs(v))[:, None]
        return np.where(e == 0, (v == v[:, None]).sum(1), near.sum(1))
    return max(0.0, table[len(x)] + table[k] - (table[count(x)] + table[count(y)]).mean())


@pytest.fixture(scope="module")
def frame():
    r = np.random.default_rng(8)
    n = 2000
    x = r.normal(size=n)
    return pd.DataFrame({
        "strong": x, "weak": x + 3 * r.normal(size=n), "none": r.uniform(size=n), "steps": np.round(x * 2),
        # a third of all rows in one value, and clumps of very different density
        "hot": np.where(np.arange(n) % 3 == 0, 7.0, x), "clumps": np.where(r.uniform(size=n) < 0.9, x * 1e-4, 50 * x),
        "target": np.where(np.arange(n) % 5 == 0, 1.0, x**2 + 0.2 * r.normal(size=n))})


def test_equal_to_brute_force(spark, frame):
    names = [n for n in frame.columns if n != "target"]
    got = {r.feature: r.importance for r in
           neighbour_information(spark.createDataFrame(frame), "target", k=3, cell=32).collect()}
    assert list(got) == names
    for n in names:
        assert got[n] == pytest.approx(brute(frame[n], frame.target, 3), abs=1e-9)
    assert got["strong"] > got["weak"] and got["none"] < 0.1


def brute_classes(x, g, k):
    x, g = np.asarray(x, float), np.asarray(g)
    rows = np.array([(g == v).sum() for v in g])
    x, g, rows = x[rows > 1], g[rows > 1], rows[rows > 1]
    x = x / (x.std() or 1.0) + 0.0
    d = np.abs(x[:, None] - x)
    np.fill_diagonal(d, np.inf)
    least = np.minimum(rows - 1, k)
    e = np.array([np.sort(d[i, g == g[i]])[least[i] - 1] for i in range(len(x))])
    near = np.abs(x[:, None] - x) < (e * (1 - 1e-12) - 1e-14 * np.abs(x))[:, None]
    around = np.where(e == 0, (x == x[:, None]).sum(1), near.sum(1))
    t = harmonic(len(x))
    return max(0.0, t[len(x)] + (t[least] - t[rows] - t[around]).mean())


def test_classes_equal_to_brute_force(spark, frame):
    r = np.random.default_rng(2)
    kind = np.where(frame.strong > 0.5, "up", np.where(frame.strong < -1, "down", "mid")).astype(object)
    kind[:4] = ["pair", "pair", "alone", None]
    kind[10:1000:3] = r.permutation(kind[10:1000:3])
    rows = frame[["strong", "none", "hot"]].assign(kind=kind)
    got = {x.feature: x.importance for x in neighbour_information(
        spark.createDataFrame(rows), "kind", cell=32, continuous_target=False).collect()}
    known = rows[rows.kind.notna()]
    for n in ("strong", "none", "hot"):
        assert got[n] == pytest.approx(brute_classes(known[n], known.kind, 3), abs=1e-9)
    assert got["strong"] > 0.2 > got["none"]
    alone = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, g string")
    assert neighbour_information(alone, "g", continuous_target=False).first().importance is None


def test_distances_of_weighted_points(spark):
    r = np.random.default_rng(3)
    p = pd.DataFrame({"x": r.integers(0, 40, 900) / 7.0, "y": r.integers(0, 3, 900) * 10.0})
    weighted = p.value_counts().rename("w").reset_index()
    got = neighbour_distances(spark.createDataFrame(weighted), 4, 8).toPandas()
    d = np.maximum(np.abs(p.x.values[:, None] - p.x.values), np.abs(p.y.values[:, None] - p.y.values))
    np.fill_diagonal(d, np.inf)
    want = p.assign(e=np.sort(d, axis=1)[:, 3]).drop_duplicates()
    both = want.merge(got, on=["x", "y"])
    assert len(both) == len(got) == len(weighted)
    assert np.allclose(both.e_x, both.e_y)


def test_missing_values_constant_and_small_tables(spark):
    rows = [(1.0, 5.0, 2.0), (None, 5.0, 3.0), (float("nan"), 5.0, 4.0), (2.0, 5.0, None), (3.0, 5.0, 9.0), (0.5, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, `b.c` double, t double")
    got = {r.feature: r.importance for r in neighbour_information(df, "t", k=2).collect()}
    assert got["a"] == pytest.approx(brute([1, 0, 0, 3, 0.5], [2, 3, 4, 9, 1], 2))
    assert got["b.c"] == pytest.approx(brute([5] * 5, [2, 3, 4, 9, 1], 2))
    assert [r.importance for r in neighbour_information(df, "t", k=5).collect()] == [None, None]
    assert neighbour_information(df.limit(0), "t").first().importance is None
    with pytest.raises(ValueError):
        neighbour_information(df, "t", k=0)


def test_psi(spark):
    got = spark.range(1, 2001).select("id", psi(F.col("id")).alias("p")).toPandas().sort_values("id")
    assert np.allclose(got.p, harmonic(2000)[1:2001], atol=1e-11)
