import math
import time
from collections import Counter
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabweave.core.numeric import normal_quantile
from tabweave.core.special import rank_sum_tail
from tabweave.operators.charts import (box_stats, cumulative, density_curve, distribution_comparison, heatmap,
                                       histogram, line_series, pair_bins, qq_line, qq_points, scatter_bins, stacked_bar)
from tabweave.operators.correlation import correlation, correlation_matrix, get_correlation
from tabweave.operators.hypothesis import (_exact_u, anova_test, chi_square_test, kruskal_wallis_test, mann_whitney_test,
                                           normality_test, ttest_independent)
from tabweave.operators.metrics import (average_precision, classification_metrics, confusion_matrix,
                                        precision_recall_curve, regression_metrics, roc_auc, roc_curve)
from tabweave.operators.profile import detect_outliers
from tabweave.operators.selection import (correlation_filter, drop_low_importance, feature_importance,
                                          variance_filter)


def pairs_frame(spark, a, b):
    return spark.createDataFrame(list(zip([float(x) for x in a], [float(y) for y in b])), "a double, b double")


def tau_b(a, b):
    s = n1 = n2 = 0
    for i, j in combinations(range(len(a)), 2):
        x, y = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
        s, n1, n2 = s + x * y, n1 + (x != 0), n2 + (y != 0)
    return s / math.sqrt(n1 * n2)


# --- correlation ------------------------------------------------------------

def test_correlations_of_the_sample(trips, trips_pd):
    both = trips_pd[["Hours", "Load"]].astype(float).dropna()
    assert correlation(trips, "Hours", "Load") == pytest.approx(both.Hours.corr(both.Load))
    ranks = both.rank()
    assert correlation(trips, "Hours", "Load", "spearman") == pytest.approx(ranks.Hours.corr(ranks.Load))
    row = get_correlation(trips, "Hours", "Load").first()
    assert (row.strength, row.direction) == ("moderate", "positive")


@pytest.mark.parametrize("levels", [3, 40, 10_000])
def test_rank_correlations_with_ties(spark, levels):
    r = np.random.RandomState(1)
    a = r.randint(0, levels, 400).astype(float)
    b = a * 0.5 + r.randint(0, levels, 400)
    a[:130], b[:130] = 1.0, 2.0
    df = pairs_frame(spark, a, b)
    assert correlation(df, "a", "b", "kendall") == pytest.approx(tau_b(a, b))
    ranks = pd.DataFrame({"a": a, "b": b}).rank()
    assert correlation(df, "a", "b", "spearman") == pytest.approx(ranks.a.corr(ranks.b))


def test_ranks_over_slots(spark, monkeypatch):
    import tabweave.core.scan as scan
    monkeypatch.setattr(scan, "SMALL_TABLE", 0)
    r = np.random.RandomState(2)
    a, b = r.randint(0, 90, 300), r.randint(0, 70, 300)
    df = pairs_frame(spark, a, b)
    assert correlation(df, "a", "b", "kendall") == pytest.approx(tau_b(a, b))
    ranks = pd.DataFrame({"a": a, "b": b}).rank()
    assert correlation(df, "a", "b", "spearman") == pytest.approx(ranks.a.corr(ranks.b))


@pytest.mark.parametrize("small", [0, 100_000])
def test_rank_matrix_is_one_chain_of_jobs(spark, monkeypatch, small):
    import tabweave.core.scan as scan
    import tabweave.operators.correlation as corr
    monkeypatch.setattr(scan, "SMALL_TABLE", small)
    monkeypatch.setattr(corr, "BROADCAST_ROWS", small)
    r = np.random.RandomState(12)
    pdf = pd.DataFrame({f"x.{k}": r.randint(0, 4 + 30 * k, 250).astype(float) for k in range(6)})
    pdf["x.1"] += pdf["x.0"]
    pdf = pdf.mask(r.rand(*pdf.shape) < 0.1)
    pdf.loc[pdf.index % 3 == 0, ["x.2", "x.3"]] = 7.0
    df = spark.createDataFrame(pdf)
    cuts = []
    monkeypatch.setattr(corr, "cut_lineage", lambda d, own=corr.cut_lineage: cuts.append(1) or own(d))
    used = []
    for k in (2, 6):
        cuts.clear()
        got = {(r.x, r.y): r["corr"] for r in correlation_matrix(df, list(pdf.columns[:k]), "spearman").collect()}
        used.append(len(cuts))
        assert len(got) == k * (k - 1) // 2
        for (x, y), v in got.items():
            both = pdf[[x, y]].dropna().rank()
            assert v == pytest.approx(both[x].corr(both[y]))
    assert used[0] == used[1]


def test_constant_column_has_no_correlation(spark):
    df = pairs_frame(spark, [1, 1, 1], [1, 2, 3])
    assert [correlation(df, "a", "b", m) for m in ("pearson", "spearman", "kendall")] == [None] * 3


def test_matrix_is_the_lower_triangle(numbers):
    got = {(r.x, r.y): r["corr"] for r in correlation_matrix(numbers).collect()}
    want = numbers.toPandas().corr()
    assert len(got) == 6 and all(v == pytest.approx(want.loc[k]) for k, v in got.items())


# --- tests ------------------------------------------------------------------

def groups_frame(spark, **groups):
    return spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")


def test_welch(spark):
    row = ttest_independent(groups_frame(spark, a=[1, 2, 3, 4], b=[2, 4, 6, 8, 10]), "v", "g").first()
    assert row.t == pytest.approx((2.5 - 6) / math.sqrt(5 / 12 + 2)) and row.dof == pytest.approx(5.5207, abs=1e-3)
    assert 0.06 < row.p_value < 0.08 and not row.significant
    with pytest.raises(ValueError, match="exactly 2"):
        ttest_independent(groups_frame(spark, a=[1, 2], b=[1, 2], c=[1, 2]), "v", "g")


def test_anova_of_two_groups_is_a_squared_t(spark):
    row = anova_test(groups_frame(spark, a=[1, 2, 3], b=[3, 4, 5]), "v", "g").first()
    assert row.f == pytest.approx(6.0) and row.p_value == pytest.approx(0.0705, abs=1e-4)
    assert row.eta_squared == pytest.approx(0.6)


def test_chi_square(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 20, ("b", "y"): 10}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "g string, h string")
    row = chi_square_test(df, "g", "h").first()
    assert row.chi2 == pytest.approx(4 * 4.5 ** 2 / 15) and row.p_value == pytest.approx(0.0201, abs=1e-4)
    wide = spark.createDataFrame([("a", "x")] * 6 + [("b", "y")] * 6 + [("c", "z")] * 6, "g string, h string")
    row = chi_square_test(wide, "g", "h").first()  # six of nine cells are empty
    assert row.chi2 == pytest.approx(36.0) and row.cramers_v == pytest.approx(1.0)


# published examples of the tests
SAMPLE_1 = [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53,
            4.55, 0.47, 6.66]
WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def test_normality(spark):
    one = lambda xs, m: normality_test(spark.createDataFrame([(float(x),) for x in xs], "v double"), "v", m).first()
    row = one(SAMPLE_1, "shapiro")
    assert row.statistic == pytest.approx(0.900473, abs=1e-4) and row.p_value == pytest.approx(0.04209, abs=1e-3)
    row = one(WEIGHTS, "shapiro")
    assert row.statistic == pytest.approx(0.78881, abs=1e-4) and row.p_value == pytest.approx(0.006704, abs=1e-4)
    row = one([x * x for x in (-2, -1, 0, 1, 2, 3)] * 4, "dagostino")
    assert row.statistic == pytest.approx(3.92371918, abs=1e-7) and row.p_value == pytest.approx(0.140597, abs=1e-6)
    xs = np.array(SAMPLE_1)
    z = np.sort((xs - xs.mean()) / xs.std(ddof=1))
    phi = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    i = np.arange(1, 21)
    assert one(SAMPLE_1, "ks").statistic == pytest.approx(max((i / 20 - phi).max(), (phi - (i - 1) / 20).max()))
    with pytest.raises(ValueError, match="20 values"):
        one(WEIGHTS, "dagostino")


def test_shapiro_weighs_all_values(spark):
    """A few far values among many: no sample would be sure to hold them."""
    n = 6000
    v = F.when(F.col("id") < 3, 1e6).otherwise(F.sin("id"))
    row = normality_test(spark.range(n).select(v.alias("v")), "v", "shapiro").first()
    x = np.sort(np.where(np.arange(n) < 3, 1e6, np.sin(np.arange(n))))
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    # without the corrected ends, which do not matter for so many values
    about = (m @ x) ** 2 / (m @ m) / ((x - x.mean()) ** 2).sum()
    assert row.n == n and row.statistic == pytest.approx(about, rel=0.05) and not row.normal


def test_normal_quantile_column(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.0749, 0.0751, 0.3, 0.5, 0.8, 0.925, 0.9999, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p")).alias("q")).collect()
    assert [r.q for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-15)


def exact_u(a, b):
    u = sum(x > y for x in a for y in b)
    everything = [sum(p > q for p in s for q in set(a + b) - set(s)) for s in combinations(a + b, len(a))]
    upper = max(u, len(a) * len(b) - u)
    return u, min(1.0, 2 * sum(v >= upper for v in everything) / len(everything))


def test_mann_whitney_exact_and_approximate(spark):
    a, b = [1.1, 2.3, 4.7, 9.9], [0.4, 5.6, 6.1, 7.5, 8.8]
    row = mann_whitney_test(groups_frame(spark, a=a, b=b), "v", "g").first()
    assert (row.u, row.p_value) == pytest.approx(exact_u(a, b))
    r = np.random.RandomState(3)
    a, b = r.randint(0, 9, 60), r.randint(1, 10, 50)
    row = mann_whitney_test(groups_frame(spark, a=a, b=b), "v", "g").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    ties = pd.Series(np.concatenate([a, b])).value_counts()
    s = math.sqrt(3000 / 12 * (111 - (ties ** 3 - ties).sum() / (110 * 109)))
    p = math.erfc((abs(u - 1500) - 0.5) / s / math.sqrt(2))
    assert (row.u, row.p_value, row.rank_biserial) == pytest.approx((u, p, 1 - 2 * u / 3000))


def test_exact_rank_sums_against_all_counts():
    """The counts by polynomial multiplication, for every size up to 8 and every tail."""
    for n1 in range(1, 9):
        for n2 in (1, 2, 3, 5, 8, 13, 29, 60):
            counts = [1] + [0] * (n1 * n2)
            for i in range(1, n1 + 1):
                for j in range(len(counts) - 1, n2 + i - 1, -1):
                    counts[j] -= counts[j - n2 - i]
                for j in range(i, len(counts)):
                    counts[j] += counts[j - i]
            sums = np.cumsum(np.array(counts, object))
            places = {0, 1, 2, n1 * n2 // 3, n1 * n2 // 2, n1 * n2 - 1, n1 * n2} | set(range(0, n1 * n2, 17))
            for t in (t for t in places if t <= n1 * n2):
                assert rank_sum_tail(t, n1, n2) == rank_sum_tail(t, n2, n1) == sums[t]
    assert rank_sum_tail(-1, 3, 4) == 0
    with pytest.raises(ValueError, match="at most 8"):
        rank_sum_tail(3, 9, 9)


def test_exact_rank_sums_of_a_billion_rows():
    start = time.perf_counter()
    n = 10**9
    everything = math.comb(n + 8, 8)
    assert rank_sum_tail(8 * n, 8, n) == everything
    assert rank_sum_tail(4 * n - 1, 8, n) + rank_sum_tail(4 * n, 8, n) == everything  # symmetric
    assert time.perf_counter() - start < 1


def test_exact_p_between_larger_groups_has_a_bound(spark):
    r = np.random.RandomState(4).permutation(24) + 0.5
    a, b = r[:11].tolist(), r[11:].tolist()
    row = mann_whitney_test(groups_frame(spark, a=a, b=b), "v", "g", "exact").first()
    ranks = np.array(sorted(a + b)).searchsorted(a).sum() + 11
    ways = Counter({(0, 0): 1})  # sets of ranks by size and sum
    for i in range(1, 25):
        ways.update({(k + 1, t + i): w for (k, t), w in ways.items() if k < 11})
    least = min(row.u, 143 - row.u)
    tail = sum(w for (k, t), w in ways.items() if k == 11 and t - 66 <= least)
    assert row.u == ranks - 66 and row.p_value == pytest.approx(2 * tail / math.comb(24, 11))
    with pytest.raises(ValueError, match="multiply to at most"):
        _exact_u(5, 2000, 2000)


def test_nan_is_no_value_in_normality_and_lines(spark):
    df = spark.createDataFrame([(float(k % 7), float(v)) for k, v in enumerate(SAMPLE_1)] + [(1.0, math.nan), (math.nan, 3.0)],
                               "x double, v double")
    plain = df.where("not isnan(v) and not isnan(x)")
    for method in ("shapiro", "ks", "dagostino"):
        assert normality_test(df.where("not isnan(x)"), "v", method).collect() == normality_test(plain, "v", method).collect()
    assert sorted(line_series(df, "x", "v").collect()) == sorted(line_series(plain, "x", "v").collect())


def test_kruskal(spark):
    r = np.random.RandomState(4)
    groups = {k: r.randint(0, 12, 30) + i for i, k in enumerate("abc")}
    row = kruskal_wallis_test(groups_frame(spark, **groups), "v", "g").first()
    ranks = pd.Series(np.concatenate(list(groups.values()))).rank()
    ties = pd.Series(np.concatenate(list(groups.values()))).value_counts()
    h = 12 / (90 * 91) * sum(ranks[30 * i:30 * i + 30].sum() ** 2 / 30 for i in range(3)) - 3 * 91
    h /= 1 - (ties ** 3 - ties).sum() / (90 ** 3 - 90)
    assert row.h == pytest.approx(h) and row.p_value == pytest.approx(math.exp(-h / 2))


# --- selection and outliers -------------------------------------------------

def test_selection(numbers):
    rows = numbers.withColumn("const", F.lit(42))
    weak = {r.column: r.below for r in correlation_filter(rows, "target", 0.3).collect()}
    size = numbers.toPandas().corr().target.abs()
    assert weak == {"x1": False, "x2": size.x2 < 0.3, "x3": True, "const": None}
    assert {r.column for r in variance_filter(rows).where("low").collect()} == {"const"}
    assert drop_low_importance(rows, "target", "variance", 0.0).columns == ["x1", "x2", "x3", "target"]
    kept = drop_low_importance(rows, "target", "correlation", size.x2 - 0.001).columns
    assert {"x1", "x2", "target", "const"} <= set(kept)
    assert "x2" not in drop_low_importance(rows, "target", "correlation", size.x2 + 0.001).columns
    assert feature_importance(rows, "target", trees=20).first().feature == "x1"
    assert feature_importance(rows, "target", "mutual_info_regression", bins=5).first().feature == "x1"


def test_outliers(trips, trips_pd, spark):
    row = detect_outliers(trips, "Load", threshold=1.0).first()
    load = trips_pd.Load.astype(float).dropna()
    q1, q3 = load.quantile([0.25, 0.75])
    far = load[(load < 2 * q1 - q3) | (load > 2 * q3 - q1)]
    assert row.n_outliers == len(far) > 0 and row.outlier_max == 655.75 and row.pct == pytest.approx(len(far) / 14 * 100)
    flat = detect_outliers(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v", "zscore").first()
    assert flat.n_outliers == 0


# --- chart tables -----------------------------------------------------------

def test_histogram_and_bins(hot, trips):
    pdf = hot.toPandas()
    got = histogram(hot, "w", 7).orderBy("bin").collect()
    assert [r["count"] for r in got] == list(np.histogram(pdf.w.dropna(), 7)[0])
    assert sum(r["count"] for r in scatter_bins(hot, "v", "w", "g").collect()) == pdf.w.notna().sum()
    assert histogram(trips.where("i < 0"), "Load").isEmpty()


@pytest.mark.parametrize("by", ["", "g"])
def test_density_against_all_points(spark, by):
    r = np.random.RandomState(5)
    x, g = np.concatenate([r.normal(0, 1, 300), [2.5] * 150, r.lognormal(1, 0.5, 200)]), np.arange(650) % 3
    df = spark.createDataFrame(list(zip(g.tolist(), x.tolist())), "g int, x double")
    for row in density_curve(df, "x", by).where("point % 20 = 0").collect():
        mine = x if not by else x[g == row.g]
        h = mine.std(ddof=1) * len(mine) ** -0.2
        want = np.exp(-0.5 * ((row.x - mine) / h) ** 2).sum() / (len(mine) * h * math.sqrt(2 * math.pi))
        assert row.density == pytest.approx(want, abs=1e-6)


def test_boxes_lines_bars(trips, trips_pd, hot):
    load = trips_pd.Load.astype(float)
    box = box_stats(trips, "Load").first()
    q1, q2, q3 = load.quantile([0.25, 0.5, 0.75])
    inside = load[load <= q3 + 1.5 * (q3 - q1)]
    assert (box.q1, box.median, box.q3) == pytest.approx((q1, q2, q3))
    assert (box.whisker_high, box.n_outliers) == (inside.max(), 14 - len(inside))
    assert {r.Depot: r.n for r in box_stats(trips, "Load", "Depot").collect()} == {"north": 5, "mill": 2, "quay": 4, "hill": 2}
    line = {r.Depot: r.mean for r in line_series(trips, "Depot", "Load").collect()}
    assert line["north"] == 87.0 and len(line) == 4
    assert line_series(trips, "Depot", ["Load", "Hours"]).count() == 8
    shares = {r.Depot: (r.bus, r.ferry, r.tram) for r in stacked_bar(trips, "Depot", "Line", top_n=2).collect()}
    assert shares == {"north": (40.0, 0.0, 60.0), "quay": (25.0, 50.0, 25.0)}
    assert heatmap(hot, "v", "g", "w", "sum").count() == hot.dropna(subset=["g"]).select("v").distinct().count()
    assert heatmap(hot, "v", "g", "w", "sum", top_n=20).count() == 20
    wide = hot.select(*[(F.col("w") + k).alias(f"c{k}") for k in range(8)])
    assert pair_bins(wide, wide.columns).select("x").distinct().count() == 8
    assert distribution_comparison(trips, "Load", "Depot", 2).select("Depot").distinct().count() == 2


def test_cumulative_and_qq(hot, spark):
    pdf = hot.toPandas().v.sort_values()
    got = cumulative(hot, "v").toPandas().sort_values("value")
    want = pdf.rank(method="max").drop_duplicates() / len(pdf) * 100
    assert np.allclose(got.cumulative_pct, want)
    xs = spark.createDataFrame([(float(x),) for x in np.random.RandomState(6).normal(5, 2, 150)], "v double")
    points = qq_points(xs, "v")
    line = qq_line(xs, "v").first()
    assert points.count() == 150 and line.slope == pytest.approx(2, abs=0.3) and line.r > 0.98
    # more values than a drawn curve has points: the line still meets all of them
    x = np.sort(np.random.RandomState(7).lognormal(size=3000))
    i = np.arange(1, 3001)
    p = np.where(i == 3000, 0.5 ** (1 / 3000), np.where(i == 1, 1 - 0.5 ** (1 / 3000), (i - 0.3175) / 3000.365))
    slope, intercept = np.polyfit([NormalDist().inv_cdf(v) for v in p], x, 1)
    line = qq_line(spark.createDataFrame([(float(v),) for v in x], "v double"), "v").first()
    assert (line.slope, line.intercept) == pytest.approx((slope, intercept))


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,), (4.0,)], "`a.b` double")
    assert [r["count"] for r in histogram(df, "a.b", 3).orderBy("bin").collect()] == [1, 1, 1]


@pytest.mark.parametrize("limits", [{"SMALL_ROWS": 10**9}, {"SMALL_ROWS": 0, "TINY_DISTINCT": 0},
                                    {"SMALL_ROWS": 0, "TINY_DISTINCT": 0, "SCANNED_TARGETS": 0}])
def test_grouped_quantiles_do_not_depend_on_the_path(spark, monkeypatch, limits):
    from tabweave.core import quantile
    for k, v in limits.items():
        monkeypatch.setattr(quantile, k, v)
    nan, inf = float("nan"), float("inf")
    groups = {"a": [1.0, 2.0, nan], "b": [1.0, inf, inf], "c": [3.0, 3.0, 3.0, 7.0], None: [5.0, None, 6.0], "d": [nan, None],
              "e": [-inf, 0.0, 1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    small = 0 if "SCANNED_TARGETS" in limits else quantile.SMALL_DISTINCT
    got = {r.g: r.q_v for r in quantile.grouped_stats(df, ["g"], [F.count(F.lit(1)).alias("n")], {"v": [0.5, 0.25]}, small).collect()}
    want = {"a": [1.5, 1.25], "b": [inf, inf], "c": [3.0, 3.0], None: [5.5, 5.25], "d": None, "e": [0.5, -inf]}
    assert {g: None if q is None or q[0] is None else list(q) for g, q in got.items()} == want


# --- metrics ----------------------------------------------------------------

def test_regression_and_classification_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    row = regression_metrics(df, "y", "p").first()
    assert (row.mae, row.mse, row.r2) == pytest.approx((2 / 3, 2 / 3, 1 - 2 / (14 / 3)))
    calls = spark.createDataFrame([(1, 1.0), (1, 0.0), (0, 1.0), (0, 0.0), (1, 1.0)], "y int, p double")
    row = classification_metrics(calls, "y", "p").first()
    assert tuple(row) == pytest.approx((0.6, 2 / 3, 2 / 3, 2 / 3))
    never = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    assert tuple(classification_metrics(never, "y", "p").first()) == (0.5, 0.0, 0.0, 0.0)
    table = confusion_matrix(spark.createDataFrame([("a", "b"), ("a", "a")], "y string, p string"), "y", "p")
    assert {r.label: (r.predicted_a, r.predicted_b) for r in table.collect()} == {"a": (1, 1), "b": (0, 0)}


def test_curves(spark):
    r = np.random.RandomState(8)
    y, s = r.randint(0, 2, 200), r.randint(0, 30, 200) / 30
    s[:70] = 0.5
    df = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert roc_auc(df, "y", "s").first()[0] == pytest.approx(auc)
    curve = roc_curve(df, "y", "s").toPandas().sort_values("threshold", ascending=False)
    assert (curve.fpr.iloc[0], curve.tpr.iloc[0], curve.fpr.iloc[-1], curve.tpr.iloc[-1]) == (0, 0, 1, 1)
    assert np.trapezoid(curve.tpr, curve.fpr) == pytest.approx(auc)
    pr = precision_recall_curve(df, "y", "s").toPandas().sort_values("threshold", ascending=False)
    want = (pr.recall.diff().fillna(0) * pr.precision).sum()
    assert average_precision(df, "y", "s").first()[0] == pytest.approx(want)
