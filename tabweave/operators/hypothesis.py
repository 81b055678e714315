"""Statistical tests: a distributed aggregation, then a closed form.

Groups are ordered by value, which fixes the sign of t and which U is given.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.core import special
from tabweave.core.checks import c, present, require_choice, require_columns, require_numeric
from tabweave.core.numeric import div, normal_cdf, normal_quantile, sample_kurtosis, sample_skewness
from tabweave.core.quantile import grouped_stats
from tabweave.core.scan import BROADCAST_ROWS, attach, row_numbers, running_totals
from tabweave.session import cut_lineage

ALPHA = 0.05


def _grouped(df: DataFrame, column: str, group_column: str) -> DataFrame:
    require_numeric(df, [column])
    require_columns(df, [group_column])
    return df.select(c(group_column).alias("g"), c(column).cast("double").alias("v")).dropna()


def _one_row(df: DataFrame, row: dict, types: str) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(row.values())], types)


def _two(rows: list, name: str) -> None:
    if len(rows) != 2:
        found = "more than 2" if len(rows) > 2 else str(len(rows))
        raise ValueError(f"{name} needs exactly 2 groups, found {found}")


def ttest_independent(df: DataFrame, column: str, group_column: str) -> DataFrame:
    """Welch's t-test of two groups, with Cohen's d."""
    moments = _grouped(df, column, group_column).groupBy("g").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    rows = sorted(moments.limit(3).collect(), key=lambda r: r.g)
    _two(rows, "the t-test")
    a, b = rows
    if a.n < 2 or b.n < 2:
        raise ValueError("each group needs two values")
    ea, eb = a["var"] / a.n, b["var"] / b.n
    gap = a["mean"] - b["mean"]
    spread = math.sqrt((a["var"] + b["var"]) / 2)
    t = dof = p = None
    if ea + eb > 0:
        t = gap / math.sqrt(ea + eb)
        dof = (ea + eb) ** 2 / (ea ** 2 / (a.n - 1) + eb ** 2 / (b.n - 1))
        p = special.student_two_sided(t, dof)
    row = {"group_a": str(a.g), "n_a": a.n, "mean_a": a["mean"], "std_a": math.sqrt(a["var"]),
           "group_b": str(b.g), "n_b": b.n, "mean_b": b["mean"], "std_b": math.sqrt(b["var"]),
           "t": t, "dof": dof, "p_value": p, "significant": None if p is None else p < ALPHA,
           "cohens_d": abs(gap) / spread if spread else None}
    return _one_row(df, row, "group_a string, n_a long, mean_a double, std_a double, group_b string, n_b long, "
                    "mean_b double, std_b double, t double, dof double, p_value double, significant boolean, "
                    "cohens_d double")


def anova_test(df: DataFrame, column: str, group_column: str) -> DataFrame:
    """One-way ANOVA with eta squared; any number of groups."""
    moments = _grouped(df, column, group_column).groupBy("g").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("var"))
    # variance between groups as a weighted second moment around the grand mean
    k, n, grand, within = moments.agg(
        F.count(F.lit(1)), F.sum("n"), div(F.sum(F.col("n") * F.col("mean")), F.sum("n")),
        F.sum((F.col("n") - 1) * F.col("var"))).first()
    if k < 2:
        raise ValueError(f"ANOVA needs at least 2 groups, found {k}")
    between = moments.agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.lit(grand), 2))).first()[0]
    f = p = None
    if n > k and within > 0:
        f = (between / (k - 1)) / (within / (n - k))
        p = special.f_upper(f, k - 1, n - k)
    row = {"n_groups": k, "n": n, "f": f, "dof_between": k - 1, "dof_within": n - k, "p_value": p,
           "significant": None if p is None else p < ALPHA,
           "eta_squared": between / (between + within) if between + within > 0 else 0.0}
    return _one_row(df, row, "n_groups long, n long, f double, dof_between long, dof_within long, p_value double, "
                    "significant boolean, eta_squared double")


def chi_square_test(df: DataFrame, col_a: str, col_b: str) -> DataFrame:
    """Independence of two categorical columns, with Cramer's V.  A 2 x 2
    table gets the continuity correction."""
    require_columns(df, [col_a, col_b])
    cells = df.select(c(col_a).alias("a"), c(col_b).alias("b")).dropna().groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"))
    rows_a = cells.groupBy("a").agg(F.sum("n").alias("na"))
    rows_b = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    ka, total = rows_a.agg(F.count(F.lit(1)), F.sum("na")).first()
    kb = rows_b.agg(F.count(F.lit(1))).first()[0]
    if not ka or not kb:
        raise ValueError("no complete pairs")
    dof = (ka - 1) * (kb - 1)
    if ka == 2 and kb == 2:
        count = {(r.a, r.b): r.n for r in cells.collect()}
        sa = {r.a: r.na for r in rows_a.collect()}
        sb = {r.b: r.nb for r in rows_b.collect()}
        chi2 = 0.0
        for x, nx in sa.items():
            for y, ny in sb.items():
                expected = nx * ny / total
                gap = abs(count.get((x, y), 0) - expected)
                chi2 += (gap - min(0.5, gap)) ** 2 / expected
    else:
        expected = F.col("na") * (F.col("nb") / F.lit(float(total)))
        joined = attach(attach(cells, rows_a, ["a"]), rows_b, ["b"])
        seen, part, covered = joined.agg(F.count(F.lit(1)), F.sum(F.pow(F.col("n") - expected, 2) / expected),
                                         F.sum(expected)).first()
        # an empty cell adds its expected count
        chi2 = part + (0.0 if seen == ka * kb else max(0.0, total - covered))
    p = special.chi2_upper(chi2, dof) if dof else 1.0
    v = math.sqrt(chi2 / (total * (min(ka, kb) - 1))) if min(ka, kb) > 1 else 0.0
    row = {"n_rows_a": ka, "n_rows_b": kb, "n": total, "chi2": chi2, "dof": dof, "p_value": p,
           "significant": p < ALPHA, "cramers_v": v}
    return _one_row(df, row, "n_rows_a long, n_rows_b long, n long, chi2 double, dof long, p_value double, "
                    "significant boolean, cramers_v double")


NORMALITY = ("shapiro", "ks", "dagostino")


def normality_test(df: DataFrame, column: str, method: str = "shapiro") -> DataFrame:
    """Shapiro-Wilk, Kolmogorov-Smirnov against the fitted normal, or
    D'Agostino-Pearson, each over all values that are neither null nor NaN."""
    require_numeric(df, [column])
    require_choice(method, NORMALITY, "method")
    rows = df.where(present(df, column))
    x = c(column).cast("double")
    n, mean, std, g1, g2, skew, kurt = rows.agg(
        F.count(x), F.avg(x), F.stddev_samp(x), F.skewness(x), F.kurtosis(x), sample_skewness(x),
        sample_kurtosis(x)).first()
    statistic = p = None
    if method == "shapiro":
        if n < 3:
            raise ValueError("Shapiro-Wilk needs at least 3 values")
        statistic, p = _shapiro(rows.select(x.alias("v")), n, mean)
    elif method == "ks":
        if std:
            counts = rows.groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("m"))
            placed = running_totals(counts, ["v"], {"before": "m"})
            phi = normal_cdf((F.col("v") - F.lit(mean)) / F.lit(std))
            size = F.lit(float(n))
            statistic = placed.agg(F.max(F.greatest(
                (F.col("before") + F.col("m")) / size - phi, phi - F.col("before") / size))).first()[0]
            p = special.kolmogorov_upper(statistic, n)
    else:
        if n < 20:
            raise ValueError("D'Agostino-Pearson needs at least 20 values")
        if g1 is not None:
            statistic = _skewness_score(g1, n) ** 2 + _kurtosis_score(g2, n) ** 2
            p = math.exp(-statistic / 2)
    row = {"method": method, "n": n, "skewness": skew, "kurtosis": kurt, "statistic": statistic, "p_value": p,
           "normal": None if p is None else p >= ALPHA}
    return _one_row(df, row, "method string, n long, skewness double, kurtosis double, statistic double, "
                    "p_value double, normal boolean")


def _polynomial(x: float, coefficients: tuple[float, ...]) -> float:
    return sum(k * x ** i for i, k in enumerate(coefficients))


# Royston (1995), lowest power first.
_LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_GAMMA = (-2.273, 0.459)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
_SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def _shapiro(values: DataFrame, n: int, mean: float) -> tuple[float | None, float | None]:
    """W over all values and its p.  The weight of a value is the normal
    quantile of its rank, scaled; only the two outer ones on each side differ.
    The approximation of p was made for up to 5000 values."""
    ranked = row_numbers(values.select((F.col("v") - F.lit(mean)).alias("v")), [F.col("v").asc()], "i", start=1)
    m = normal_quantile((F.col("i") - F.lit(0.375)) / F.lit(n + 0.25))
    k = 0 if n == 3 else 1 if n <= 5 else 2
    inner = (F.col("i") > k) & (F.col("i") <= n - k)
    pick = lambda i: F.max(F.when(F.col("i") == i, F.col("v")))
    spread, square, inside, *outer = ranked.agg(
        F.sum(F.col("v") * F.col("v")), F.sum(m * m), F.sum(F.when(inner, m * F.col("v"))),
        *[pick(i) for i in (1, 2, n - 1, n)]).first()
    if not spread:
        return None, None
    quantile = lambda i: special.normal_quantile((i - 0.375) / (n + 0.25))
    if n == 3:
        top = math.sqrt(0.5) * (outer[3] - outer[0])
    else:
        u = 1 / math.sqrt(n)
        ends = [_polynomial(u, _LAST_WEIGHT) + quantile(n) / math.sqrt(square)]
        if k == 2:
            ends.append(_polynomial(u, _NEXT_WEIGHT) + quantile(n - 1) / math.sqrt(square))
        scale = math.sqrt((square - 2 * sum(quantile(n - j) ** 2 for j in range(k))) / (1 - 2 * sum(e * e for e in ends)))
        top = (inside or 0.0) / scale + ends[0] * (outer[3] - outer[0])
        if k == 2:
            top += ends[1] * (outer[2] - outer[1])
    w = min(1.0, top * top / spread)
    if w >= 1.0:
        return w, 1.0
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        gamma = _polynomial(n, _SMALL_GAMMA)
        gap = gamma - math.log(1 - w)
        if gap <= 0:
            return w, 0.0
        score = (-math.log(gap) - _polynomial(n, _SMALL_MEAN)) / math.exp(_polynomial(n, _SMALL_LOG_SD))
    else:
        y = math.log(n)
        score = (math.log(1 - w) - _polynomial(y, _LARGE_MEAN)) / math.exp(_polynomial(y, _LARGE_LOG_SD))
    return w, special.normal_upper(score)


def _skewness_score(g1: float, n: int) -> float:
    """D'Agostino's (1970) normal score of a sample skewness."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    return math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))


def _kurtosis_score(g2: float, n: int) -> float:
    """Anscombe and Glynn's (1983) normal score of a sample excess kurtosis."""
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3.0) * (n + 5))
    x = (g2 + 3 - 3.0 * (n - 1) / (n + 1)) / math.sqrt(variance)
    third = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6 + 8 / third * (2 / third + math.sqrt(1 + 4 / third ** 2))
    base = 1 + x * math.sqrt(2 / (a - 4))
    root = math.copysign(((1 - 2 / a) / abs(base)) ** (1 / 3), base)
    return (1 - 2 / (9 * a) - root) / math.sqrt(2 / (9 * a))


def _rank_sums(df: DataFrame, column: str, group_column: str) -> tuple[DataFrame, int, float]:
    """Per group the number of values and the sum of average ranks around the
    mean rank; the total count; and the sum of t^3 - t over tied values."""
    cells = cut_lineage(_grouped(df, column, group_column).groupBy("v", "g").agg(F.count(F.lit(1)).alias("n")))
    values = cells.groupBy("v").agg(F.sum("n").alias("m"))
    m = F.col("m").cast("double")
    total, distinct, ties = values.agg(F.coalesce(F.sum("m"), F.lit(0)), F.count(F.lit(1)),
                                       F.coalesce(F.sum(m * m * m - m), F.lit(0.0))).first()
    placed = running_totals(values, ["v"], {"before": "m"}, rows_bound=distinct)
    around = F.col("before") + (F.col("m") + 1) / F.lit(2.0) - F.lit((total + 1) / 2.0)
    ranks = placed.select("v", around.alias("r"))
    ranked = attach(cells, F.broadcast(ranks) if distinct <= BROADCAST_ROWS else ranks, ["v"])
    sums = ranked.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("r")).alias("r"))
    return sums, total, ties


def _median_by_group(df: DataFrame, column: str, group_column: str) -> DataFrame:
    return grouped_stats(_grouped(df, column, group_column), ["g"], [], {"v": [0.5]}).select(
        "g", F.col("q_v")[0].alias("median"))


# beyond groups of SMALL_GROUP, exact counts fill a list of n1 * n2 + 1 whole numbers on the driver
MOST_EXACT_CELLS = 1_000_000


def _exact_u(u: int, n1: int, n2: int) -> float:
    """Two-sided exact p of Mann and Whitney's U without ties."""
    least = min(u, n1 * n2 - u)
    if min(n1, n2) <= special.SMALL_GROUP:
        tail = special.rank_sum_tail(least, n1, n2)
    elif n1 * n2 > MOST_EXACT_CELLS:
        raise ValueError(f"the exact p takes groups whose sizes multiply to at most {MOST_EXACT_CELLS}, or one of at "
                         f"most {special.SMALL_GROUP} values; use method='asymptotic'")
    else:
        counts = [1] + [0] * (n1 * n2)
        for i in range(1, n1 + 1):  # multiply by (1 - q^(n2+i)) and divide by (1 - q^i)
            for j in range(len(counts) - 1, n2 + i - 1, -1):
                counts[j] -= counts[j - n2 - i]
            for j in range(i, len(counts)):
                counts[j] += counts[j - i]
        tail = sum(counts[:least + 1])
    return min(1.0, 2 * tail / math.comb(n1 + n2, n1))


RANK_METHODS = ("auto", "exact", "asymptotic")


def mann_whitney_test(df: DataFrame, column: str, group_column: str, method: str = "auto") -> DataFrame:
    """U of the first group, two-sided p, rank-biserial correlation.

    'auto' takes the exact p where no values are tied and one group has at
    most 8, at a cost that does not depend on the other's size.  'exact' asks
    for it between larger groups, too, within ``MOST_EXACT_CELLS``.
    """
    require_choice(method, RANK_METHODS, "method")
    rows = _grouped(df, column, group_column)
    found = rows.select("g").distinct().limit(3).collect()
    _two(found, "the Mann-Whitney test")
    first, second = sorted(r.g for r in found)
    # per distinct value the size of either group, so no join is needed
    counts = rows.groupBy("v").agg(F.count_if(F.col("g") == F.lit(first)).alias("n1"),
                                   F.count(F.lit(1)).alias("m"))
    placed = running_totals(counts, ["v"], {"before": "m"})
    m = F.col("m").cast("double")
    # whole numbers: sums of doubles lose ranks beyond 2^53
    twice_rank = (2 * F.col("before") + F.col("m") + 1).cast("decimal(19,0)")
    n1, total, twice_sum, ties = placed.agg(F.sum("n1"), F.sum("m"), F.sum(F.col("n1").cast("decimal(19,0)") * twice_rank),
                                            F.sum(m * m * m - m)).first()
    n2 = total - n1
    medians = {r.g: r["median"] for r in _median_by_group(df, column, group_column).collect()}
    twice_u = int(twice_sum) - n1 * (n1 + 1)
    u = twice_u / 2
    if method == "exact" and ties:
        raise ValueError("the exact p needs values without ties")
    if method == "exact" or (method == "auto" and ties == 0 and min(n1, n2) <= special.SMALL_GROUP):
        p = _exact_u(twice_u // 2, n1, n2)
    else:
        variance = n1 * n2 / 12 * ((total + 1) - ties / (total * (total - 1.0)))
        p = None
        if variance > 0:
            z = (abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(variance)
            p = min(1.0, 2 * special.normal_upper(z))
    row = {"group_a": str(first), "n_a": n1, "median_a": medians[first], "group_b": str(second), "n_b": n2,
           "median_b": medians[second], "u": u, "p_value": p, "significant": None if p is None else p < ALPHA,
           "rank_biserial": 1 - 2 * u / (n1 * n2)}
    return _one_row(df, row, "group_a string, n_a long, median_a double, group_b string, n_b long, median_b double, "
                    "u double, p_value double, significant boolean, rank_biserial double")


def kruskal_wallis_test(df: DataFrame, column: str, group_column: str) -> DataFrame:
    """Tie-corrected H with epsilon squared; any number of groups."""
    sums, total, ties = _rank_sums(df, column, group_column)
    k, squares = sums.agg(F.count(F.lit(1)), F.sum(F.col("r") * F.col("r") / F.col("n"))).first()
    if k < 2:
        raise ValueError(f"Kruskal-Wallis needs at least 2 groups, found {k}")
    correction = 1 - ties / (float(total) ** 3 - total)
    h = p = None
    if correction > 0:
        h = 12.0 / (total * (total + 1.0)) * squares / correction
        p = special.chi2_upper(h, k - 1)
    eps = 0.0 if total <= k else (None if h is None else (h - k + 1) / (total - k))
    row = {"n_groups": k, "n": total, "h": h, "dof": k - 1, "p_value": p,
           "significant": None if p is None else p < ALPHA, "epsilon_squared": eps}
    return _one_row(df, row, "n_groups long, n long, h double, dof long, p_value double, significant boolean, "
                    "epsilon_squared double")


def group_medians(df: DataFrame, column: str, group_column: str) -> DataFrame:
    """Size and median of each group, the table beside the rank tests."""
    rows = _grouped(df, column, group_column)
    return grouped_stats(rows, ["g"], [F.count("v").alias("n")], {"v": [0.5]}).select(
        F.col("g").alias(group_column), "n", F.col("q_v")[0].alias("median"))
