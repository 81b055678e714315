"""The small tables behind charts: aggregate first, draw elsewhere."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.core import special
from tabweave.core.checks import as_list, c, present, require_columns, require_numeric, without_nan
from tabweave.core.numeric import div, normal_quantile
from tabweave.core.quantile import SMALL_DISTINCT, grouped_stats, quantile_values
from tabweave.core.scan import attach, attach_measured, row_numbers, running_totals
from tabweave.operators.relational import MAX_DISTINCT, distinct_values, pivot_table

# points of a drawn curve
CURVE_POINTS = 200


def _range(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float] | None]:
    """Smallest and largest value of several columns in one scan."""
    row = df.agg(*[e for i, n in enumerate(names) for e in (
        F.min(without_nan(c(n))).alias(f"a{i}"), F.max(without_nan(c(n))).alias(f"b{i}"))]).first()
    return {n: None if row[f"a{i}"] is None else (row[f"a{i}"], row[f"b{i}"]) for i, n in enumerate(names)}


def _bucket(x: Column, limits: tuple[float, float] | None, bins: int) -> Column:
    """Equal-width bin number, the last bin closed."""
    if limits is None:
        return F.lit(None).cast("int")
    low, high = limits
    width = (high - low) / bins
    if width == 0:
        return F.when(x.isNotNull(), F.lit(0))
    return F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, left, right, count) for equal-width bins, empty ones included."""
    require_numeric(df, [column])
    limits = _range(df, [column])[column]
    counts = df.where(present(df, column)).groupBy(
        _bucket(c(column).cast("double"), limits, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if limits is None:
        return counts.select("bin", F.lit(None).cast("double").alias("left"),
                             F.lit(None).cast("double").alias("right"), F.col("n").alias("count"))
    low, high = limits
    width = F.lit((high - low) / bins)
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("left"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("right"), F.coalesce("n", F.lit(0)).alias("count"))


def bar_counts(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """The most frequent non-null values, ties by value."""
    require_columns(df, [column])
    counts = df.where(c(column).isNotNull()).groupBy(c(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("value")).limit(top_n)


def scatter_bins(df: DataFrame, x: str, y: str, hue: str = "", bins: int = 50) -> DataFrame:
    """Counts on a bins x bins grid, per hue value if given."""
    require_numeric(df, [x, y])
    if hue:
        require_columns(df, [hue])
    limits = _range(df, [x, y])
    rows = df.where(present(df, x) & present(df, y))
    keys = [_bucket(c(x).cast("double"), limits[x], bins).alias("x_bin"),
            _bucket(c(y).cast("double"), limits[y], bins).alias("y_bin")]
    return rows.groupBy(*keys, *([c(hue)] if hue else [])).agg(F.count(F.lit(1)).alias("count"))


def box_stats(df: DataFrame, column: str, by: str = "", small: int = SMALL_DISTINCT) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 quartile ranges) and
    number of outliers, per group if asked."""
    require_numeric(df, [column])
    keys = [by] if by else []
    require_columns(df, keys)
    rows = df.select(*map(c, keys), c(column).cast("double").alias("_v")).dropna()
    quartiles = grouped_stats(rows, keys, [F.count("_v").alias("n")], {"_v": [0.25, 0.5, 0.75]}, small)
    box = quartiles.select(*map(c, keys), "n", F.col("q__v")[0].alias("q1"), F.col("q__v")[1].alias("median"),
                           F.col("q__v")[2].alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    if by:
        joined = attach_measured(rows, box, keys)
    else:
        one = box.first()
        joined = rows.withColumns({k: F.lit(one[k]).cast(box.schema[k].dataType) for k in ("n", "q1", "median", "q3")})
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    facts = [F.first(k).alias(k) for k in ("n", "q1", "median", "q3")]
    return joined.groupBy(*map(c, keys)).agg(
        *facts, F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))


def pair_bins(df: DataFrame, columns: Sequence[str], hue: str = "", bins: int = 20) -> DataFrame:
    """Complete rows: one-dimensional counts of each column (x = y, y_bin null)
    and two-dimensional counts of each pair below the diagonal."""
    names = as_list(columns)
    require_numeric(df, names)
    if hue:
        require_columns(df, [hue])
    rows = df.select(*map(c, dict.fromkeys([*names, *([hue] if hue else [])]))).dropna()
    limits = _range(rows, names)
    place = {n: _bucket(c(n).cast("double"), limits[n], bins) for n in names}
    cells = [F.struct(F.lit(n).alias("x"), F.lit(n).alias("y"), place[n].alias("x_bin"),
                      F.lit(None).cast("int").alias("y_bin")) for n in names]
    cells += [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), place[a].alias("x_bin"), place[b].alias("y_bin"))
              for a, b in combinations(names, 2)]
    extra = [c(hue).alias("hue")] if hue else []
    keys = ["x", "y", "x_bin", "y_bin", *(["hue"] if hue else [])]
    return rows.select(*extra, F.inline(F.array(*cells))).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def line_series(df: DataFrame, x: str, y: str | Sequence[str], hue: str = "") -> DataFrame:
    """Mean of y per x (and hue) with a 95 % normal band; several y columns
    come as rows, then without hue."""
    ys = as_list(y)
    require_columns(df, [x])
    require_numeric(df, ys)
    use_hue = bool(hue) and len(ys) == 1
    if use_hue:
        require_columns(df, [hue])
    keys = [x, *([hue] if use_hue else [])]
    # NaN is no value, neither as a place nor in a mean
    rows = df.where(present(df, x))
    wide = rows.groupBy(*map(c, keys)).agg(*[e for i, n in enumerate(ys) for e in (
        F.count(without_nan(c(n))).alias(f"n{i}"), F.avg(without_nan(c(n))).alias(f"m{i}"),
        F.stddev_samp(without_nan(c(n))).alias(f"s{i}"))])
    half = [F.lit(1.96) * F.col(f"s{i}") / F.sqrt(F.col(f"n{i}")) for i in range(len(ys))]
    lines = F.array(*[F.struct(F.lit(n).alias("y"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
                               (F.col(f"m{i}") - half[i]).alias("low"), (F.col(f"m{i}") + half[i]).alias("high"))
                      for i, n in enumerate(ys)])
    return wide.select(*map(c, keys), F.inline(lines)).where("n > 0")


def density_curve(df: DataFrame, column: str, by: str = "", points: int = CURVE_POINTS, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid.

    Values are first summed up in cells of a hundredth of the bandwidth; the
    kernel then runs over cells, not rows, each with its own mean and variance,
    which leaves an error below 1e-6 of the density.
    Groups with fewer than two values or no spread are left out.
    """
    require_numeric(df, [column])
    keys = [by] if by else ["_all"]
    rows = df.select(c(by) if by else F.lit(0).alias("_all"), c(column).cast("double").alias("_v")).dropna()
    facts = rows.groupBy(*map(c, keys)).agg(
        F.count("_v").alias("_n"), F.stddev_samp("_v").alias("_s"), F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi")).where("_n > 1 and _s > 0")
    facts = facts.select(*map(c, keys), "_n", "_lo", "_hi", (F.col("_s") * F.pow("_n", F.lit(-0.2))).alias("_h"))
    joined = attach_measured(rows, facts, keys, "inner")
    cells = joined.groupBy(*map(c, keys), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_h") / 100)).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_w"), F.avg("_v").alias("_x"), F.var_pop("_v").alias("_q"),
        *[F.first(n).alias(n) for n in ("_n", "_lo", "_hi", "_h")])
    low = F.col("_lo") - F.lit(cut) * F.col("_h")
    step = (F.col("_hi") - F.col("_lo") + F.lit(2 * cut) * F.col("_h")) / F.lit(points - 1)
    spread = cells.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = low + F.col("point") * step
    width = F.sqrt(F.col("_h") * F.col("_h") + F.col("_q"))
    z = (at - F.col("_x")) / width
    # the constant is 1 / sqrt(2 pi)
    kernel = F.col("_w") * F.exp(-z * z / 2) * F.lit(0.3989422804014327) / (F.col("_n") * width)
    out = spread.groupBy(*map(c, keys), "point").agg(F.first(at).alias("x"), F.sum(kernel).alias("density"))
    return out if by else out.drop("_all")


def violin_stats(df: DataFrame, column: str, by: str = "") -> tuple[DataFrame, DataFrame]:
    """The box and the density curve of each group."""
    return box_stats(df, column, by), density_curve(df, column, by)


def distribution_comparison(df: DataFrame, column: str, by: str, top_n_groups: int = 5) -> DataFrame:
    """Density curves of the most frequent groups."""
    require_columns(df, [by])
    top = bar_counts(df, by, top_n_groups).select(F.col("value").alias("_g"))
    kept = df.select(c(by), c(column)).join(top, c(by) == F.col("_g"), "left_semi")
    return density_curve(kept, column, by)


def qq_points(df: DataFrame, column: str, points: int = CURVE_POINTS) -> DataFrame:
    """(position, theoretical, sample): ordered values against normal
    quantiles, drawn at ``points`` evenly spaced positions of a longer column."""
    require_numeric(df, [column])
    n = df.agg(F.count(without_nan(c(column)))).first()[0]
    if n < 2:
        raise ValueError("at least two values are needed")
    m = min(n, points)
    ranks = sorted({round(k * (n - 1) / (m - 1)) + 1 for k in range(m)})
    values = quantile_values(df, {column: [(i - 1) / (n - 1) for i in ranks]})[column]

    def place(i: int) -> float:  # Filliben's estimate of the median position
        if i == n:
            return 0.5 ** (1.0 / n)
        return 1 - 0.5 ** (1.0 / n) if i == 1 else (i - 0.3175) / (n + 0.365)

    rows = [(i, special.normal_quantile(place(i)), v) for i, v in zip(ranks, values)]
    return df.sparkSession.createDataFrame(rows, "position long, theoretical double, sample double")


def qq_line(df: DataFrame, column: str) -> DataFrame:
    """Least-squares line through all ordered values against normal quantiles."""
    require_numeric(df, [column])
    rows = df.select(without_nan(c(column)).alias("sample")).where("sample is not null")
    n = rows.count()
    if n < 2:
        raise ValueError("at least two values are needed")
    ranked = row_numbers(rows, [F.col("sample").asc()], "i", start=1)
    end = 0.5 ** (1.0 / n)
    place = F.when(F.col("i") == n, F.lit(end)).when(F.col("i") == 1, F.lit(1 - end)).otherwise(
        (F.col("i") - F.lit(0.3175)) / F.lit(n + 0.365))
    points = ranked.select("sample", normal_quantile(place).alias("theoretical"))
    return points.agg(F.regr_slope("sample", "theoretical").alias("slope"),
                      F.regr_intercept("sample", "theoretical").alias("intercept"),
                      F.sqrt(F.regr_r2("sample", "theoretical")).alias("r"))


def stacked_bar(df: DataFrame, column: str, by: str, normalize: bool = True, top_n: int = 10,
                by_values: Sequence | None = None, max_columns: int = MAX_DISTINCT) -> DataFrame:
    """Counts or row shares (%) of ``by`` in the largest values of ``column``."""
    require_columns(df, [column, by])
    counts = df.select(c(column).alias("_a"), c(by).alias("_b")).dropna().groupBy("_a", "_b").agg(
        F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("_a").agg(F.sum("_n").alias("_total"))
    top = totals.orderBy(F.desc("_total"), F.asc("_a")).limit(top_n)
    names = list(by_values) if by_values is not None else distinct_values(df.where(present(df, column)), by, max_columns)
    wide = attach(counts, top, ["_a"], "inner").groupBy("_a", "_total").pivot("_b", names).agg(F.first("_n"))
    cell = lambda v: F.coalesce(c(str(v)), F.lit(0))
    shares = [(cell(v) * 100.0 / F.col("_total") if normalize else cell(v)).alias(str(v)) for v in names]
    return wide.orderBy(F.desc("_total"), F.asc("_a")).select(F.col("_a").alias(column), *shares)


def heatmap(df: DataFrame, index_col: str, columns_col: str, values_col: str, agg_func: str = "mean",
            column_values: Sequence | None = None, top_n: int | None = None,
            max_columns: int = MAX_DISTINCT) -> DataFrame:
    """Pivot of one value, the rows with the largest total first; ``top_n`` keeps so many."""
    wide = pivot_table(df, [index_col], columns_col, values_col, agg_func, column_values, max_columns)
    cells = [n for n in wide.columns if n != index_col]
    total = F.lit(0.0)
    for n in cells:
        total = total + F.coalesce(c(n).cast("double"), F.lit(0.0))
    ordered = wide.orderBy(total.desc(), c(index_col).asc())
    return ordered if top_n is None else ordered.limit(top_n)


def cumulative(df: DataFrame, column: str) -> DataFrame:
    """(value, cumulative_pct) for every distinct value."""
    require_numeric(df, [column])
    counts = df.select(c(column).cast("double").alias("value")).where("value is not null").groupBy("value").agg(
        F.count(F.lit(1)).alias("n"))
    placed = running_totals(counts, ["value"], {"before": "n"})
    total = placed.agg(F.sum("n")).first()[0]
    return placed.select("value", div((F.col("before") + F.col("n")) * 100.0, F.lit(total)).alias("cumulative_pct"))


def cumulative_marks(df: DataFrame, column: str) -> DataFrame:
    """The 25, 50, 75 and 90 % points of the curve."""
    marks = [25, 50, 75, 90]
    found = quantile_values(df, {column: [m / 100 for m in marks]})[column] or [None] * 4
    return df.sparkSession.createDataFrame(list(zip(marks, found)), "pct int, value double")
