"""Mutual information by nearest neighbours, as joins on balanced cells.

The plane of a feature and the target is cut into strips of about equal numbers
of points, and each strip into cells, by rank.  A point's k-th neighbour inside
its own cell bounds the distance; only points whose square of that size leaves
the cell ask other cells, found by an ordered scan.  Neighbours on each axis are
counted by running totals.  Equal points are one weighted point, so no value
fills a cell, and no group but the strips' borders grows with the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import inf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import c, require_columns, require_numeric, without_nan
from tabweave.core.scan import attach, attach_measured, carry_forward, row_numbers, running_totals
from tabweave.operators.features import feature_columns
from tabweave.session import cut_lineage

# points of a cell, at least and at most twice
CELL = 512
_EULER = 0.5772156649015329
# relative error of an end of a range
ROUNDING = 2.0**-50


def neighbour_information(df: DataFrame, target_column: str, features: Sequence[str] | None = None, k: int = 3,
                          cell: int = CELL, continuous_target: bool = True) -> DataFrame:
    """(feature, importance): mutual information with the target, in nats, by
    the distances to the k-th nearest neighbours.

    Both columns are divided by their standard deviation.  With e the largest
    of the differences on the two axes to a row's k-th neighbour, nx and ny
    count the rows (itself too) that differ by less than e on one axis; where e
    is 0, the equal ones; what differs by e within rounding does not count.  The estimate is psi(n) + psi(k) - mean(psi(nx) +
    psi(ny)), at least 0.  No noise is added, so it is the same every time.

    With classes as target e is the difference to the k-th nearest row of the
    same class (the farthest, where a class has at most k rows), and the estimate
    psi(n) + mean(psi(k)) - mean(psi(rows of the class) + psi(nx)); rows that
    are alone in their class do not count.

    A missing feature value counts as 0; rows without target are left out; a
    table of at most k rows has a null estimate.
    """
    names = list(features or feature_columns(df, target_column))
    require_columns(df, [target_column])
    require_numeric(df, [*names, target_column] if continuous_target else names)
    if k < 1 or cell <= k:
        raise ValueError("k must be positive and below the size of a cell")
    if not continuous_target:
        return _class_information(df, target_column, names, k, cell)
    y = without_nan(c(target_column).cast("double"))
    used = df.select(y.alias("_y"), *[F.coalesce(without_nan(c(n).cast("double")), F.lit(0.0)).alias(f"_x{i}")
                                      for i, n in enumerate(names)]).where("_y is not null")
    spread = used.agg(F.count(F.lit(1)), *[F.stddev_pop(x) for x in used.columns]).first()
    scaled = lambda x, s: (F.col(x) / F.lit(s or 1.0) + F.lit(0.0))
    found = []
    for i, name in enumerate(names):
        value = None
        if spread[0] > k:
            pairs = used.select(scaled(f"_x{i}", spread[i + 2]).alias("x"), scaled("_y", spread[1]).alias("y"))
            value = _information(pairs, spread[0], k, cell)
        found.append((name, value))
    return df.sparkSession.createDataFrame(found, "feature string, importance double")


def _class_information(df: DataFrame, target_column: str, names: list[str], k: int, cell: int) -> DataFrame:
    used = df.select(c(target_column).cast("string").alias("_g"), *[
        F.coalesce(without_nan(c(n).cast("double")), F.lit(0.0)).alias(f"_x{i}") for i, n in enumerate(names)]).where(
            "_g is not null")
    classes = used.groupBy("_g").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    used = cut_lineage(attach_measured(used, row_numbers(classes, [F.col("_g").asc()], "code"), ["_g"], "inner"))
    spread = used.agg(F.count(F.lit(1)), *[f(f"_x{i}") for i in range(len(names)) for f in (F.stddev_pop, F.min, F.max)]).first()
    found = []
    for i, name in enumerate(names):
        value = None
        if spread[0]:
            deviation, low, high = spread[1 + 3 * i:4 + 3 * i]
            # classes lie so far apart that the nearest rows are of the same one
            apart = (high - low) / (deviation or 1.0) + 1.0
            points = cut_lineage(used.select((F.col(f"_x{i}") / F.lit(deviation or 1.0) + F.lit(0.0)).alias("x"),
                                             (F.col("code") * F.lit(apart)).alias("y"), "rows").groupBy("x", "y").agg(
                                                 F.count(F.lit(1)).alias("w"), F.first("rows").alias("rows")))
            least = F.least(F.col("rows") - 1, F.lit(k)).cast("int")
            near = _neighbours(points.select("x", "y", "w"), k, cell)
            reach = cut_lineage(attach(near, points.select("x", "y", "rows"), ["x", "y"]).select(
                "x", "y", "w", F.get("near", least - 1).alias("e"), least.alias("least"), "rows"))
            own = F.sum(F.col("w") * (psi(F.col("least")) - psi(F.col("rows")))) / spread[0]
            around = _axis_counts(reach.select("x", "y", "w", "e"), ["x"]).agg(F.sum(F.col("w") * psi(F.col("n"))) / spread[0])
            value = max(0.0, _harmonic(spread[0]) + reach.agg(own).first()[0] - around.first()[0])
        found.append((name, value))
    return df.sparkSession.createDataFrame(found, "feature string, importance double")


def psi(n: Column) -> Column:
    """The digamma function of whole numbers from 1."""
    z = n + F.lit(8.0)
    series = F.ln(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
    for j in range(8):
        series = series - F.lit(1.0) / (n + F.lit(float(j)))
    return series


def _harmonic(n: int) -> float:
    """The digamma function of one whole number."""
    if n < 10_000:
        return sum(1 / i for i in range(1, n)) - _EULER
    return float(np.log(n)) - 1 / (2 * n) - 1 / (12 * n**2)


def _information(pairs: DataFrame, n: int, k: int, cell: int) -> float:
    points = cut_lineage(pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))
    reach = cut_lineage(neighbour_distances(points, k, cell))
    mean = _axis_counts(reach).agg(F.sum(F.col("w") * psi(F.col("n"))) / n).first()[0]
    return max(0.0, _harmonic(n) + _harmonic(k) - mean)


def neighbour_distances(points: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """``x, y, w, e`` of distinct points with weights: the larger of both
    differences to the k-th nearest, where a point's own copies are its neighbours."""
    return _neighbours(points, k, cell).select("x", "y", "w", F.col("near")[k - 1].alias("e"))


def _neighbours(points: DataFrame, k: int, cell: int) -> DataFrame:
    """``x, y, w, near`` of distinct points: the distances in ascending order, right up to the k-th."""
    cells, strips = _cells(points, cell)
    near = cut_lineage(_own_cell(cells, strips, k))
    asked = _asked_cells(near, cells)

    def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return _FOUND.empty_table()
        a, b = _xyw(asking, "u"), _xyw(held, "w")
        found = [_nearest(a[0][i:i + 512], a[1][i:i + 512], *b, k) for i in range(0, len(a[0]), 512)]
        return pa.table([asking.column("x"), asking.column("y"), pa.array(list(np.concatenate(found)), pa.list_(pa.float64()))],
                        schema=_FOUND)

    more = asked.groupBy("strip", "cell").cogroup(cells.groupBy("strip", "cell")).applyInArrow(meet, _FOUND_SQL)
    more = more.groupBy("x", "y").agg(F.flatten(F.collect_list("near")).alias("more"))
    both = F.concat("near", F.coalesce("more", F.array().cast("array<double>")))
    return attach(near, more, ["x", "y"]).select("x", "y", "w", F.sort_array(both).alias("near"))


def _cells(points: DataFrame, cell: int) -> tuple[DataFrame, list[tuple[int, float, float]]]:
    """Distinct points with their strip and cell, and each strip's first and last
    ``x``.  Every strip and cell has at least ``cell`` points, if the table has."""
    columns = points.groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    before = cut_lineage(running_totals(columns, ["x"], {"before": "m"}))
    n = points.count()
    size = max(cell, int(sqrt(n * cell)))
    raw = before.withColumn("raw", F.floor(F.col("before") / size))
    # as many rows as the root of (points / cell)
    found = sorted(raw.groupBy("raw").agg(F.sum("m").alias("m"), F.min("x").alias("x0"), F.max("x").alias("x1")).collect())
    merged: list[list] = []  # raw strips, points, first and last x
    for r in found:
        if merged and (r.m < cell or merged[-1][1] < cell):
            merged[-1] = [[*merged[-1][0], r.raw], merged[-1][1] + r.m, merged[-1][2], r.x1]
        else:
            merged.append([[r.raw], r.m, r.x0, r.x1])
    names = points.sparkSession.createDataFrame(
        [(raw, i, max(m // cell, 1) - 1) for i, (raws, m, _, _) in enumerate(merged) for raw in raws],
        "raw long, strip int, last long")
    strip_of = raw.join(F.broadcast(names), "raw").select("x", "strip", "last")
    placed = attach(points, strip_of, ["x"]).withColumn("one", F.lit(1).cast("long"))
    ranked = running_totals(placed, ["y", "x"], {"rank": "one"}, keys=["strip"])
    cells = ranked.select("x", "y", "w", "strip", F.least(F.floor(F.col("rank") / cell), "last").cast("int").alias("cell"))
    return cut_lineage(cells), [(i, x0, x1) for i, (_, _, x0, x1) in enumerate(merged)]


_FOUND = pa.schema([("x", pa.float64()), ("y", pa.float64()), ("near", pa.list_(pa.float64()))])
_FOUND_SQL = "x double, y double, near array<double>"
_OWN = pa.schema([("x", pa.float64()), ("y", pa.float64()), ("w", pa.int64()), ("strip", pa.int32()), ("cell", pa.int32()),
                  ("near", pa.list_(pa.float64())), ("strips", pa.list_(pa.int32()))])
_OWN_SQL = "x double, y double, w long, strip int, cell int, near array<double>, strips array<int>"


def _xyw(table: pa.Table, third: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(table.column(n).to_numpy() for n in ("x", "y", third))


def _nearest(x, y, xs, ys, ws, k: int, own: int | None = None) -> np.ndarray:
    """For each point the distances to the k nearest of others, counted by
    weight; missing ones are infinite.  ``own``: the place of the first point among the others."""
    d = np.maximum(np.abs(x[:, None] - xs), np.abs(y[:, None] - ys))
    most = min(k + 1, len(xs))
    at = np.argpartition(d, most - 1, axis=1)[:, :most]
    w = ws[at]
    if own is not None:
        # distinct points: only the point itself is at distance 0
        w = w - (at == own + np.arange(len(x))[:, None])
    d = np.take_along_axis(d, at, 1)
    order = np.argsort(d, axis=1)
    d, total = np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1).cumsum(axis=1)
    out = np.full((len(x), k), inf)
    for i in range(k):
        enough = total > i
        some = enough.any(axis=1)
        out[some, i] = d[some, enough.argmax(axis=1)[some]]
    return out


def _own_cell(cells: DataFrame, strips: list[tuple[int, float, float]], k: int) -> DataFrame:
    """The k nearest inside the own cell, and the strips where others may be nearer."""
    held = cells.sparkSession.sparkContext.broadcast((np.array([s[1] for s in strips]), np.array([s[2] for s in strips])))

    def run(table: pa.Table) -> pa.Table:
        starts, ends = held.value
        x, y, w = _xyw(table, "w")
        near = np.concatenate([_nearest(x[i:i + 512], y[i:i + 512], x, y, w, k, i) for i in range(0, len(x), 512)])
        u = near[:, -1]
        first = np.searchsorted(ends, x - u, "right")
        last = np.searchsorted(starts, x + u, "left") - 1
        own = table.column("strip")[0].as_py()
        inside = (y - u >= y.min()) & (y + u <= y.max())
        asked = [[s for s in range(a, b + 1) if s != own or not i] for a, b, i in zip(first, last, inside)]
        return pa.table([table.column("x"), table.column("y"), table.column("w"), table.column("strip"), table.column("cell"),
                         pa.array(list(near), pa.list_(pa.float64())), pa.array(asked, pa.list_(pa.int32()))], schema=_OWN)

    return cells.groupBy("strip", "cell").applyInArrow(run, _OWN_SQL)


def _asked_cells(near: DataFrame, cells: DataFrame) -> DataFrame:
    """``strip, cell, x, y, u``: the other cells that may hold a nearer point."""
    bounds = cells.groupBy("strip", "cell").agg(F.min("y").alias("v")).select(
        "strip", "v", F.lit(1).alias("kind"), "cell", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("x", "double"), ("y", "double"), ("u", "double"), ("own", "int"), ("end", "int"))])
    asking = near.select("x", "y", F.element_at("near", -1).alias("u"), F.col("strip").alias("home"),
                         F.col("cell").alias("own_cell"), F.explode("strips").alias("strip"))
    # cells that start before an end of the square; kind 0 comes before a cell that starts there
    ends = asking.select("strip", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("cell"), "x", "y", "u",
                         F.when(F.col("home") == F.col("strip"), F.col("own_cell")).alias("own"),
                         F.explode(F.array(F.lit(-1), F.lit(1))).alias("end")).withColumn("v", F.col("y") + F.col("end") * F.col("u"))
    rows = bounds.unionByName(ends)
    found = carry_forward(rows, ["cell"], [F.col("v").asc(), F.col("kind").asc(), F.col("cell").asc()],
                          ["strip"]).where("end is not null")
    both = found.groupBy("strip", "x", "y", "u", "own").agg(
        F.max(F.when(F.col("end") < 0, F.col("cell"))).alias("first"), F.max(F.when(F.col("end") > 0, F.col("cell"))).alias("last"))
    every = both.where("last is not null").select(
        "strip", "x", "y", "u", "own", F.explode(F.sequence(F.coalesce("first", F.lit(0)), "last")).alias("cell"))
    return every.where("own is null or own <> cell").select("strip", "cell", "x", "y", "u")


def _axis_counts(reach: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """``w, n`` per point and axis: the rows that differ by less than its distance."""
    data = [reach.groupBy(F.col(a).alias("v")).agg(F.sum("w").alias("held")).select(F.lit(a).alias("axis"), "v", F.lit(1).alias("kind"),
            "held", *[F.lit(None).cast(t).alias(n) for n, t in (("x", "double"), ("y", "double"), ("w", "long"), ("sign", "int"))])
            for a in axes]
    # what differs by e within rounding does not differ by less
    tight = {a: F.greatest(F.col("e") - F.lit(ROUNDING) * (F.abs(a) + F.col("e")), F.lit(0.0)) for a in axes}
    # an end counts what comes before it: equal values belong inside where nothing else does
    asked = [reach.select(F.lit(a).alias("axis"), (F.col(a) + F.lit(s) * tight[a]).alias("v"),
                          F.when(tight[a] == 0, 1 + s).otherwise(1 - s).alias("kind"), F.lit(0).cast("long").alias("held"),
                          "x", "y", "w", F.lit(s).alias("sign"))
             for a in axes for s in (-1, 1)]
    rows = data[0]
    for other in (*data[1:], *asked):
        rows = rows.unionByName(other)
    counted = running_totals(rows, ["v", "kind", "x", "y"], {"before": "held"}, keys=["axis"]).where("sign is not null")
    return counted.groupBy("axis", "x", "y").agg(F.max("w").alias("w"), F.sum(F.col("sign") * F.col("before")).alias("n"))
