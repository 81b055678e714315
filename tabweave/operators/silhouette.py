"""Silhouette in Euclidean distance, with a bound of its error.

A cluster is a tree of cells with counts, means and variances.  The mean
distance of a point to the rows of a cell lies between that to their mean, D, and
sqrt(D^2 + variance).  A point opens only cells for which the two are too far
apart, so rows never meet each other, and every score is known to lie in an
interval.  The tree has a bounded number of cells; where that is too few for
the tolerance, the reported error is larger, and no row is left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import as_list, c, require_columns, require_numeric
from tabweave.functions.transforms import fit_scaling
from tabweave.operators.clustering import NOISE

# halvings of the columns' ranges, at most
LEVELS = 20
# cells of the lowest level, about
CELLS = 50_000
# points that meet the tree together
CHUNK = 256


@dataclass
class Tree:
    """All nodes, those of one level after those of the level above."""

    clusters: list[str]
    sizes: np.ndarray  # rows of each cluster
    n: np.ndarray
    mean: np.ndarray
    variance: np.ndarray  # mean squared distance to the mean
    cluster: np.ndarray
    first: np.ndarray  # first child
    children: np.ndarray  # number of them
    roots: int


def build_tree(cluster: np.ndarray, keys: np.ndarray, n: np.ndarray, mean: np.ndarray, square: np.ndarray,
               clusters: list[str], level: int) -> Tree:
    """The tree over the cells of one level: their places, rows, means and mean squared lengths."""
    cells = (cluster, keys, n, mean, square, np.zeros(len(n), np.int64), np.zeros(len(n), np.int64))
    levels = [cells]
    while level:
        cluster, keys, n, mean, square, _, _ = cells
        above, parent = np.unique(np.column_stack([cluster, keys >> 1]), axis=0, return_inverse=True)
        parent = parent.ravel()
        # the children of a cell stand together
        order = np.argsort(parent, kind="stable")
        levels[-1] = tuple(v[order] for v in cells)
        total, count = np.bincount(parent, n), np.bincount(parent)
        cells = (above[:, 0], above[:, 1:], total, np.column_stack([np.bincount(parent, v * n) / total for v in mean.T]),
                 np.bincount(parent, square * n) / total, np.cumsum(count) - count, count)
        levels.append(cells)
        level -= 1
    levels.reverse()
    starts = np.cumsum([len(x[0]) for x in levels])
    cluster, _, n, mean, square, _, children = (np.concatenate(x) for x in zip(*levels))
    first = np.concatenate([x[5] + at for x, at in zip(levels, starts)])
    sizes = np.bincount(levels[0][0], levels[0][2], len(clusters))
    return Tree(clusters, sizes, n, mean, np.maximum(square - (mean**2).sum(1), 0), cluster, first, children, len(levels[0][0]))


def distance_sums(tree: Tree, x: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the sum of distances of each point to the rows of each cluster."""
    k = len(tree.clusters)
    low, high = np.zeros(len(x) * k), np.zeros(len(x) * k)
    point = np.repeat(np.arange(len(x)), tree.roots)
    node = np.tile(np.arange(tree.roots), len(x))
    while len(node):
        near = np.sqrt(((x[point] - tree.mean[node]) ** 2).sum(1))
        far = np.sqrt(near * near + tree.variance[node])
        done = (far - near <= 2 * tolerance) | (tree.children[node] == 0)
        at, n = point[done] * k + tree.cluster[node[done]], tree.n[node[done]]
        low += np.bincount(at, near[done] * n, len(low))
        high += np.bincount(at, far[done] * n, len(low))
        point, node = point[~done], node[~done]
        count = tree.children[node]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        point, node = np.repeat(point, count), np.repeat(tree.first[node], count) + step
    return low.reshape(-1, k), high.reshape(-1, k)


def _score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = np.maximum(a, b)
    return np.divide(b - a, most, out=np.zeros_like(a), where=most > 0)


def score_bounds(tree: Tree, x: np.ndarray, own: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest silhouette that each point can have."""
    rows = np.arange(len(x))
    alone = tree.sizes[own] == 1
    a, b = [], []
    for sums in distance_sums(tree, x, tolerance):
        a.append(sums[rows, own] / np.maximum(tree.sizes[own] - 1, 1))
        others = sums / tree.sizes
        others[rows, own] = np.inf
        b.append(others.min(1))
    low, high = _score(a[1], b[0]), _score(a[0], b[1])
    return np.where(alone, 0.0, low), np.where(alone, 0.0, high)


def silhouette_euclidean(df: DataFrame, cluster_column: str, feature_columns: Sequence[str], tolerance: float = 0.005,
                         cells: int = CELLS) -> DataFrame:
    """(silhouette, error, n_clusters, n_used, quality): the mean silhouette in
    Euclidean distance on standardised columns lies within ``error`` of ``silhouette``.

    ``tolerance`` is that of one mean distance; tasks hold about ``cells`` cells
    at most.  A row that is its cluster's only one scores 0.  Missing values
    count as 0; rows without cluster and noise (-1) are left out; fewer
    than 2 clusters, or more than ``cells``, are an error.
    """
    names = as_list(feature_columns)
    require_columns(df, [cluster_column])
    require_numeric(df, names)
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    label = c(cluster_column)
    used = df.where(label.isNotNull() & (label.cast("string") != str(NOISE)))
    scaling = fit_scaling(used, names, "standard", fill=0.0)
    xs = [f"_x{i}" for i in range(len(names))]
    values = used.select(label.cast("string").alias("g"), *[
        (scaling.column(n, fill=0.0) + F.lit(0.0)).alias(x) for n, x in zip(names, xs)])
    points = values.groupBy("g", *xs).agg(F.count(F.lit(1)).alias("w"))
    ends = values.agg(F.approx_count_distinct("g"), *[f(x) for x in xs for f in (F.min, F.max)]).first()
    origin = [ends[1 + 2 * i] for i in range(len(xs))]
    width = [(ends[2 + 2 * i] - origin[i] or 1.0) if ends[1 + 2 * i] is not None else 1.0 for i in range(len(xs))]

    def place(x: int, level: int) -> Column:
        side = F.least(F.floor((F.col(xs[x]) - F.lit(origin[x] or 0.0)) / F.lit(width[x]) * (1 << level)), F.lit((1 << level) - 1))
        return side.cast("long")

    # cells of every level, nearly; the lowest level is the last with few enough
    counts = values.agg(*[F.approx_count_distinct(F.xxhash64("g", *[place(i, level) for i in range(len(xs))])).alias(f"l{level}")
                          for level in range(LEVELS + 1)]).first()
    # the error of a smaller cell is below the tolerance anyway
    fine = [level for level in range(LEVELS + 1) if counts[level] <= cells]
    if not fine and counts[0]:
        raise ValueError(f"more than {cells} clusters; raise cells")
    level = next((v for v in fine if sum(w * w for w in width) ** 0.5 / (1 << v) <= tolerance), max(fine, default=0))
    squares = F.lit(0.0)
    for x in xs:
        squares = squares + F.col(x) * F.col(x)
    # about ``cells`` rows
    leaves = values.groupBy("g", *[place(i, level).alias(f"k{i}") for i in range(len(xs))]).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(x).alias(x) for x in xs], F.avg(squares).alias("sq")).toArrow()
    clusters = sorted(set(leaves.column("g").to_pylist()))
    if len(clusters) < 2:
        raise ValueError("at least 2 clusters are needed")
    number = {g: i for i, g in enumerate(clusters)}
    table = lambda columns: np.column_stack([leaves.column(n).to_numpy() for n in columns])
    tree = build_tree(np.array([number[g] for g in leaves.column("g").to_pylist()]), table([f"k{i}" for i in range(len(xs))]),
                      leaves.column("n").to_numpy(), table(xs), leaves.column("sq").to_numpy(), clusters, level)
    held = df.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        number = {g: i for i, g in enumerate(tree.clusters)}
        # many clusters: fewer points at a time
        step = max(1, CHUNK * 64 // max(64, tree.roots))
        for b in batches:
            own = np.array([number[g] for g in b.column(0).to_pylist()], np.int64)
            x = np.column_stack([v.to_numpy() for v in b.columns[1:-1]]) if b.num_rows else np.zeros((0, 1))
            w = b.column(b.num_columns - 1).to_numpy()
            low, high = 0.0, 0.0
            for i in range(0, len(x), step):
                bounds = score_bounds(tree, x[i:i + step], own[i:i + step], tolerance)
                low, high = low + float(bounds[0] @ w[i:i + step]), high + float(bounds[1] @ w[i:i + step])
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (low, high, int(w.sum()))], names=["low", "high", "n"])

    sums = points.mapInArrow(run, "low double, high double, n long").agg(
        (F.sum("low") / F.sum("n")).alias("low"), (F.sum("high") / F.sum("n")).alias("high"), F.sum("n").alias("n_used"))
    score = (F.col("low") + F.col("high")) / 2
    return sums.select(score.alias("silhouette"), ((F.col("high") - F.col("low")) / 2).alias("error"),
                       F.lit(len(clusters)).cast("long").alias("n_clusters"), "n_used",
                       F.when(score >= 0.7, "Excellent").when(score >= 0.5, "Good").when(score >= 0.25, "Fair")
                       .otherwise("Poor").alias("quality"))
