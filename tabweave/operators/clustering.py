"""k-means, the elbow curve, cluster quality and profiles."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import as_list, c, numeric_columns, require_columns, require_numeric
from tabweave.core.numeric import div
from tabweave.core.quantile import SMALL_DISTINCT, grouped_stats
from tabweave.functions.transforms import Scaling, fit_scaling
from tabweave.operators.lloyd import Problem, packed, solve

STARTS = 10
NOISE = -1


@contextmanager
def _points(data: DataFrame, scaling: Scaling, names: Sequence[str]):
    """The distinct scaled points with the number of their rows, in blocks, kept for all scans."""
    values = data.select(F.array(*[scaling.column(n, fill=0.0) for n in names]).alias("x"))
    distinct = values.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("w")).withColumn("h", F.xxhash64("x"))
    points = packed(distinct, len(names)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield points
    finally:
        points.unpersist()


def _distance(x: Sequence[Column], centre: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [(v - F.lit(float(m))) * (v - F.lit(float(m))) for v, m in zip(x, centre)])


def kmeans_cluster(df: DataFrame, columns: Sequence[str], n_clusters: int = 3, cluster_column: str = "cluster",
                   random_state: int = 42, starts: int = STARTS) -> tuple[DataFrame, float]:
    """(rows with cluster number, inertia) on standardised columns; the best
    of several starts, clusters numbered by the order of their centres.

    All starts share each scan of the points.  Missing values count as the mean.
    """
    names = as_list(columns)
    scaling = fit_scaling(df, names, "standard", fill=0.0)
    with _points(df, scaling, names) as points:
        cost, centres = min(solve(points, [Problem(n_clusters, random_state * 1000 + s) for s in range(starts)]),
                            key=lambda found: found[0])
    x = [scaling.column(n, fill=0.0) for n in names]
    centres = sorted(map(tuple, centres.tolist()))
    nearest = F.array_min(F.array(*[F.struct(_distance(x, m).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(centres)]))["i"]
    kept = [n for n in df.columns if n != cluster_column]
    return df.select(*map(c, kept), (nearest if centres else F.lit(None).cast("int")).alias(cluster_column)), cost


def elbow_curve(df: DataFrame, columns: Sequence[str], max_k: int = 10, random_state: int = 42,
                starts: int = STARTS) -> DataFrame:
    """(k, inertia) for k = 2..max_k; all starts of all k share each scan."""
    names = as_list(columns)
    scaling = fit_scaling(df, names, "standard", fill=0.0)
    problems = [Problem(k, random_state * 1000 + s) for k in range(2, max_k + 1) for s in range(starts)]
    with _points(df, scaling, names) as points:
        found = solve(points, problems)
    best = {k: min(cost for p, (cost, _) in zip(problems, found) if p.k == k) for k in range(2, max_k + 1)}
    return df.sparkSession.createDataFrame(list(best.items()), "k int, inertia double")


def cluster_sizes(df: DataFrame, cluster_column: str) -> DataFrame:
    counts = df.groupBy(c(cluster_column).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    total = df.count()
    return counts.withColumn("pct", F.col("size") * 100.0 / F.lit(float(total or 1)))


# clusters that every row is compared with, unless the caller allows more
MAX_CLUSTERS = 1000


def silhouette_score(df: DataFrame, cluster_column: str, feature_columns: Sequence[str],
                     max_clusters: int = MAX_CLUSTERS) -> DataFrame:
    """Mean silhouette in squared Euclidean distance on standardised columns,
    noise (-1) left out.

    The mean squared distance of a row to a cluster follows from the cluster's
    size, mean and mean square, so rows meet cluster summaries and never each
    other.
    """
    names = as_list(feature_columns)
    require_columns(df, [cluster_column])
    require_numeric(df, names)
    label = c(cluster_column)
    used = df.where(label.isNotNull() & (label.cast("string") != str(NOISE)))
    scaling = fit_scaling(used, names, "standard", fill=0.0)
    points = used.select(label.cast("string").alias("g"), F.array(*[
        scaling.column(n, fill=0.0) for n in names]).alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    facts = points.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.avg(square).alias("sq"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(names))]).limit(max_clusters + 1).collect()
    if len(facts) < 2:
        raise ValueError("at least 2 clusters are needed")
    if len(facts) > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters; raise max_clusters")
    # a lookup of one row, with at most max_clusters summaries
    held = df.sparkSession.createDataFrame(
        [([(r.g, float(r.n), r.sq, [r[f"m{i}"] for i in range(len(names))]) for r in facts],)],
        "clusters array<struct<g:string, n:double, sq:double, m:array<double>>>")
    clusters = F.col("clusters")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    # the mean over a row's own cluster leaves the row itself out
    distance = F.transform(clusters, lambda k: F.struct(
        (k["g"] == F.col("g")).alias("own"), k["n"].alias("n"),
        F.greatest(square + k["sq"] - F.lit(2.0) * dot(F.col("x"), k["m"]), F.lit(0.0)).alias("d")))
    measured = points.crossJoin(F.broadcast(held)).select(distance.alias("k")).select(
        F.filter("k", lambda k: k["own"])[0].alias("own"),
        F.array_min(F.transform(F.filter("k", lambda k: ~k["own"]), lambda k: k["d"])).alias("b"))
    n, b = F.col("own.n"), F.col("b")
    a = div(F.col("own.d") * n, n - 1)
    value = F.when(n == 1, F.lit(0.0)).otherwise(F.coalesce(div(b - a, F.greatest(a, b)), F.lit(0.0)))
    score = F.avg(value)
    return measured.agg(score.alias("silhouette_sq"), F.lit(len(facts)).cast("long").alias("n_clusters"),
                        F.count(F.lit(1)).alias("n_used")).withColumn(
        "quality", F.when(F.col("silhouette_sq") >= 0.7, "Excellent").when(F.col("silhouette_sq") >= 0.5, "Good")
        .when(F.col("silhouette_sq") >= 0.25, "Fair").otherwise("Poor"))


def cluster_profile(df: DataFrame, cluster_column: str, features: Sequence[str] | None = None,
                    small: int = SMALL_DISTINCT) -> DataFrame:
    """Size, and mean and median of each feature, per cluster."""
    require_columns(df, [cluster_column])
    names = as_list(features) or numeric_columns(df, [cluster_column])
    require_numeric(df, names)
    rows = df.select(c(cluster_column), *[c(n) for n in names]).where(c(cluster_column).isNotNull())
    wide = grouped_stats(rows, [cluster_column], [F.count(F.lit(1)).alias("size"), *[
        F.round(F.avg(c(n).cast("double")), 4).alias(f"{n}_mean") for n in names]], {n: [0.5] for n in names}, small)
    return wide.select(c(cluster_column), "size", *[e for n in names for e in (
        c(f"{n}_mean"), F.round(c(f"q_{n}")[0], 4).alias(f"{n}_median"))])
