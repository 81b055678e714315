"""Feature selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import c, is_numeric, numeric_columns, require_choice, require_columns, require_numeric
from tabweave.core.numeric import div
from tabweave.functions.transforms import bin_index
from tabweave.core.quantile import quantile_values
from tabweave.core.scan import attach
from tabweave.operators.correlation import correlation_pairs
from tabweave.operators.features import LABEL, VECTOR, feature_columns, with_features
from tabweave.operators.modeling import _drawn_cells, _kept, fit_forest, importances


def correlation_filter(df: DataFrame, target_column: str, threshold: float = 0.05,
                       method: str = "pearson") -> DataFrame:
    """(column, abs_corr, below): a constant column has neither answer."""
    require_numeric(df, [target_column])
    names = numeric_columns(df, [target_column])
    pairs = correlation_pairs(df, [(n, target_column) for n in names], method)
    return pairs.select(F.col("x").alias("column"), F.abs("corr").alias("abs_corr"),
                        (F.abs("corr") < threshold).alias("below"))


def variance_filter(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(column, variance, low) for every numeric column."""
    names = numeric_columns(df)
    if not names:
        raise ValueError("no numeric columns")
    wide = df.agg(*[F.var_samp(c(n).cast("double")).alias(n) for n in names])
    long = wide.unpivot([], [c(n) for n in names], "column", "variance")
    return long.withColumn("low", F.col("variance") <= threshold)


LOW_METHODS = ("variance", "correlation")


def drop_low_importance(df: DataFrame, target_column: str, method: str = "variance",
                        threshold: float = 0.01) -> DataFrame:
    """Drop numeric columns at or below the threshold; the target stays."""
    require_choice(method, LOW_METHODS, "method")
    if method == "variance":
        found = variance_filter(df, threshold).where(F.col("low") & (F.col("column") != target_column))
    else:
        found = correlation_filter(df, target_column, threshold).where(F.col("abs_corr") <= threshold)
    return df.drop(*[r["column"] for r in found.collect()])


IMPORTANCE_METHODS = ("random_forest", "mutual_info_classif", "mutual_info_regression")


def feature_importance(df: DataFrame, target_column: str, method: str = "random_forest", top_n: int = 20,
                       bins: int = 10, trees: int = 100, max_depth: int = 10, seed: int = 42) -> DataFrame:
    """(rank, feature, importance): a forest's importances, or the mutual
    information of quantile-binned features with the target."""
    require_choice(method, IMPORTANCE_METHODS, "method")
    require_columns(df, [target_column])
    if method == "random_forest":
        scores = _forest_importance(df, target_column, trees, max_depth, seed)
    else:
        scores = mutual_information(df, target_column, method == "mutual_info_regression", bins)
    top = scores.orderBy(F.desc("importance"), "feature").limit(top_n)
    # numbering at most top_n rows
    return top.selectExpr("cast(row_number() over (partition by 0 order by importance desc, feature) as int) as rank",
                          "feature", "importance")


def _forest_importance(df, target_column, trees, max_depth, seed):
    names = feature_columns(df, target_column)
    data = with_features(df, names)
    kind = RandomForestRegressor
    if is_numeric(df, target_column):
        data = data.withColumn(LABEL, c(target_column).cast("double"))
    else:
        kind = RandomForestClassifier
        data = StringIndexer(inputCol=target_column, outputCol=LABEL).fit(data).transform(data)
    data = data.select(VECTOR, LABEL).where(F.col(LABEL).isNotNull())
    cells = _drawn_cells(data, trees, seed) if kind is RandomForestRegressor else None
    if cells is None:
        model = kind(featuresCol=VECTOR, labelCol=LABEL, numTrees=trees, maxDepth=max_depth, seed=seed).fit(data)
    else:
        # the share of features that "auto" means for a regression forest
        params = {"numTrees": trees, "maxDepth": max_depth, "seed": seed,
                  "featureSubsetStrategy": "onethird" if trees > 1 else "all"}
        with _kept(cells) as kept:
            model = fit_forest(kept, params)
    rows = [(n, float(v)) for n, v in zip(names, importances(model))]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def mutual_information(df: DataFrame, target_column: str, continuous_target: bool, bins: int = 10,
                       features: Sequence[str] | None = None) -> DataFrame:
    """(feature, importance) in nats, from one grouped count of all features."""
    names = list(features or feature_columns(df, target_column))
    require_numeric(df, names)
    cut = [i / bins for i in range(bins + 1)]
    x = {n: F.coalesce(c(n).cast("double"), F.lit(0.0)) for n in names}
    y = c(target_column)
    binned = [*names, target_column] if continuous_target else names
    source = df.select(*[(x[n] if n in x else y.cast("double")).alias(n) for n in binned])
    found = quantile_values(source, {n: cut for n in binned})
    edges = {n: sorted(set(q or [])) for n, q in found.items()}

    def place(v, n):
        return bin_index(v, edges[n]) if len(edges[n]) > 1 else F.lit(0)

    label = place(y.cast("double"), target_column).cast("string") if continuous_target else y.cast("string")
    rows = df.where(y.isNotNull()).select(label.alias("y"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), place(x[n], n).alias("b")) for n in names])).alias("f")).select(
            "y", "f.feature", "f.b")
    cells = rows.groupBy("feature", "b", "y").agg(F.count(F.lit(1)).alias("n"))
    by_bin = cells.groupBy("feature", "b").agg(F.sum("n").alias("nb"))
    by_label = cells.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    totals = cells.groupBy("feature").agg(F.sum("n").alias("nt"))
    joined = attach(attach(attach(cells, by_bin, ["feature", "b"]), by_label, ["feature", "y"]), totals, ["feature"])
    p = div(F.col("n"), F.col("nt"))
    return joined.groupBy("feature").agg(F.sum(
        p * F.ln(F.col("n") * F.col("nt").cast("double") / (F.col("nb").cast("double") * F.col("ny")))).alias("importance"))
