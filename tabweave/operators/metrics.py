"""Scores and curves of predictions that are already columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import c, require_columns, require_numeric
from tabweave.core.numeric import div
from tabweave.core.scan import attach, running_totals
from tabweave.operators.charts import histogram, scatter_bins
from tabweave.operators.relational import MAX_DISTINCT


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MAE, MSE, RMSE and R squared in one aggregate."""
    require_numeric(df, [label, prediction])
    y, p = c(label).cast("double"), c(prediction).cast("double")
    rows = df.select(y.alias("y"), (y - p).alias("e")).dropna()
    mse = F.avg(F.col("e") * F.col("e"))
    return rows.agg(F.avg(F.abs("e")).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
                    (1 - div(mse, F.var_pop("y"))).alias("r2"))


def label_pairs(df: DataFrame, label: str, prediction: str) -> DataFrame:
    require_columns(df, [label, prediction])
    return df.select(c(label).cast("string").alias("label"), c(prediction).cast("string").alias("prediction")).dropna(
    ).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str, positive="1") -> DataFrame:
    """Accuracy, precision, recall, F1.  Up to two true classes: of the
    positive class; more: averaged by class size.  0 where undefined."""
    pairs = label_pairs(_same_text(df, label, prediction), "label", "prediction")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    true = pairs.groupBy("label").agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    called = pairs.groupBy("prediction").agg(F.sum("n").alias("called"))
    per_class = attach(true, called.select(F.col("prediction").alias("label"), "called"), ["label"]).select(
        "label", "support", "tp", F.coalesce("called", F.lit(0)).alias("called"))
    zero = F.lit(0.0)
    precision = F.coalesce(div(F.col("tp"), F.col("called")), zero)
    recall = F.coalesce(div(F.col("tp"), F.col("support")), zero)
    f1 = F.coalesce(div(F.col("tp") * 2, F.col("called") + F.col("support")), zero)
    scored = per_class.select("label", "support", "tp", precision.alias("p"), recall.alias("r"), f1.alias("f"))
    is_positive = F.col("label") == F.lit(str(positive))
    pick = lambda m: F.when(F.count(F.lit(1)) > 2, div(F.sum(F.col("support") * F.col(m)), F.sum("support"))).otherwise(
        F.coalesce(F.max(F.when(is_positive, F.col(m))), zero))
    return scored.agg(div(F.sum("tp"), F.sum("support")).alias("accuracy"), pick("p").alias("precision"),
                      pick("r").alias("recall"), pick("f").alias("f1"))


def _same_text(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Label and prediction as text of one kind, so that 1 equals 1.0."""
    require_columns(df, [label, prediction])
    text = lambda n: F.regexp_replace(c(n).cast("string"), r"\.0$", "")
    return df.select(text(label).alias("label"), text(prediction).alias("prediction"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, limit: int = MAX_DISTINCT) -> DataFrame:
    """Counts with one row per true and one column per predicted label, over
    the union of both."""
    pairs = label_pairs(_same_text(df, label, prediction), "label", "prediction")
    known = pairs.select("label").union(pairs.select(F.col("prediction").alias("label"))).distinct()
    names = [r.label for r in known.limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} labels")
    names.sort(key=_natural)
    # an empty count on the diagonal keeps labels that occur on one side only
    diagonal = known.select("label", F.col("label").alias("prediction"), F.lit(0).cast("long").alias("n"))
    wide = pairs.unionByName(diagonal).groupBy("label").pivot("prediction", names).agg(F.sum("n"))
    return wide.select("label", *[F.coalesce(c(n), F.lit(0)).alias(f"predicted_{n}") for n in names])


def _natural(text: str):
    try:
        return (0, float(text), text)
    except ValueError:
        return (1, 0.0, text)


def residuals(df: DataFrame, label: str, prediction: str, column: str = "residual") -> DataFrame:
    require_numeric(df, [label, prediction])
    return df.withColumn(column, c(label).cast("double") - c(prediction).cast("double"))


def residual_histogram(df: DataFrame, label: str, prediction: str, bins: int = 50) -> DataFrame:
    return histogram(residuals(df, label, prediction, "_residual"), "_residual", bins)


def residual_bins(df: DataFrame, label: str, prediction: str, bins: int = 50) -> DataFrame:
    """Grid counts of prediction (x) against residual (y)."""
    return scatter_bins(residuals(df, label, prediction, "_residual"), prediction, "_residual", bins=bins)


def _by_threshold(df: DataFrame, label: str, score: str) -> tuple[DataFrame, int, int]:
    """Per distinct score, descending: positives and negatives at it and above it."""
    require_numeric(df, [score])
    require_columns(df, [label])
    rows = df.select((c(label).cast("double") > 0).cast("long").alias("y"),
                     c(score).cast("double").alias("score")).dropna()
    counts = rows.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    placed = running_totals(counts, ["score"], {"pos_above": "pos", "neg_above": "neg"}, descending=True)
    pos, neg = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))).first()
    return placed, pos, neg


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score, and the point (0, 0)
    whose threshold is infinite."""
    placed, pos, neg = _by_threshold(df, label, score)
    curve = placed.select(F.col("score").alias("threshold"),
                          div(F.col("neg_above") + F.col("neg"), F.lit(neg)).alias("fpr"),
                          div(F.col("pos_above") + F.col("pos"), F.lit(pos)).alias("tpr"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], curve.schema)
    return start.unionByName(curve)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve by trapezoids, one per distinct score."""
    placed, pos, neg = _by_threshold(df, label, score)
    area = F.sum(F.col("neg").cast("double") * (F.col("pos_above") + F.col("pos") / 2))
    return placed.agg(div(area, F.lit(float(pos) * float(neg))).alias("auc"))


def precision_recall_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall) for each distinct score, and the end
    point of precision 1 and recall 0."""
    placed, pos, _ = _by_threshold(df, label, score)
    hits = F.col("pos_above") + F.col("pos")
    curve = placed.select(F.col("score").alias("threshold"),
                          div(hits, hits + F.col("neg_above") + F.col("neg")).alias("precision"),
                          div(hits, F.lit(pos)).alias("recall"))
    end = df.sparkSession.createDataFrame([(float("inf"), 1.0, 0.0)], curve.schema)
    return end.unionByName(curve)


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of precision times gained recall."""
    placed, pos, _ = _by_threshold(df, label, score)
    hits = F.col("pos_above") + F.col("pos")
    precision = div(hits, hits + F.col("neg_above") + F.col("neg"))
    return placed.agg(div(F.sum(precision * F.col("pos")), F.lit(pos)).alias("average_precision"))
