"""Train, predict, score, validate and tune MLlib models."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone
from itertools import product
from math import ceil
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.core.checks import as_list, c, is_numeric, require_choice, require_columns, require_numeric
from tabweave.core.numeric import div
from tabweave.core.scan import row_numbers
from tabweave.operators import trees
from tabweave.operators.features import LABEL, VECTOR, feature_columns, with_features
from tabweave.operators.metrics import classification_metrics, regression_metrics
from tabweave.operators.relational import distinct_values
from tabweave.operators.rows import hash_order, split_by_hash

# model type -> (estimator, is a classifier)
MODEL_TYPES = {
    "linear_regression": (LinearRegression, False),
    "logistic_regression": (LogisticRegression, True),
    "random_forest": (RandomForestRegressor, False),
    "random_forest_classifier": (RandomForestClassifier, True),
    "gradient_boosting": (GBTRegressor, False),
    "gradient_boosting_classifier": (GBTClassifier, True),
    "decision_tree": (DecisionTreeRegressor, False),
    "decision_tree_classifier": (DecisionTreeClassifier, True),
}
# Spark's depth limit is 30; unlimited depth is not offered.
DEFAULTS = {
    "linear_regression": {"regParam": 0.0},
    "logistic_regression": {"standardization": False, "maxIter": 100},
    "random_forest": {"numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "all", "seed": 42},
    "random_forest_classifier": {"numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "sqrt", "seed": 42},
    "gradient_boosting": {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": 42},
    "gradient_boosting_classifier": {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": 42},
    "decision_tree": {"maxDepth": 10, "seed": 42},
    "decision_tree_classifier": {"maxDepth": 10, "seed": 42},
}
COMMON_NAMES = {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "random_state": "seed",
                "max_iter": "maxIter", "fit_intercept": "fitIntercept", "learning_rate": "stepSize",
                "subsample": "subsamplingRate"}
MAX_CLASSES = 100
AUTO_CLASSES = 20
WEIGHT = "_weight"
SPREAD = "_spread"
# rows of a cell, on average, from which a fit takes cells
ROWS_IN_CELL = 4
# most draws for the trees of a forest that are kept for each row
DRAWS_PER_ROW = 8
# rows whose draws a task holds at once
HELD_DRAWS = 10_000
TREES_AT_ONCE = 8
CLASSES_AT_ONCE = 8
CELLS_IN_TASK = 50_000
FORESTS = ("random_forest", "random_forest_classifier")


def train_test_split(df: DataFrame, target_column: str, test_size: float = 0.2, random_state: int = 42,
                     stratify: bool = False, key: Sequence[str] | None = None,
                     max_classes: int = MAX_CLASSES) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ceil(rows x test_size) test rows, the same
    for the same seed; stratify keeps the shares of at most ``max_classes``
    classes (largest remainders)."""
    require_columns(df, [target_column])
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    if not stratify:
        n = df.count()
        test, train = split_by_hash(df, {None: ceil(n * test_size)}, None, key, random_state)
        return train, test
    counts = {r["k"]: r["count"] for r in df.groupBy(c(target_column).cast("string").alias("k")).count().limit(
        max_classes + 1).collect()}
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    quota = {k: int(n * test_size) for k, n in counts.items()}
    left = ceil(sum(counts.values()) * test_size) - sum(quota.values())
    by_remainder = sorted(counts, key=lambda k: (-(counts[k] * test_size - quota[k]), str(k)))
    for k in by_remainder[:left]:
        quota[k] += 1
    test, train = split_by_hash(df, quota, target_column, key, random_state)
    return train, test


@dataclass(frozen=True)
class TrainedModel:
    name: str
    type: str
    features: list[str]
    target: str
    model: Model = field(repr=False)
    classes: list | None
    train_score: float | None
    trained_at: str

    @property
    def is_classifier(self) -> bool:
        return MODEL_TYPES[self.type][1]

    def save(self, path: str) -> None:
        """The MLlib model and one row of facts, below ``path``."""
        self.model.write().save(f"{path}/model")
        facts = json.dumps({"name": self.name, "type": self.type, "features": self.features, "target": self.target,
                            "classes": self.classes, "train_score": self.train_score, "trained_at": self.trained_at})
        SparkSession.getActiveSession().createDataFrame([(facts,)], "value string").coalesce(1).write.text(
            f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TrainedModel":
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        return TrainedModel(model=DefaultParamsReader.loadParamsInstance(f"{path}/model", spark.sparkContext), **facts)


def _params(model_type: str, hyperparams: Mapping | None, rows: int) -> dict:
    estimator = MODEL_TYPES[model_type][0]
    out = dict(DEFAULTS[model_type])
    if model_type == "logistic_regression":
        out["regParam"] = 1.0 / rows
    for k, v in (hyperparams or {}).items():
        if k == "C" and model_type == "logistic_regression":
            out["regParam"] = 1.0 / (v * rows)
            continue
        if k == "n_estimators":
            k = "maxIter" if model_type.startswith("gradient") else "numTrees"
        k = COMMON_NAMES.get(k, k)
        if not hasattr(estimator, k):
            raise ValueError(f"unknown parameter '{k}' for {model_type}")
        out[k] = v
    return out


def _classes(df: DataFrame, target: str, most: int) -> list:
    return distinct_values(df, target, most)


def _prepare(df: DataFrame, target: str, features: Sequence[str], classes: list | None) -> DataFrame:
    """Vector and label columns only; a class label becomes its position."""
    if classes is None:
        require_numeric(df, [target])
        label = c(target).cast("double")
    else:
        table = F.create_map(*[F.lit(x) for i, v in enumerate(classes) for x in (str(v), float(i))])
        label = F.try_element_at(table, c(target).cast("string"))
    return with_features(df, features).withColumn(LABEL, label).where(F.col(LABEL).isNotNull())


def _takes_cells(model_type: str, hyperparams: Mapping | None) -> bool:
    """Whether rows with equal features can stand for each other with a weight: a forest draws single
    rows, and limits on the rows of a node, or drawn shares of them, count rows."""
    params = _params(model_type, hyperparams, 1)
    return (model_type not in FORESTS and params.get("minInstancesPerNode", 1) <= 1
            and params.get("subsamplingRate", 1.0) >= 1)


def _cells(data: DataFrame, classifier: bool, wanted: bool, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with equal features (and keys, and class) as one row with their number as ``_weight``, the mean
    label, and the sum of squared differences from it as ``_spread``.

    Squared error and log-likelihood depend on these alone, so a fit and its score stay as they are.  Where
    most rows differ, and where cells are not wanted, each row is a cell.
    """
    alone = data.select(VECTOR, LABEL, *keys, F.lit(1.0).alias(WEIGHT), F.lit(0.0).alias(SPREAD))
    if not wanted:
        return alone
    by = [*keys, *([LABEL] if classifier else [])]
    rows = data.select(vector_to_array(VECTOR).alias("_x"), LABEL, *keys)
    n, different = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("_x", *by))).first()
    if different * ROWS_IN_CELL > n:
        return alone
    number = F.count(F.lit(1)).cast("double")
    spread = F.lit(0.0) if classifier else F.var_pop(LABEL) * number
    cells = rows.groupBy("_x", *by).agg(number.alias(WEIGHT), spread.alias(SPREAD),
                                        *([] if classifier else [F.avg(LABEL).alias("_mean")]))
    label = F.col(LABEL) if classifier else F.col("_mean").alias(LABEL)
    return cells.select(array_to_vector("_x").alias(VECTOR), label, *keys, WEIGHT, SPREAD)


def _drawn_cells(data: DataFrame, trees: int, seed: int, keys: Sequence[str] = ()) -> DataFrame | None:
    """Cells of a regression with the rows drawn for each tree of a forest: ``_drawn`` holds their number and
    ``_total`` the sum of their labels.  None where the draws would take more room than the rows.

    Every row is drawn on its own for each tree, with Poisson's numbers around 1, as Spark's forest does.
    """
    rows = data.select(vector_to_array(VECTOR).alias("_x"), F.col(LABEL).cast("double").alias(LABEL), *[
        F.col(k).cast("double").alias(k) for k in keys])
    n, different = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("_x", *keys))).first()
    if different * trees > DRAWS_PER_ROW * n:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        r = np.random.default_rng([seed, task.partitionId()])
        # rows, mean and spread of each cell, and per tree its drawn rows and the sum of their labels
        places: dict[bytes, int] = {}
        facts, drawn, total = np.zeros((64, 3)), np.zeros((64, trees)), np.zeros((64, trees))
        width = 0
        for b in batches:
            for at in range(0, b.num_rows, HELD_DRAWS):
                part = b.slice(at, HELD_DRAWS)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                width = x.shape[1]
                y = part.column(1).to_numpy(zero_copy_only=False)
                whole = np.column_stack([x, *[part.column(2 + j).to_numpy(zero_copy_only=False) for j in range(len(keys))]]) + 0.0
                cells, cell = np.unique(whole, axis=0, return_inverse=True)
                order = cell.ravel().argsort(kind="stable")
                starts = np.searchsorted(cell.ravel()[order], np.arange(len(cells)))
                y = y[order]
                k = r.poisson(1.0, (len(y), trees)).astype(float)
                place = np.array([places.setdefault(c_.tobytes(), len(places)) for c_ in cells])
                while len(places) > len(facts):
                    facts, drawn, total = (np.concatenate([a, np.zeros_like(a)]) for a in (facts, drawn, total))
                size = np.diff(np.append(starts, len(y)))
                mean = np.add.reduceat(y, starts) / size
                spread = np.add.reduceat((y - np.repeat(mean, size)) ** 2, starts)
                before, had, spread_had = facts[place].T
                both = before + size
                facts[place] = np.column_stack([both, had + (mean - had) * size / both,
                                                spread_had + spread + (mean - had) ** 2 * before * size / both])
                drawn[place] += np.add.reduceat(k, starts, axis=0)
                total[place] += np.add.reduceat(k * y[:, None], starts, axis=0)
        every = list(places)
        for at in range(0, len(every), HELD_DRAWS):
            to = min(at + HELD_DRAWS, len(every))
            found = np.array([np.frombuffer(v) for v in every[at:to]])
            lists = lambda a: pa.ListArray.from_arrays(
                pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(a).ravel()))
            yield pa.RecordBatch.from_arrays(
                [lists(found[:, :width]), *[pa.array(np.ascontiguousarray(found[:, width + j])) for j in range(len(keys))],
                 *[pa.array(np.ascontiguousarray(facts[at:to, j])) for j in range(3)], lists(drawn[at:to]), lists(total[at:to])],
                names=["_x", *keys, WEIGHT, LABEL, SPREAD, "_drawn", "_total"])

    cells = rows.repartition("_x", *keys).mapInArrow(run, ", ".join([
        "_x array<double>", *[f"{k} double" for k in keys], f"{WEIGHT} double", f"{LABEL} double", f"{SPREAD} double",
        "_drawn array<double>", "_total array<double>"]))
    return cells.select(array_to_vector("_x").alias(VECTOR), LABEL, *keys, WEIGHT, SPREAD, "_drawn", "_total")


def fit_forest(data: DataFrame, params: Mapping) -> PipelineModel:
    """A regression forest from drawn cells: each tree is Spark's, on the rows drawn for it."""
    shared = {k: v for k, v in params.items() if k not in ("numTrees", "seed")}
    # trees are grown side by side, so each takes few tasks
    tasks = ceil(max(1, data.count()) / CELLS_IN_TASK)

    def one(t: int) -> Model:
        drawn = F.get("_drawn", F.lit(t))
        rows = data.select(VECTOR, drawn.alias(WEIGHT), (F.get("_total", F.lit(t)) / drawn).alias(LABEL)).where(
            F.col(WEIGHT) > 0).coalesce(tasks)
        return RandomForestRegressor(featuresCol=VECTOR, labelCol=LABEL, weightCol=WEIGHT, numTrees=1, bootstrap=False,
                                     predictionCol=f"_tree{t}", seed=params["seed"] + t, **shared).fit(rows)

    with ThreadPool(TREES_AT_ONCE) as pool:
        trees = pool.map(inheritable_thread_target(one), range(params["numTrees"]))
    total = " + ".join(f"_tree{t}" for t in range(len(trees)))
    return PipelineModel([*trees, SQLTransformer(statement=f"SELECT *, ({total}) / {len(trees)} AS prediction FROM __THIS__")])


def importances(model: Model) -> list[float] | None:
    """Of the features, as a tree or forest states them; a forest's are the mean of its trees' ones."""
    if isinstance(model, PipelineModel):
        if isinstance(model.stages[0], GBTRegressionModel):
            return None  # one ensemble for each of several classes
        found = np.sum([t.featureImportances.toArray() for t in model.stages[:-1]], axis=0)
        return (found / (found.sum() or 1.0)).tolist()
    return model.featureImportances.toArray().tolist() if hasattr(model, "featureImportances") else None


def _fit_cells(data: DataFrame, model_type: str, hyperparams: Mapping | None, classifier: bool,
               keys: Sequence[str] = ()) -> DataFrame:
    """What a fit of the model type takes: cells, drawn cells of a forest, or rows."""
    params = _params(model_type, hyperparams, 1)
    plain = params.get("minInstancesPerNode", 1) <= 1 and params.get("subsamplingRate", 1.0) >= 1
    if model_type == "random_forest" and plain and params.get("bootstrap", True):
        drawn = _drawn_cells(data, params["numTrees"], params["seed"], keys)
        if drawn is not None:
            return drawn
    return _cells(data, classifier, _takes_cells(model_type, hyperparams), keys)


def _number(data: DataFrame) -> int:
    """Rows that the cells stand for."""
    return int(data.agg(F.coalesce(F.sum(WEIGHT), F.lit(0.0))).first()[0])


def _fit(data: DataFrame | trees.Binned, model_type: str, hyperparams: Mapping | None, n_classes: int,
         rows: int | DataFrame) -> Model | list[list[trees.Tree]]:
    """The model of rows or cells with the number of rows, or the ensembles on binned cells of the rows."""
    if isinstance(data, trees.Binned):
        return trees.fit(rows.sparkSession, data, rows, model_type, _params(model_type, hyperparams, 1), [None], None, n_classes)[0]
    if "_drawn" in data.columns:
        return fit_forest(data, _params(model_type, hyperparams, rows))
    estimator = MODEL_TYPES[model_type][0](featuresCol=VECTOR, labelCol=LABEL, weightCol=WEIGHT,
                                           **_params(model_type, hyperparams, rows))
    if model_type == "gradient_boosting_classifier" and n_classes > 2:
        # the rounds of one class are many short jobs, which leave room for those of the others
        estimator = OneVsRest(classifier=estimator, featuresCol=VECTOR, labelCol=LABEL, weightCol=WEIGHT,
                              parallelism=min(n_classes, CLASSES_AT_ONCE))
    return estimator.fit(data)


def _middle(data: DataFrame) -> float:
    """Some middle label, from which squares are taken, so that they stay small."""
    return data.agg(F.coalesce(F.avg(LABEL), F.lit(0.0))).first()[0]


def _score(model: Model, data: DataFrame, classifier: bool, middle: float | None = None) -> float | None:
    """Accuracy or R squared of cells (or of rows without a weight), as one aggregate."""
    known = data if WEIGHT in data.columns else data.withColumns({WEIGHT: F.lit(1.0), SPREAD: F.lit(0.0)})
    scored = model.transform(known).select(LABEL, "prediction", WEIGHT, SPREAD)
    w = F.col(WEIGHT)
    if classifier:
        return scored.agg(div(F.sum(w * (F.col(LABEL) == F.col("prediction")).cast("double")), F.sum(w))).first()[0]
    middle = _middle(known) if middle is None else middle
    away, error = F.col(LABEL) - F.lit(middle), F.col(LABEL) - F.col("prediction")
    n, total, square, missed = scored.agg(
        F.sum(w), F.sum(w * away), F.sum(w * away * away + F.col(SPREAD)), F.sum(w * error * error + F.col(SPREAD))).first()
    if not n or square - total * total / n <= 0:
        return None
    return 1 - missed / (square - total * total / n)


@contextmanager
def _kept(data: DataFrame):
    """Cache for the iterations of a fit, and let go afterwards."""
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield data
    finally:
        data.unpersist()


def _binned(rows: DataFrame, features: Sequence[str], model_type: str, hyperparams: Mapping | None, classes: list | None,
            key: str | None = None) -> trees.Binned | None:
    """The cells of binned features on which trees are grown; None where a fit takes other cells or rows."""
    if not trees.supports(model_type, _params(model_type, hyperparams, 1)) or (classes is not None and len(classes) < 2):
        return None
    return trees.binned(rows, len(features), classes is not None, ROWS_IN_CELL, key)


def _binned_scores(cells: trees.Binned, folds: DataFrame, model_type: str, hyperparams: Mapping | None, n_folds: int,
                   n_classes: int) -> list[float]:
    """Of each held-out fold, as ``_fold_scores``."""
    params, out = _params(model_type, hyperparams, 1), []
    grown = trees.fit(folds.sparkSession, cells, folds, model_type, params, range(n_folds), "_fold", n_classes)
    for fold, ensembles in enumerate(grown):
        use = cells.key == fold
        predicted = trees.predict(ensembles, cells.bins[use], model_type, params.get("stepSize", 1.0))
        out.append(trees.score(cells, use, predicted, MODEL_TYPES[model_type][1]))
    return out


def train_model(df: DataFrame, target_column: str, model_type: str = "random_forest", model_name: str = "",
                hyperparams: Mapping | None = None, max_classes: int = MAX_CLASSES) -> TrainedModel:
    """Fit on all numeric columns besides the target; more than ``max_classes`` classes are an error."""
    require_choice(model_type, MODEL_TYPES, "model type")
    features = feature_columns(df, target_column)
    classifier = MODEL_TYPES[model_type][1]
    classes = _classes(df, target_column, max_classes) if classifier else None
    rows = _prepare(df, target_column, features, classes)
    name = model_name or f"{model_type}_{target_column}"
    params, cells = _params(model_type, hyperparams, 1), _binned(rows, features, model_type, hyperparams, classes)
    if cells is not None:
        grown = _fit(cells, model_type, hyperparams, len(classes or []), rows)
        whole = np.ones(len(cells.weight), bool)
        score = trees.score(cells, whole, trees.predict(grown, cells.bins, model_type, params.get("stepSize", 1.0)), classifier)
        model = trees.to_model(df.sparkSession, grown, cells.cuts, model_type, params)
        return TrainedModel(name, model_type, features, target_column, model, classes, score, datetime.now(timezone.utc).isoformat())
    with _kept(_fit_cells(rows, model_type, hyperparams, classifier)) as data:
        model = _fit(data, model_type, hyperparams, len(classes or []), max(1, _number(data)))
        score = _score(model, data, classifier)
    return TrainedModel(name, model_type, features, target_column, model,
                        classes, score, datetime.now(timezone.utc).isoformat())


def predict(trained: TrainedModel, df: DataFrame, prediction_column: str = "prediction",
            score_column: str = "") -> DataFrame:
    """Add the prediction, and for classifiers on request the probability of
    the second class."""
    require_columns(df, trained.features)
    out = trained.model.transform(with_features(df, trained.features).drop("prediction"))
    value = F.col("prediction")
    if trained.classes is not None:
        value = F.get(F.array(*map(F.lit, trained.classes)), value.cast("int"))
    extra = []
    if score_column:
        if "probability" not in out.columns:
            raise ValueError(f"{trained.type} gives no class probabilities")
        extra = [vector_to_array("probability")[1].alias(score_column)]
    kept = [n for n in df.columns if n not in (prediction_column, score_column)]
    if "prediction" in kept:
        raise ValueError("the table already has a column 'prediction'; give another prediction_column")
    return out.select(*map(c, kept), value.alias(prediction_column), *extra)


def _predict_alike(trained: TrainedModel, df: DataFrame, prediction_column: str) -> DataFrame:
    """As ``predict``, but where many rows have the same features an ensemble reads them once."""
    if trained.type not in trees.PARAMETERS:
        return predict(trained, df, prediction_column)
    names = [f"_x{j}" for j in range(len(trained.features))]
    values = [F.nanvl(F.coalesce(c(n).cast("double"), F.lit(0.0)), F.lit(0.0)) for n in trained.features]
    n, different = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*values))).first()
    if different * ROWS_IN_CELL > n:
        return predict(trained, df, prediction_column)
    once = df.select(*[v.alias(f) for v, f in zip(values, trained.features)]).distinct()
    known = predict(trained, once, prediction_column).toDF(*names, prediction_column)
    if different <= trees.MOST_CELLS:
        known = F.broadcast(known)
    rows = df.drop(prediction_column).withColumns(dict(zip(names, values)))
    return rows.join(known, names).drop(*names)


def evaluate_model(trained: TrainedModel, df: DataFrame, target_column: str = "", positive="1") -> DataFrame:
    """MAE, MSE, RMSE, R2 of a regression; accuracy, precision, recall, F1 of
    a classification."""
    target = target_column or trained.target
    require_columns(df, [target])
    scored = _predict_alike(trained, df, "_predicted")
    if trained.is_classifier:
        return classification_metrics(scored, target, "_predicted", positive)
    return regression_metrics(scored, target, "_predicted")


def list_models(spark: SparkSession, models: Sequence[TrainedModel]) -> DataFrame:
    rows = [(m.name, m.type, len(m.features), m.target, m.train_score, m.trained_at) for m in models]
    return spark.createDataFrame(rows, "name string, type string, n_features int, target string, train_score double, "
                                       "trained_at string")


def _with_folds(df: DataFrame, target: str, features: Sequence[str], classes: list | None, n_folds: int,
                key: Sequence[str] | None, seed: int) -> DataFrame:
    """Folds of equal size, by class where there are classes: rows in hash
    order are dealt out in turn, copies of a row like others."""
    rows = df.where(c(target).isNotNull())
    order = [*([c(target).asc()] if classes is not None else []), hash_order(df, key, seed).asc()]
    numbered = row_numbers(rows, order, "_i")
    return _prepare(numbered.select(*map(c, features), c(target), "_i"), target, features, classes).select(
        VECTOR, LABEL, F.pmod("_i", F.lit(n_folds)).cast("int").alias("_fold"), "_i")


def _fold_scores(data: DataFrame, model_type: str, hyperparams: Mapping | None, n_folds: int, n_classes: int,
                 parallelism: int) -> list[float]:
    classifier = MODEL_TYPES[model_type][1]
    middle = None if classifier else _middle(data)

    def one(fold: int) -> float:
        train = data.where(F.col("_fold") != fold)
        model = _fit(train, model_type, hyperparams, n_classes, max(1, _number(train)))
        return _score(model, data.where(F.col("_fold") == fold), classifier, middle)

    with ThreadPool(min(parallelism, n_folds)) as pool:
        return pool.map(inheritable_thread_target(one), range(n_folds))


def cross_validate(df: DataFrame, target_column: str, model_type: str = "random_forest", n_folds: int = 5,
                   hyperparams: Mapping | None = None, key: Sequence[str] | None = None, seed: int = 42,
                   parallelism: int = 4, max_classes: int = MAX_CLASSES) -> DataFrame:
    """(fold, score): R squared or accuracy of each held-out fold; folds of a
    classifier are stratified."""
    require_choice(model_type, MODEL_TYPES, "model type")
    features = feature_columns(df, target_column)
    classes = _classes(df, target_column, max_classes) if MODEL_TYPES[model_type][1] else None
    folds = _with_folds(df, target_column, features, classes, n_folds, key, seed)
    cells = _binned(folds, features, model_type, hyperparams, classes, "_fold")
    if cells is not None:
        scores = _binned_scores(cells, folds, model_type, hyperparams, n_folds, len(classes or []))
    else:
        with _kept(_fit_cells(folds, model_type, hyperparams, classes is not None, ["_fold"])) as data:
            scores = _fold_scores(data, model_type, hyperparams, n_folds, len(classes or []), parallelism)
    return df.sparkSession.createDataFrame(list(enumerate(scores, start=1)), "fold int, score double")


def score_summary(folds: DataFrame) -> DataFrame:
    """Mean, population deviation, least and largest score."""
    return folds.agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"),
                     F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def compare_models(df: DataFrame, target_column: str, model_types: Sequence[str] | None = None, n_folds: int = 5,
                   hyperparams: Mapping[str, Mapping] | None = None, key: Sequence[str] | None = None,
                   seed: int = 42, parallelism: int = 4, auto_classes: int = AUTO_CLASSES,
                   max_classes: int = MAX_CLASSES) -> DataFrame:
    """Model types ranked by their mean score over the same folds.

    Without ``model_types`` a numeric target of at most ``auto_classes``
    distinct values is taken for classes.
    """
    features = feature_columns(df, target_column)
    few = df.select(c(target_column)).dropna().distinct().limit(auto_classes + 1).count() <= auto_classes
    classification = not is_numeric(df, target_column) or few
    types = as_list(model_types) or (
        ["logistic_regression", "random_forest_classifier", "gradient_boosting_classifier"] if classification
        else ["linear_regression", "random_forest", "gradient_boosting"])
    for t in types:
        require_choice(t, MODEL_TYPES, "model type")
    rows = []
    for wants_classes in (False, True):
        chosen = [t for t in types if MODEL_TYPES[t][1] == wants_classes]
        if not chosen:
            continue
        classes = _classes(df, target_column, max_classes) if wants_classes else None
        folds = _with_folds(df, target_column, features, classes, n_folds, key, seed)
        # types that grow on binned cells share them
        growing = [t for t in chosen if trees.supports(t, _params(t, (hyperparams or {}).get(t), 1))]
        cells = _binned(folds, features, growing[0], (hyperparams or {}).get(growing[0]), classes, "_fold") if growing else None
        if cells is not None:
            for t in growing:
                s = _binned_scores(cells, folds, t, (hyperparams or {}).get(t), n_folds, len(classes or []))
                rows.append((t, fmean(s), pstdev(s), min(s), max(s)))
            chosen = [t for t in chosen if t not in growing]
        taking = [t for t in chosen if _takes_cells(t, (hyperparams or {}).get(t))]
        # types that take cells share them
        for wanted, alike in [(True, taking), *[(False, [t]) for t in chosen if t not in taking]]:
            if not alike:
                continue
            kept = (_cells(folds, wants_classes, True, ["_fold"]) if wanted
                    else _fit_cells(folds, alike[0], (hyperparams or {}).get(alike[0]), wants_classes, ["_fold"]))
            with _kept(kept) as data:
                for t in alike:
                    s = _fold_scores(data, t, (hyperparams or {}).get(t), n_folds, len(classes or []), parallelism)
                    rows.append((t, fmean(s), pstdev(s), min(s), max(s)))
    rows.sort(key=lambda r: -r[1])
    ranked = [(i, *r) for i, r in enumerate(rows, start=1)]
    return df.sparkSession.createDataFrame(
        ranked, "rank int, model string, mean_score double, std_score double, min_score double, max_score double")


def grid_search(df: DataFrame, target_column: str, model_type: str, param_grid: Mapping[str, Sequence],
                n_folds: int = 5, model_name: str = "", key: Sequence[str] | None = None, seed: int = 42,
                parallelism: int = 4, max_classes: int = MAX_CLASSES) -> tuple[TrainedModel, DataFrame]:
    """(best model refitted on all rows, table of all combinations by rank)."""
    require_choice(model_type, MODEL_TYPES, "model type")
    features = feature_columns(df, target_column)
    classes = _classes(df, target_column, max_classes) if MODEL_TYPES[model_type][1] else None
    combos = [dict(zip(param_grid, values)) for values in product(*param_grid.values())]
    for combo in combos:
        _params(model_type, combo, 1)
    folds = _with_folds(df, target_column, features, classes, n_folds, key, seed)
    wanted = all(_takes_cells(model_type, combo) for combo in combos)
    with _kept(_cells(folds, classes is not None, wanted, ["_fold"])) as data:
        tried = []
        for combo in combos:
            s = _fold_scores(data, model_type, combo, n_folds, len(classes or []), parallelism)
            tried.append((combo, fmean(s), pstdev(s)))
        tried.sort(key=lambda t: -t[1])
        model = _fit(data, model_type, tried[0][0], len(classes or []), max(1, _number(data)))
    best = TrainedModel(model_name or f"grid_{model_type}_{target_column}", model_type, features, target_column, model,
                        classes, tried[0][1], datetime.now(timezone.utc).isoformat())
    table = [(i, json.dumps(p, sort_keys=True), m, s) for i, (p, m, s) in enumerate(tried, start=1)]
    return best, df.sparkSession.createDataFrame(table, "rank int, params string, mean_score double, std_score double")


def learning_curve(df: DataFrame, target_column: str, model_type: str = "random_forest", n_splits: int = 5,
                   hyperparams: Mapping | None = None, steps: int = 10, key: Sequence[str] | None = None,
                   seed: int = 42, parallelism: int = 4, max_classes: int = MAX_CLASSES) -> DataFrame:
    """Train and validation scores for growing, nested shares of the training rows."""
    require_choice(model_type, MODEL_TYPES, "model type")
    features = feature_columns(df, target_column)
    classifier = MODEL_TYPES[model_type][1]
    classes = _classes(df, target_column, max_classes) if classifier else None
    # a second hash, so that the share does not depend on the fold
    part = F.floor(F.pmod(F.xxhash64("_i", F.lit(seed)), F.lit(100 * steps)) / 100).cast("int")
    folds = _with_folds(df, target_column, features, classes, n_splits, key, seed).withColumn("_part", part)
    with _kept(_fit_cells(folds, model_type, hyperparams, classifier, ["_fold", "_part"])) as data:
        middle = None if classifier else _middle(data)

        def one(job: tuple[int, int]) -> tuple[int, float, float, int]:
            step, fold = job
            train = data.where((F.col("_fold") != fold) & (F.col("_part") < step))
            n = _number(train)
            if n < 2 or (classifier and train.select(LABEL).distinct().count() < 2):
                return step, None, None, n
            model = _fit(train, model_type, hyperparams, len(classes or []), n)
            return step, _score(model, train, classifier, middle), _score(
                model, data.where(F.col("_fold") == fold), classifier, middle), n

        jobs = [(s, f) for s in range(1, steps + 1) for f in range(n_splits)]
        with ThreadPool(parallelism) as pool:
            rows = pool.map(inheritable_thread_target(one), jobs)
    scores = df.sparkSession.createDataFrame(
        [(s / steps, n, a, b) for s, a, b, n in rows], "share double, n long, train double, validation double")
    return scores.groupBy("share").agg(
        F.avg("n").alias("train_rows"), F.avg("train").alias("train_mean"), F.stddev_pop("train").alias("train_std"),
        F.avg("validation").alias("validation_mean"), F.stddev_pop("validation").alias("validation_std"))
