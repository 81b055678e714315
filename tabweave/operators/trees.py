"""Boosting and regression forests grown on cells of binned features.

MLlib's trees see a feature only as one of ``MAX_BINS`` bins, so rows with equal bins (and
key, and class) are one weighted cell, with its number of rows, mean label and spread.  Where that leaves few
cells, whole ensembles are grown on them by numpy, in tasks; a forest's draws are added
up per cell and tree beside the rows.  Splits, leaves, residuals and weights are those
of MLlib's algorithms, and the result is an MLlib model.
"""

from __future__ import annotations

import json
import pickle
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators.features import LABEL, VECTOR
from tabweave.session import scratch_path

MAX_BINS = 32
# cells that a task holds; with more, and with few rows a cell, fits take rows
MOST_CELLS = 200_000
# bins of all features together, so that a cell has a number
MOST_CODES = 1 << 40
# draws are added up for so many trees and rows at once
TREES_AT_ONCE = 10
ROWS_AT_ONCE = 100_000
#: what these fits take into account; with other parameters MLlib fits
PARAMETERS = {"gradient_boosting": {"maxIter", "maxDepth", "stepSize", "seed"},
              "gradient_boosting_classifier": {"maxIter", "maxDepth", "stepSize", "seed"},
              "random_forest": {"numTrees", "maxDepth", "featureSubsetStrategy", "seed"}}
_DRAWN = pa.schema([("tree", pa.int32()), ("drawn", pa.binary()), ("total", pa.binary())])


def supports(model_type: str, params: Mapping) -> bool:
    return (model_type in PARAMETERS and set(params) <= PARAMETERS[model_type]
            and params.get("featureSubsetStrategy", "all") == "all")


@dataclass
class Tree:
    """Nodes by breadth; a leaf has no children (-1).  ``bin``: cells up to it go left."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    stats: np.ndarray  # weight, sum and sum of squares of the labels

    def predict(self, bins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            rows = rows[self.left[node[rows]] >= 0]
            if not len(rows):
                return self.value[node]
            at = node[rows]
            node[rows] = np.where(bins[rows, self.feature[at]] <= self.bin[at], self.left[at], self.right[at])


def grow(bins: np.ndarray, sizes: Sequence[int], weight: np.ndarray, total: np.ndarray, square: np.ndarray, depth: int) -> Tree:
    """A regression tree by variance on cells with weights, sums of labels and sums of squared labels."""
    here = weight > 0
    bins, weight, total, square = bins[here], weight[here], total[here], square[here]
    middle = total.sum() / max(weight.sum(), 1e-300)
    away = total - weight * middle  # squares of these stay small
    floor = 1e-12 * max(0.0, square.sum() / max(weight.sum(), 1e-300) - middle * middle)
    node, count = np.zeros(len(weight), np.int64), 1
    feature, cut, left, right, value, gain, stats = [], [], [], [], [], [], []
    first = 0  # number of the level's first node
    for level in range(depth + 1):
        w = np.bincount(node, weight, count)
        y = np.bincount(node, away, count)
        best, of, at = np.full(count, -1.0), np.full(count, -1), np.full(count, -1)
        if level < depth:
            for f, size in enumerate(sizes):
                if size < 2:
                    continue
                place = node * size + bins[:, f]
                lw = np.bincount(place, weight, count * size).reshape(count, size).cumsum(1)[:, :-1]
                ly = np.bincount(place, away, count * size).reshape(count, size).cumsum(1)[:, :-1]
                rows = np.bincount(place, minlength=count * size).reshape(count, size).cumsum(1)
                ok = (rows[:, :-1] > 0) & (rows[:, :-1] < rows[:, -1:])
                rw, ry = w[:, None] - lw, y[:, None] - ly
                found = np.where(ok, (ly * ly / np.where(ok, lw, 1) + ry * ry / np.where(ok, rw, 1) - (y * y / w)[:, None]) / w[:, None], -1.0)
                k = found.argmax(1)
                here = found[np.arange(count), k]
                better = here > best
                best[better], of[better], at[better] = here[better], f, k[better]
        split = best > floor
        children = first + count + 2 * np.cumsum(split) - 2
        feature.append(np.where(split, of, -1))
        cut.append(np.where(split, at, -1))
        left.append(np.where(split, children, -1))
        right.append(np.where(split, children + 1, -1))
        value.append(middle + y / w)
        gain.append(np.where(split, best, -1.0))
        stats.append(np.column_stack([w, y + w * middle, np.bincount(node, square, count)]))
        if not split.any():
            break
        going = split[node]
        bins, weight, away, square, node = bins[going], weight[going], away[going], square[going], node[going]
        node = (children[node] - first - count) + (bins[np.arange(len(node)), of[node]] > at[node])
        first, count = first + count, 2 * int(split.sum())
    return Tree(*map(np.concatenate, (feature, cut, left, right, value, gain, stats)))


def boost(bins: np.ndarray, sizes: Sequence[int], weight: np.ndarray, label: np.ndarray, spread: np.ndarray,
          params: Mapping, classes: bool) -> list[Tree]:
    """Gradient boosting by squared error, or by log loss of labels -1 and 1."""
    trees, score = [], np.zeros(len(weight))
    for k in range(params["maxIter"]):
        # a spread belongs to numbers only, whose residual is twice the difference
        rest, wide = (label, spread) if not k else (4 * label / (1 + np.exp(2 * label * score)), spread) if classes else (
            2 * (label - score), 4 * spread)
        trees.append(grow(bins, sizes, weight, weight * rest, weight * rest * rest + wide, params["maxDepth"]))
        score += (params["stepSize"] if k else 1.0) * trees[-1].predict(bins)
    return trees


def poisson_ones(r: np.random.Generator, shape: tuple[int, int]) -> np.ndarray:
    """Poisson's numbers around 1: 16 random bits settle nearly all, others are drawn from what the bits leave over."""
    p = np.cumprod(np.concatenate([[np.exp(-1.0)], 1 / np.arange(1.0, 20)]))
    whole = np.floor(p * 65536).astype(int)
    table = np.full(65536, 255, np.uint8)
    table[:whole.sum()] = np.repeat(np.arange(len(p)), whole)
    out = table[r.integers(0, 65536, shape, np.uint16)]
    late = out == 255
    left = p * 65536 - whole
    out[late] = r.choice(len(p), int(late.sum()), p=left / left.sum())
    return out


@dataclass
class Binned:
    """The cells of a table.  ``cuts``: the bins' upper ends by feature."""

    cuts: list[np.ndarray]
    bins: np.ndarray
    key: np.ndarray
    label: np.ndarray  # mean, or the class
    weight: np.ndarray
    spread: np.ndarray

    def count(self) -> int:
        return len(self.weight)

    @property
    def sizes(self) -> list[int]:
        return [len(x) + 1 for x in self.cuts]

    def merged(self, use: np.ndarray, classes: bool):
        """Bins, weights, labels and spreads of the cells in use, whatever their key."""
        bins, weight, label, spread = self.bins[use], self.weight[use], self.label[use], self.spread[use]
        by = np.column_stack([bins, label]) if classes else bins
        _, first, cell = np.unique(by, axis=0, return_index=True, return_inverse=True)
        cell = cell.ravel()
        n = np.bincount(cell, weight)
        mean = np.bincount(cell, weight * label) / n
        wide = np.bincount(cell, spread + weight * (label - mean[cell]) ** 2)
        return bins[first], n, (label[first] if classes else mean), wide


def _cuts(rows: DataFrame, width: int) -> tuple[list[np.ndarray], float]:
    """Of each feature the upper ends of all bins but the last: between its values, or so that bins hold equally many rows.
    And the mean label."""
    column = lambda j: F.get("_x", F.lit(j))
    shares = [k / MAX_BINS for k in range(1, MAX_BINS)]
    row = rows.agg(*[F.approx_count_distinct(column(j)) for j in range(width)],
                *[F.percentile_approx(column(j), shares, 10_000) for j in range(width)], F.avg(LABEL)).first()
    few = [j for j in range(width) if row[j] <= 2 * MAX_BINS]
    known = rows.agg(*[F.collect_set(column(j)) for j in few]).first() if few else []
    values = {j: np.sort(np.array(v, float)) for j, v in zip(few, known)}
    return [(values[j][:-1] + values[j][1:]) / 2 if j in values and len(values[j]) <= MAX_BINS
            else np.unique(np.array(row[width + j] or [], float)) for j in range(width)], row[2 * width] or 0.0


def _plain(data: DataFrame, key: str | None) -> DataFrame:
    # -0.0 is 0.0
    return data.select(F.transform(vector_to_array(VECTOR), lambda v: v + F.lit(0.0)).alias("_x"), F.col(LABEL).cast("double").alias(LABEL),
                       (F.col(key).cast("int") if key else F.lit(0)).alias("_key"))


def binned(data: DataFrame, width: int, classes: bool, rows_in_cell: int, key: str | None = None) -> Binned | None:
    """The cells of rows with so many features, a label and an integer key; None if there are too many of them."""
    rows = _plain(data, key)
    cuts, middle = _cuts(rows, width)
    sizes = [len(x) + 1 for x in cuts]
    if prod(sizes) > MOST_CODES:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y, key = b.column(1).to_numpy(), b.column(2).to_numpy()
            code = _codes(_bins(b.column(0), cuts), key, sizes)
            by = np.column_stack([code, y.astype(np.int64)]) if classes else code[:, None]
            known, cell = np.unique(by, axis=0, return_inverse=True)
            cell, away = cell.ravel(), y - middle
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                known[:, 0], known[:, -1] if classes else np.zeros(len(known), np.int64), np.bincount(cell).astype(float),
                np.bincount(cell, away), np.bincount(cell, away * away))], names=["code", "class", "n", "total", "square"])

    cells = rows.mapInArrow(run, "code long, class long, n double, total double, square double").groupBy("code", "class").agg(
        *[F.sum(x).alias(x) for x in ("n", "total", "square")]).limit(MOST_CELLS + 1).toArrow().sort_by([("code", "ascending"), ("class", "ascending")])
    code, of, weight, total, square = (x.to_numpy() for x in cells.columns)
    if not len(weight) or len(weight) > MOST_CELLS or len(weight) * rows_in_cell > weight.sum():
        return None
    bins = np.zeros((len(code), width), np.int64)
    for j in reversed(range(width)):
        code, bins[:, j] = np.divmod(code, sizes[j])
    if classes:
        return Binned(cuts, bins, code, of.astype(float), weight, np.zeros(len(weight)))
    return Binned(cuts, bins, code, middle + total / weight, weight, np.maximum(square - total * total / weight, 0.0))


def _bins(x: pa.Array, cuts: Sequence[np.ndarray]) -> np.ndarray:
    values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    return np.column_stack([np.searchsorted(c, values[:, j]) for j, c in enumerate(cuts)])


def _codes(bins: np.ndarray, key: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    code = key.astype(np.int64)
    for j, size in enumerate(sizes):
        code = code * size + bins[:, j]
    return code


def fit(spark: SparkSession, cells: Binned, rows: DataFrame, model_type: str, params: Mapping, without: Sequence[int | None],
        key: str | None = None, n_classes: int = 0) -> list[list[list[Tree]]]:
    """For each key left out (None: none is) the ensembles: one, or one for each of several classes."""
    if model_type == "random_forest":
        return [[trees] for trees in _forests(cells, rows, params, without, key)]
    chosen = [None] if model_type == "gradient_boosting" else [1.0] if n_classes <= 2 else [float(k) for k in range(n_classes)]
    held = spark.sparkContext.broadcast((cells, dict(params)))

    def one(job: tuple) -> list[Tree]:
        cells, params = held.value
        out, wanted = job
        use = np.ones(len(cells.key), bool) if out is None else cells.key != out
        bins, weight, label, spread = cells.merged(use, wanted is not None)
        if wanted is not None:
            label = np.where(label == wanted, 1.0, -1.0)
        return boost(bins, cells.sizes, weight, label, spread, params, wanted is not None)

    jobs = [(out, wanted) for out in without for wanted in chosen]
    grown = spark.sparkContext.parallelize(jobs, len(jobs)).map(one).collect()
    return [grown[i:i + len(chosen)] for i in range(0, len(grown), len(chosen))]


def _forests(cells: Binned, data: DataFrame, params: Mapping, without: Sequence[int | None], key: str | None) -> list[list[Tree]]:
    """Every row is drawn on its own for each tree, with Poisson's numbers around 1, as MLlib's forest does."""
    spark = data.sparkSession
    held = spark.sparkContext.broadcast(cells)
    trees, seed, depth = params["numTrees"], params["seed"], params["maxDepth"]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        known = _codes(cells.bins, cells.key, cells.sizes)
        order = np.argsort(known)
        place, label = [np.zeros(0, np.int64)], [np.zeros(0)]
        for b in batches:
            code = _codes(_bins(b.column(0), cells.cuts), b.column(2).to_numpy(), cells.sizes)
            place.append(order[np.searchsorted(known[order], code)].astype(np.int32))
            label.append(b.column(1).to_numpy())
        place, label = np.concatenate(place), np.concatenate(label)
        if not len(place):
            return
        at = np.argsort(place, kind="stable")
        place, label = place[at], label[at]
        r = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for t in range(0, trees, TREES_AT_ONCE):
            some = min(TREES_AT_ONCE, trees - t)
            drawn, total = np.zeros((len(known), some)), np.zeros((len(known), some))
            for i in range(0, len(place), ROWS_AT_ONCE):
                p, y = place[i:i + ROWS_AT_ONCE], label[i:i + ROWS_AT_ONCE]
                starts = np.flatnonzero(np.diff(p, prepend=-1))
                k = poisson_ones(r, (len(p), some)).astype(float)
                drawn[p[starts]] += np.add.reduceat(k, starts, axis=0)
                total[p[starts]] += np.add.reduceat(k * y[:, None], starts, axis=0)
            for j in range(some):
                yield pa.RecordBatch.from_arrays([pa.array([t + j], pa.int32()), pa.array([drawn[:, j].astype(np.float32).tobytes()]),
                                                  pa.array([total[:, j].tobytes()])], schema=_DRAWN)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sums = held.value, {}
        for b in batches:
            for t, drawn, total in zip(*(x.to_pylist() for x in b.columns)):
                had = sums.setdefault(t, [0.0, 0.0])
                had[0] = had[0] + np.frombuffer(drawn, np.float32).astype(float)
                had[1] = had[1] + np.frombuffer(total)
        for t, (drawn, total) in sums.items():
            for i, out in enumerate(without):
                use = (drawn > 0) & (True if out is None else cells.key != out)
                # the spread inside a cell is taken as that of its rows
                square = total[use] ** 2 / drawn[use] + cells.spread[use] * drawn[use] / cells.weight[use]
                # cells that differ in their key alone are one
                code = _codes(cells.bins[use], np.zeros(int(use.sum())), cells.sizes)
                _, first, same = np.unique(code, return_index=True, return_inverse=True)
                tree = grow(cells.bins[use][first], cells.sizes, *(np.bincount(same, v) for v in (drawn[use], total[use], square)), depth)
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([i], pa.int32()), pa.array([pickle.dumps(tree)])],
                                                 names=["tree", "model", "grown"])

    drawn = _plain(data, key).mapInArrow(draw, "tree int, drawn binary, total binary")
    grown = drawn.repartition(trees, "tree").mapInArrow(plant, "tree int, model int, grown binary").toArrow().to_pylist()
    out: list[list[Tree]] = [[] for _ in without]
    for r in sorted(grown, key=lambda r: r["tree"]):
        out[r["model"]].append(pickle.loads(r["grown"]))
    return out


def predict(ensembles: list[list[Tree]], bins: np.ndarray, model_type: str, step: float) -> np.ndarray:
    """The prediction for each cell: a number, or the place of a class."""
    different, cell = np.unique(bins, axis=0, return_inverse=True)
    if model_type == "random_forest":
        scores = [np.mean([t.predict(different) for t in trees], axis=0) for trees in ensembles]
    else:
        scores = [sum((step if k else 1.0) * t.predict(different) for k, t in enumerate(trees)) for trees in ensembles]
    if model_type != "gradient_boosting_classifier":
        return scores[0][cell.ravel()]
    found = (scores[0] > 0).astype(float) if len(scores) == 1 else np.argmax(scores, axis=0).astype(float)
    return found[cell.ravel()]


def score(cells: Binned, use: np.ndarray, predicted: np.ndarray, classes: bool) -> float | None:
    """Accuracy or R squared of the cells in use."""
    w, y = cells.weight[use], cells.label[use]
    if not len(w):
        return None
    if classes:
        return float((w * (y == predicted)).sum() / w.sum())
    mean = (w * y).sum() / w.sum()
    whole = (w * (y - mean) ** 2 + cells.spread[use]).sum()
    return None if whole <= 0 else float(1 - (w * (y - predicted) ** 2 + cells.spread[use]).sum() / whole)


_KINDS = {"random_forest": ("regression.RandomForestRegressionModel", RandomForestRegressionModel),
          "gradient_boosting": ("regression.GBTRegressionModel", GBTRegressionModel),
          "gradient_boosting_classifier": ("classification.GBTClassificationModel", GBTClassificationModel)}


def to_model(spark: SparkSession, ensembles: list[list[Tree]], cuts: list[np.ndarray], model_type: str, params: Mapping) -> Model:
    """The MLlib model with these trees: written in MLlib's format and loaded."""
    if model_type == "random_forest":
        grown = _load(spark, ensembles[0], cuts, model_type, params).trees
        total = " + ".join(f"_tree{t}" for t in range(len(grown)))
        return PipelineModel([*[t.setPredictionCol(f"_tree{k}") for k, t in enumerate(grown)], SQLTransformer(
            statement=f"SELECT *, ({total}) / {len(grown)} AS prediction FROM __THIS__")])
    if len(ensembles) == 1:
        return _load(spark, ensembles[0], cuts, model_type, params)
    # the sums of each class's trees, of which the largest wins: MLlib's one-against-the-rest scores a row many times
    sums = [_load(spark, trees, cuts, "gradient_boosting", params).setPredictionCol(f"_class{k}") for k, trees in enumerate(ensembles)]
    every = f"array({', '.join(f'_class{k}' for k in range(len(sums)))})"
    return PipelineModel([*sums, SQLTransformer(
        statement=f"SELECT *, CAST(array_position({every}, array_max({every})) - 1 AS DOUBLE) AS prediction FROM __THIS__")])


def _load(spark: SparkSession, trees: list[Tree], cuts: list[np.ndarray], model_type: str, params: Mapping) -> Model:
    path, (kind, loader) = scratch_path(spark, "trees"), _KINDS[model_type]
    step = params.get("stepSize", 1.0)

    def facts(name: str, number: int, own: Mapping, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                           "uid": f"{name.split('.')[1]}_{path[-12:]}_{number}", "paramMap": {"featuresCol": VECTOR, "labelCol": LABEL, **own},
                           "defaultParamMap": {"predictionCol": "prediction", "impurity": "variance"}, **more})

    def nodes(k: int, t: Tree) -> pa.Table:
        w, y, square = t.stats.T
        n, inner = len(w), t.feature >= 0
        ends = np.zeros(n)
        ends[inner] = [cuts[f][b] for f, b in zip(t.feature[inner], t.bin[inner])]
        lists = lambda values, edges: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values))
        whole = lambda v: pa.array(v, pa.int32())
        split = pa.StructArray.from_arrays([whole(t.feature), lists(ends[inner], np.append(0, np.cumsum(inner))), whole(np.full(n, -1))],
                                           ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
        data = pa.StructArray.from_arrays(
            [whole(np.arange(n)), pa.array(t.value), pa.array(np.maximum(square / w - (y / w) ** 2, 0.0)),
             lists(t.stats.ravel(), np.arange(0, 3 * n + 1, 3)), pa.array(w.astype(np.int64)), pa.array(t.gain), whole(t.left),
             whole(t.right), split],
            ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
        return pa.table({"treeID": whole(np.full(n, k)), "nodeData": data})

    spark.createDataFrame(pa.concat_tables([nodes(k, t) for k, t in enumerate(trees)])).write.parquet(f"{path}/data")
    own = {"maxDepth": params["maxDepth"], "seed": params["seed"]}
    tree = lambda k: facts("regression.DecisionTreeRegressionModel", k, own)
    spark.createDataFrame([(k, tree(k), step if k and model_type != "random_forest" else 1.0) for k in range(len(trees))],
                          "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = facts(kind, len(trees), {k: v for k, v in params.items()}, numFeatures=len(cuts), numTrees=len(trees))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return loader.load(path)
