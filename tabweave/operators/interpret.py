"""Which features a trained model relies on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.core.numeric import div
from tabweave.core.scan import SEQ, SLOT, range_slots, tie_break
from tabweave.operators.features import LABEL, VECTOR
from tabweave.operators.modeling import TrainedModel, _prepare, _score, importances
from tabweave.operators.rows import hash_order


def model_feature_importance(spark: SparkSession, trained: TrainedModel, top_n: int = 20) -> DataFrame:
    """(feature, importance): tree importances, or sizes of coefficients (of
    the first class where there are several)."""
    model = trained.model
    if (stated := importances(model)) is not None:
        values = stated
    elif hasattr(model, "coefficientMatrix") and model.numClasses > 2:
        values = [abs(v) for v in model.coefficientMatrix.toArray()[0]]
    elif hasattr(model, "coefficients"):
        values = [abs(v) for v in model.coefficients.toArray()]
    else:
        raise ValueError(f"{trained.type} exposes no importances")
    rows = sorted(((n, float(v)) for n, v in zip(trained.features, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows[:top_n], "feature string, importance double")


def _next_values(slots: DataFrame, distances: Sequence[int]) -> DataFrame:
    """``_label, repeat, feature, x``: for each row in slots, each distance (by its number) and each
    feature (by its number), the row's values with that feature's one taken from the row so many
    places further on, the first row following the last one."""
    ahead = max(distances)
    # a few rows a slot
    heads: dict[int, list] = {}
    for r in slots.where(F.col(SEQ) < ahead).select(SLOT, SEQ, "_values").orderBy(SLOT, SEQ).collect():
        heads.setdefault(r[SLOT], []).append(r["_values"])
    order = list(heads)

    def following(slot: int) -> list:
        out, at = [], order.index(slot)
        while len(out) < ahead:
            at = (at + 1) % len(order)
            out += heads[order[at]]
        return out[:ahead]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, values, slot = np.zeros(0), None, None

        def shifted(n: int) -> Iterator[pa.RecordBatch]:
            width = values.shape[1]
            offsets = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32))
            for repeat, d in enumerate(distances):
                for k in range(width):
                    x = values[:n].copy()
                    x[:, k] = values[d:d + n, k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(label[:n]), pa.array(np.full(n, repeat, np.int32)), pa.array(np.full(n, k, np.int32)),
                         pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=[LABEL, "repeat", "feature", "x"])

        for b in batches:
            if not b.num_rows:
                continue
            slot = b.column(2)[0].as_py()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            label = np.concatenate([label, b.column(0).to_numpy(zero_copy_only=False)])
            values = x if values is None else np.concatenate([values, x])
            n = len(values) - ahead
            if n > 0:
                yield from shifted(n)
                label, values = label[n:], values[n:]
        if values is not None:
            values = np.concatenate([values, np.array(following(slot))])
            yield from shifted(len(label))

    return slots.select(LABEL, "_values", SLOT).mapInArrow(
        run, f"{LABEL} double, repeat int, feature int, x array<double>")


def permutation_importance(trained: TrainedModel, df: DataFrame, n_repeats: int = 10, top_n: int = 20,
                           key: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Mean and deviation of the score lost when one feature is shuffled.

    Rows are put into one random order.  A shuffle gives each row the value of
    the row some places further on in it, another distance for each repeat, so
    rows move once however many repeats there are.  A row is scored once per
    repeat and feature, with that feature's value exchanged, and the losses are
    aggregated.
    """
    names = trained.features
    rows = _prepare(df.withColumn("_h", hash_order(df, key, seed)), trained.target, names, trained.classes)
    values = F.transform(F.array(*[c(n).cast("double") for n in names]),
                         lambda x: F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
    tied, order = tie_break(rows.select(LABEL, values.alias("_values"), "_h"), [F.xxhash64("_h", F.lit(seed)).asc()])
    slots = range_slots(tied, order, [LABEL, "_values"])
    base = _score(trained.model, slots.select(LABEL, array_to_vector("_values").alias(VECTOR)), trained.is_classifier)
    n = slots.count()
    # fewer rows than repeats have fewer shuffles, and one row has none
    distances = [1 + r % max(1, n - 1) for r in range(n_repeats)]
    spread = _next_values(slots, distances).select(LABEL, "repeat", "feature", array_to_vector("x").alias(VECTOR))
    scored = trained.model.transform(spread)
    error = F.col(LABEL) - F.col("prediction")
    score = (F.avg((error == 0).cast("double")) if trained.is_classifier
             else 1 - div(F.avg(error * error), F.var_pop(LABEL)))
    drops = scored.groupBy("feature", "repeat").agg((F.lit(base) - score).alias("drop"))
    return drops.groupBy(F.get(F.array(*map(F.lit, names)), F.col("feature")).alias("feature")).agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")).orderBy(
            F.desc("importance_mean"), "feature").limit(top_n)
