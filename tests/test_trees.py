"""Trees grown on cells of binned features against MLlib's own fits on rows."""

import numpy as np
import pandas as pd
import pytest

from tabweave.operators import modeling, trees


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    n = 1500
    a, b = r.integers(0, 9, n), r.integers(0, 7, n)
    mark = np.where(a + r.integers(0, 5, n) > 7, "u", np.where(b + r.integers(0, 6, n) > 6, "v", "w"))
    frame = pd.DataFrame({"a": a * 1.0, "b": b, "y": a * b + r.random(n) * 3, "mark": mark})
    frame.loc[::50, "b"] = 0
    return spark.createDataFrame(frame).repartition(3).cache()


@pytest.mark.parametrize(("kind", "target"), [("gradient_boosting", "y"), ("gradient_boosting_classifier", "mark")])
def test_boosting_equals_mllib(table, monkeypatch, kind, target):
    rows = table.select("a", "b", target)
    own = modeling.train_model(rows, target, kind, hyperparams={"maxIter": 5})
    monkeypatch.setattr(trees, "supports", lambda *a: False)
    plain = modeling.train_model(rows, target, kind, hyperparams={"maxIter": 5})
    assert own.train_score == pytest.approx(plain.train_score)
    one, other = (modeling.predict(m, rows, "p").toPandas()["p"] for m in (own, plain))
    assert one.tolist() == (other.tolist() if target == "mark" else pytest.approx(other.tolist()))


def test_no_row_reaches_an_mllib_fit(spark, table, monkeypatch, tmp_path):
    """All folds of all models are grown on the cells, however many rows there are."""
    def refuse(*a, **k):
        raise AssertionError("rows are fitted")

    for kind in ("random_forest", "gradient_boosting", "gradient_boosting_classifier"):
        monkeypatch.setitem(modeling.MODEL_TYPES, kind, (refuse, modeling.MODEL_TYPES[kind][1]))
    monkeypatch.setattr(modeling, "_params", lambda t, h, n: {**modeling.DEFAULTS[t], **(h or {})})
    few = {"random_forest": {"numTrees": 5}, "gradient_boosting": {"maxIter": 5}}
    got = {r.model: r.mean_score for r in modeling.compare_models(
        table.select("a", "b", "y"), "y", ["random_forest", "gradient_boosting"], n_folds=2, hyperparams=few).collect()}
    assert got["random_forest"] > 0.9 and got["gradient_boosting"] > 0.5
    made = modeling.train_model(table.select("a", "b", "y"), "y", "random_forest", hyperparams={"numTrees": 5})
    made.save(str(tmp_path / "m"))
    again = modeling.TrainedModel.load(spark, str(tmp_path / "m"))
    scores = [modeling.evaluate_model(m, table.select("a", "b", "y")).first().r2 for m in (made, again)]
    assert scores[0] == scores[1] == pytest.approx(made.train_score) and scores[0] > 0.9
    assert sum(modeling.importances(made.model)) == pytest.approx(1)


def test_every_row_is_drawn_by_poisson():
    drawn = trees.poisson_ones(np.random.default_rng(1), (200_000, 5))
    assert drawn.mean() == pytest.approx(1, abs=0.005) and drawn.var() == pytest.approx(1, abs=0.01)
    share = np.bincount(drawn.ravel(), minlength=4)[:4] / drawn.size
    assert share == pytest.approx([0.36788, 0.36788, 0.18394, 0.06131], abs=0.002)


def test_a_leaf_for_cells_that_do_not_differ():
    one = np.zeros((3, 2), np.int64)
    t = trees.grow(one, [1, 1], np.ones(3), np.array([2.0, 4, 6]), np.array([4.0, 16, 36]), 3)
    assert t.value.tolist() == [4.0] and t.left.tolist() == [-1]


def test_equal_rows_are_scored_once(table, monkeypatch):
    """An ensemble's predictions for rows with equal features are made once, and nulls count as 0."""
    rows = table.selectExpr("a", "nullif(b, 0) as b", "y")
    made = modeling.train_model(rows, "y", "gradient_boosting", hyperparams={"maxIter": 3})
    seen, plain = [], modeling.predict
    monkeypatch.setattr(modeling, "predict", lambda m, df, *a: seen.append(df.count()) or plain(m, df, *a))
    got = modeling.evaluate_model(made, rows).first()
    assert seen == [63] and got.r2 == pytest.approx(made.train_score)
