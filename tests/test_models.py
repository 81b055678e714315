import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabweave.core.scan import range_slots
from tabweave.functions.transforms import fit_scaling
from tabweave.operators import lloyd, modeling, selection
from tabweave.operators.clustering import cluster_profile, elbow_curve, kmeans_cluster, silhouette_score
from tabweave.operators.density import connected_components, dbscan_cluster
from tabweave.operators.interpret import _next_values, model_feature_importance, permutation_importance
from tabweave.operators.modeling import (MODEL_TYPES, TrainedModel, compare_models, cross_validate, evaluate_model,
                                         grid_search, learning_curve, list_models, predict, train_model,
                                         train_test_split)
from tabweave.operators.reduction import pca_transform

FEW = {"random_forest": {"n_estimators": 5}, "random_forest_classifier": {"n_estimators": 5},
       "gradient_boosting": {"n_estimators": 3}, "gradient_boosting_classifier": {"n_estimators": 3}}


def test_split_sizes(numbers, two_classes):
    train, test = train_test_split(numbers, "target")
    assert (train.count(), test.count()) == (80, 20)
    again = train_test_split(numbers, "target")[1]
    assert sorted(test.collect()) == sorted(again.collect())
    assert train_test_split(numbers, "target", 0.3)[1].count() == 30
    train, test = train_test_split(two_classes, "target", 0.25, stratify=True)
    share = two_classes.where("target = 1").count() * 0.25
    assert test.count() == 25 and abs(test.where("target = 1").count() - share) < 1


@pytest.mark.parametrize("kind", MODEL_TYPES)
def test_every_model_learns(numbers, two_classes, kind):
    df = two_classes if MODEL_TYPES[kind][1] else numbers
    m = train_model(df, "target", kind, hyperparams=FEW.get(kind))
    assert m.train_score > 0.6
    out = predict(m, df, "guess")
    assert out.columns == [*df.columns, "guess"] and out.count() == 100
    scores = evaluate_model(m, df).first()
    assert scores["accuracy" if m.is_classifier else "r2"] == pytest.approx(m.train_score)
    if m.is_classifier:
        assert {r.guess for r in out.select("guess").distinct().collect()} == {0, 1}


def test_text_labels_and_three_classes(numbers):
    df = numbers.withColumn("band", F.expr("case when target < 190 then 'low' when target < 215 then 'mid' else 'top' end"))
    m = train_model(df.drop("target"), "band", "gradient_boosting_classifier", hyperparams={"n_estimators": 2})
    assert m.classes == ["low", "mid", "top"] and m.train_score > 0.7
    assert {r.guess for r in predict(m, df, "guess").collect()} <= {"low", "mid", "top"}
    assert evaluate_model(m, df).first().f1 > 0.7


def test_scores_missing_features_and_bad_names(two_classes, numbers):
    m = train_model(two_classes, "target", "logistic_regression", hyperparams={"C": 10.0})
    s = [r.s for r in predict(m, two_classes, "guess", "s").collect()]
    assert 0 <= min(s) < 0.2 and 0.8 < max(s) <= 1
    with pytest.raises(ValueError, match="not found"):
        predict(m, numbers.drop("x1"))
    with pytest.raises(ValueError, match="unknown parameter"):
        train_model(numbers, "target", "decision_tree", hyperparams={"leaves": 3})
    with pytest.raises(ValueError, match="model type"):
        train_model(numbers, "target", "svm")


def test_save_and_load(spark, numbers, tmp_path):
    m = train_model(numbers, "target", "linear_regression", "first")
    m.save(str(tmp_path / "m"))
    back = TrainedModel.load(spark, str(tmp_path / "m"))
    assert back.features == m.features and list_models(spark, [m, back]).select("name").distinct().count() == 1
    assert predict(back, numbers, "p").agg(F.sum("p")).first() == predict(m, numbers, "p").agg(F.sum("p")).first()


def test_validation(numbers, two_classes):
    folds = cross_validate(numbers, "target", "linear_regression", 4)
    assert folds.count() == 4 and min(r.score for r in folds.collect()) > 0.9
    ranked = compare_models(two_classes, "target", n_folds=3, hyperparams=FEW)
    assert ranked.first().model == "logistic_regression" and ranked.count() == 3
    best, table = grid_search(numbers, "target", "decision_tree", {"max_depth": [1, 4], "min_samples_leaf": [1, 5]}, 3)
    assert table.count() == 4 and "4" in table.first().params and best.model.depth > 1
    curve = learning_curve(numbers, "target", "linear_regression", 3, steps=4).orderBy("share").collect()
    assert [r.share for r in curve] == [0.25, 0.5, 0.75, 1.0] and curve[-1].train_rows == pytest.approx(200 / 3)
    assert curve[-1].validation_mean > 0.9


@pytest.fixture(scope="module")
def repeated(spark):
    """Three thousand rows over sixty different features."""
    r = np.random.default_rng(5)
    a, b = r.integers(0, 10, 3000), r.integers(0, 6, 3000)
    y = 3.0 * a - 2 * b * b + r.normal(0, 2, 3000)
    return spark.createDataFrame([(*map(float, t), int(t[2] > 4)) for t in zip(a, b, y)],
                                 "a double, b double, y double, k int").cache()


@pytest.mark.parametrize("kind", [k for k in MODEL_TYPES if "forest" not in k])
def test_equal_features_are_fitted_as_one_row(spark, repeated, kind, monkeypatch):
    target, features = ("k", ["a", "b", "k"]) if MODEL_TYPES[kind][1] else ("y", ["a", "b", "y"])
    df, fitted = repeated.select(*features), []
    fit = modeling._fit
    monkeypatch.setattr(modeling, "_fit", lambda data, *rest: fitted.append(data.count()) or fit(data, *rest))
    few = train_model(df, target, kind, hyperparams=FEW.get(kind))
    folds = [r.score for r in cross_validate(df, target, kind, 3, FEW.get(kind)).collect()]
    assert max(fitted) <= 2 * 60 * 3
    monkeypatch.setattr(modeling, "ROWS_IN_CELL", 10 ** 9)
    every = train_model(df, target, kind, hyperparams=FEW.get(kind))
    assert fitted[-1] == 3000 and few.train_score == pytest.approx(every.train_score, rel=1e-6)
    assert folds == pytest.approx([r.score for r in cross_validate(df, target, kind, 3, FEW.get(kind)).collect()], rel=1e-6)
    prediction = lambda m: [r.p for r in predict(m, df.distinct(), "p").orderBy(*features).collect()]
    assert prediction(few) == pytest.approx(prediction(every), rel=1e-6)
    assert few.train_score == pytest.approx(evaluate_model(few, df).first()["accuracy" if few.is_classifier else "r2"])


def test_forest_of_drawn_cells(spark, repeated, tmp_path, monkeypatch):
    df, params = repeated.select("a", "b", "y"), {"n_estimators": 20, "max_depth": 6}
    few = train_model(df, "y", "random_forest", hyperparams=params)
    assert len(few.model.stages) == 21
    found = {r.feature: r.importance for r in model_feature_importance(spark, few).collect()}
    monkeypatch.setattr(modeling, "DRAWS_PER_ROW", 0)
    every = train_model(df, "y", "random_forest", hyperparams=params)
    assert few.train_score == pytest.approx(every.train_score, abs=2e-3)
    assert few.train_score == pytest.approx(evaluate_model(few, df).first()["r2"])
    assert found == pytest.approx({r.feature: r.importance for r in model_feature_importance(spark, every).collect()}, abs=0.02)
    few.save(str(tmp_path / "m"))
    back = TrainedModel.load(spark, str(tmp_path / "m"))
    assert predict(back, df, "p").agg(F.avg("p")).first()[0] == pytest.approx(df.agg(F.avg("y")).first()[0], abs=0.5)


def test_feature_importance_takes_drawn_cells(spark, monkeypatch):
    grown = []
    monkeypatch.setattr(selection, "fit_forest", lambda data, params: grown.append(data.count()) or modeling.fit_forest(data, params))
    df = spark.range(5000).selectExpr("double(id % 7) as a", "double(id % 5) as b", "3.0 * (id % 7) + rand(1) as y")
    first = selection.feature_importance(df, "y", trees=6, max_depth=4).first()
    assert grown == [35] and first.feature == "a" and first.importance > 0.99


def test_rows_are_drawn_one_by_one(spark):
    data = spark.range(8000).selectExpr("id % 2 as x", "double(id % 16) as _label").select(
        array_to_vector(F.array(F.col("x").cast("double"))).alias("_features"), "_label")
    cells = modeling._drawn_cells(data, 50, 3).orderBy("_label").collect()
    assert [(r["_weight"], r["_label"], r["_spread"]) for r in cells] == [(4000, 7, 84000), (4000, 8, 84000)]
    for r in cells:
        # numbers of drawn rows vary as those of 4000 rows do, not of one row of weight 4000
        assert np.mean(r["_drawn"]) == pytest.approx(4000, abs=60) and 35 < np.std(r["_drawn"]) < 100
        assert np.sum(r["_total"]) / np.sum(r["_drawn"]) == pytest.approx(r["_label"], abs=0.1)


def test_interpretation(spark, numbers):
    forest = train_model(numbers, "target", "random_forest", hyperparams={"n_estimators": 10})
    assert model_feature_importance(spark, forest).first().feature == "x1"
    linear = train_model(numbers, "target", "linear_regression")
    drops = {r.feature: r.importance_mean for r in permutation_importance(linear, numbers, 3).collect()}
    assert drops["x1"] > drops["x2"] > 0.1 > abs(drops["x3"])


def test_permutation_moves_rows_once(spark, numbers, capsys):
    linear = train_model(numbers, "target", "linear_regression")
    shuffles = []
    for repeats in (2, 6):
        permutation_importance(linear, numbers, repeats).explain()
        shuffles.append(capsys.readouterr().out.count("Exchange"))
    assert shuffles[0] == shuffles[1]


@pytest.mark.parametrize("rows, distances", [(40, [1, 2, 3]), (4, [1, 2, 3]), (1, [1, 1])])
def test_permuted_values_are_a_cyclic_shift(spark, rows, distances):
    data = spark.range(rows).select(F.col("id").cast("double").alias("_label"), F.array("id", -F.col("id")).cast(
        "array<double>").alias("_values"))
    slots = range_slots(data, [F.col("_label").asc()])
    got = sorted(map(tuple, _next_values(slots, distances).collect()))
    value = lambda k: k % rows
    assert got == sorted((k, i, j, [value(k + d), -k] if j == 0 else [k, -value(k + d)])
                         for k in range(rows) for i, d in enumerate(distances) for j in range(2))


# --- clusters ---------------------------------------------------------------

@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.RandomState(0)
    xy = np.concatenate([r.normal(c, 0.3, (60, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], "id int, x double, y double").cache()


def test_kmeans_and_quality(blobs):
    rows, inertia = kmeans_cluster(blobs, ["x", "y"], 3, starts=3)
    sizes = rows.groupBy("cluster").count().orderBy("cluster").collect()
    assert [tuple(r) for r in sizes] == [(0, 60), (1, 60), (2, 60)] and 0 < inertia < 20
    q = silhouette_score(rows, "cluster", ["x", "y"]).first()
    pdf = rows.toPandas()
    z = ((pdf[["x", "y"]] - pdf[["x", "y"]].mean()) / pdf[["x", "y"]].std(ddof=0)).values
    d = ((z[:, None] - z[None]) ** 2).sum(-1)
    s = []
    for i in range(len(z)):
        own = pdf.cluster == pdf.cluster[i]
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][pdf.cluster == k].mean() for k in set(pdf.cluster) - {pdf.cluster[i]})
        s.append((b - a) / max(a, b))
    assert q.silhouette_sq == pytest.approx(np.mean(s)) and q.quality == "Excellent"
    assert cluster_profile(rows, "cluster", ["x"]).count() == 3
    costs = [r.inertia for r in elbow_curve(blobs, ["x", "y"], 4, starts=2).orderBy("k").collect()]
    assert costs == sorted(costs, reverse=True)


def test_kmeans_of_all_starts_is_no_worse_than_the_library(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_quantity", "l_extendedprice")
    scans = []
    monkeypatch.setattr(lloyd, "_sums", lambda *a, own=lloyd._sums: scans.append(1) or own(*a))
    rows, inertia = kmeans_cluster(lines, ["l_quantity", "l_extendedprice"], 4)
    assert len(scans) <= lloyd.MOST_STEPS + lloyd.ROUNDS + 2  # for ten starts
    scaling = fit_scaling(lines, lines.columns, "standard", fill=0.0)
    data = lines.select(array_to_vector(F.array(*[scaling.column(n, fill=0.0) for n in lines.columns])).alias("v")).cache()
    best = min(KMeans(featuresCol="v", k=4, seed=s, maxIter=50).fit(data).summary.trainingCost for s in range(5))
    assert inertia <= best * 1.001
    assert rows.count() == lines.count() and rows.select("cluster").distinct().count() == 4


def test_kmeans_adds_most_blocks_whole(spark):
    """Sums over blocks are those over points, and most points lie in blocks that are not opened."""
    x = np.random.default_rng(5).normal(size=(20_000, 2)).round(4)
    x[:3000] = x[0] + np.arange(3000)[:, None] * 1e-6  # a crowded cell
    points = spark.createDataFrame([(v.tolist(), float(1 + k % 3), k) for k, v in enumerate(x)], "x array<double>, w double, h long")
    blocks = lloyd.packed(points.repartition(2), 2).cache()
    centres = {0: np.array([[-1.0, 0.2], [0.9, 1.0], [0.5, -1.0]]), 3: np.array([[0.0, 0.0]])}
    w = 1.0 + np.arange(len(x)) % 3
    for p, got in lloyd._sums(blocks, centres).items():
        d = ((x[:, None] - centres[p]) ** 2).sum(2)
        for i, row in enumerate(got):
            own = d.argmin(1) == i
            assert row == pytest.approx([w[own].sum(), (w * d[:, i])[own].sum(), *(w[own, None] * x[own]).sum(0)])
    held = blocks.collect()
    assert sum(r.n for r in held) == len(x) and max(r.n for r in held) <= lloyd.MOST_BLOCK
    whole = lloyd._owners(*[np.array([r[k] for r in held]) for k in ("mean", "low", "high")], centres[0])[1]
    assert sum(r.n for r, inside in zip(held, whole) if inside) > 0.5 * len(x)


def test_limits_are_arguments(spark, numbers):
    many = numbers.withColumn("label", F.concat(F.lit("c"), F.floor(F.col("x3") * 7)))
    with pytest.raises(ValueError, match="more than 3"):
        train_model(many.drop("target"), "label", "decision_tree_classifier", max_classes=3)
    spread = spark.range(2400).selectExpr("id div 2 as cluster", "id div 2 * 10.0D + id % 2 as x")
    with pytest.raises(ValueError, match="more than 1000"):
        silhouette_score(spread, "cluster", ["x"])
    q = silhouette_score(spread, "cluster", ["x"], max_clusters=1200).first()
    assert q.n_clusters == 1200 and q.n_used == 2400 and q.silhouette_sq > 0.98


def test_kmeans_odd_tables(spark):
    few = spark.createDataFrame([(1.0, None), (1.0, None), (2.0, 3.0)], "x double, cluster double")
    rows, inertia = kmeans_cluster(few, ["x", "cluster"], 3, "label", starts=2)
    assert inertia == pytest.approx(0) and rows.select("label").distinct().count() == 2
    rows, inertia = kmeans_cluster(few.limit(0), ["x"], 3)
    assert inertia == 0 and rows.count() == 0
    same = spark.range(900).selectExpr("case when id % 3 = 0 then 5.0D else id * 1.0D end x")
    sizes = kmeans_cluster(same, ["x"], 2, starts=3)[0].groupBy("cluster").count().collect()
    assert sum(r["count"] for r in sizes) == 900 and len(sizes) == 2


def brute_dbscan(z, eps, m):
    near = ((z[:, None] - z[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= m
    group = np.arange(len(z))
    while True:
        new = np.array([min([group[i], *group[near[i] & core]]) if core[i] else group[i] for i in range(len(z))])
        if (new == group).all():
            return near, core, group
        group = new


@pytest.mark.parametrize("d, eps, m, shape, few", [
    (1, 0.01, 4, "line", 64), (2, 0.25, 5, "blob", 0), (2, 0.03, 3, "ring", 64), (3, 0.4, 6, "blob", 64),
    (2, 0.5, 4, "hot", 4), (2, 0.05, 1, "blob", 64)])
def test_dbscan_against_all_pairs(spark, monkeypatch, d, eps, m, shape, few):
    # how soon boxes are halved no more must not matter
    monkeypatch.setattr("tabweave.operators.density.FEW_COMPARISONS", few)
    r = np.random.RandomState(d)
    if shape == "ring":
        angle = np.linspace(0, 6.2, 300)
        x = np.stack([np.cos(angle), np.sin(angle)], 1) * np.repeat([[1], [2]], 150, 0)
    else:
        x = np.concatenate([r.normal(0, 1, (200, d)), r.normal(4, 0.2, (120, d))])
    if shape == "hot":  # a third of the rows in one spot, another third in one cell
        x = np.concatenate([x, np.zeros((160, d)), r.uniform(7, 7.01, (160, d))])
    z = (x - x.mean(0)) / x.std(0)
    names = ["x", "y", "w"][:d]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)],
                               "id int, " + ", ".join(f"{n} double" for n in names))
    got = dbscan_cluster(df, names, eps, m).toPandas().sort_values("id").cluster.values
    near, core, group = brute_dbscan(z, eps, m)
    labels = {}
    for i in np.where(core)[0]:
        assert got[i] >= 0 and labels.setdefault(group[i], got[i]) == got[i]
    assert len(set(labels.values())) == len(labels) and set(labels.values()) == set(range(len(labels)))
    for i in np.where(~core)[0]:
        assert got[i] == min([labels[group[j]] for j in np.where(near[i] & core)[0]], default=-1)


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60)
    links = spark.createDataFrame([(i, i + 1) for i in range(39)] + [(50, 49), (51, 50)], "a long, b long")
    got = {r.id: r.comp for r in connected_components(nodes, links).collect()}
    assert {got[i] for i in range(40)} == {0} and {got[i] for i in (49, 50, 51)} == {49} and got[45] == 45
    assert len(got) == 60


def test_pca(numbers):
    rows, variance = pca_transform(numbers, ["x1", "x2", "target"], 2)
    z = numbers.select("x1", "x2", "target").toPandas()
    z = ((z - z.mean()) / z.std(ddof=0)).values
    value, vector = np.linalg.eigh(np.cov(z.T))
    assert [r.variance_pct for r in variance.collect()] == pytest.approx(list(100 * value[::-1][:2] / value.sum()))
    scores = z @ vector[:, -1] * np.sign(vector[np.abs(vector[:, -1]).argmax(), -1])
    assert np.allclose(rows.toPandas().PC1, scores)


def test_model_queries_run_the_defaults(monkeypatch):
    """Registered queries train with the operators' own settings."""
    from types import SimpleNamespace

    from tabweave.plans import models
    from tabweave.plans.catalog import ENTRIES

    seen = []

    def note(*args, hyperparams=None, n_folds=None, **kwargs):
        seen.append((hyperparams, n_folds))

    for name in ("train_model", "compare_models"):
        monkeypatch.setattr(models, name, note)
    for name in ("evaluate_model", "model_feature_importance", "_lines", "_classes", "_three"):
        monkeypatch.setattr(models, name, lambda *args, **kwargs: None)
    monkeypatch.setattr(models, "list_models", lambda *args: SimpleNamespace(drop=lambda *names: None))
    monkeypatch.setattr(models, "train_test_split", lambda *args, **kwargs: (None, None))
    names = [n for n in ENTRIES if n.startswith("train_") and "split" not in n and n != "train_linear_regression"]
    for name in [*names, "compare_models", "list_models", "model_feature_importance"]:
        ENTRIES[name].build(SimpleNamespace(spark=None))
    assert len(seen) == len(names) + 4 and all(x == (None, None) for x in seen)


def test_workbooks_spread_over_tasks(spark, monkeypatch):
    """Books of a few hundred rows, so that no task builds the whole table."""
    from tabweave.plans import models
    from tabweave.plans.catalog import ENTRIES, Tables

    books = []
    monkeypatch.setattr(models, "read_workbooks", lambda files: books.append(files.count()))
    customers = Tables(spark, "/root/testdata/sf0.01")
    ENTRIES["load_excel"].build(customers)
    assert books[0] >= customers.customer.count() / 500


def test_classes_of_boosting_are_fitted_side_by_side(spark, monkeypatch):
    from tabweave.operators import modeling
    made, real = [], modeling.OneVsRest
    monkeypatch.setattr(modeling, "OneVsRest", lambda **k: made.append(real(**k)) or made[-1])
    rows = spark.createDataFrame([(float(i), "abc"[i % 9 // 3]) for i in range(90)], "x double, y string")
    modeling.train_model(rows, "y", "gradient_boosting_classifier", hyperparams={"n_estimators": 1})
    assert made[0].getParallelism() == 3
