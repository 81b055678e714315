"""Checked queries: splits, models, validation, interpretation, clusters,
components, workbooks.  Trained models have no SQL; counts, closed forms and
labels that do not depend on a solver have."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tabweave.functions.transforms import fit_scaling
from tabweave.operators.clustering import (cluster_profile, cluster_sizes, elbow_curve, kmeans_cluster,
                                           silhouette_score)
from tabweave.operators.density import dbscan_cluster
from tabweave.operators.interpret import model_feature_importance, permutation_importance
from tabweave.operators.modeling import (compare_models, cross_validate, evaluate_model, grid_search, learning_curve,
                                         list_models, predict, score_summary, train_model, train_test_split)
from tabweave.operators.reduction import pca_transform
from tabweave.operators.silhouette import silhouette_euclidean
from tabweave.plans.catalog import query, rounded
from tabweave.plans.workbook_writer import workbook_bytes
from tabweave.sources.workbooks import read_workbooks

# rows of one derived workbook: few, so that books spread over tasks with the table
WORKBOOK_ROWS = 500


@query("load_excel", """
    SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal,
           CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def _(t):
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    rows = t.customer.withColumn("c_mktsegment", F.expr("if(c_custkey % 5 = 0, null, c_mktsegment)"))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lines = [[v.item() if hasattr(v, "item") else v for v in line] for line in pdf[names].itertuples(index=False)]
        return pd.DataFrame({"path": [f"customer-{key[0]}.xlsx"], "content": [workbook_bytes(names, lines)]})

    files = rows.withColumn("book", F.expr(f"c_custkey div {WORKBOOK_ROWS}")).groupBy("book").applyInPandas(
        build, "path string, content binary")
    return read_workbooks(files)


@query("load_excel_headers", """
    SELECT o_orderkey AS key, date_trunc('second', o_orderdate) AS "when", o_orderstatus AS "Unnamed: 2",
           CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price, o_totalprice > 1000 AS "price.1",
           o_orderkey::VARCHAR AS price_text FROM orders""")
def _(t):
    # a date, a column without a header, a header twice, booleans, and numbers that are text
    rows = t.orders.select("o_orderkey", F.date_trunc("second", "o_orderdate").alias("o_orderdate"), "o_orderstatus",
                           F.expr("if(o_orderkey % 4 = 0, null, o_totalprice)").alias("price"),
                           (F.col("o_totalprice") > 1000).alias("large"), F.col("o_orderkey").cast("string").alias("text"))
    names = rows.columns

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        value = lambda v: v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v
        lines = [[value(v) for v in line] for line in pdf[names].itertuples(index=False)]
        header = ["key", "when", None, "price", "price", "price_text"]
        return pd.DataFrame({"path": [f"orders-{key[0]}.xlsx"], "content": [workbook_bytes(header, lines, share_strings=True)]})

    files = rows.withColumn("book", F.expr(f"o_orderkey div {4 * WORKBOOK_ROWS}")).groupBy("book").applyInPandas(
        build, "path string, content binary")
    return read_workbooks(files)


# --- splits -----------------------------------------------------------------

@query("train_test_split", """
    SELECT 'test' AS part, ceil(count(*) * 0.2)::BIGINT AS n FROM lineitem UNION ALL
    SELECT 'train', (count(*) - ceil(count(*) * 0.2))::BIGINT FROM lineitem""")
def _(t):
    train, test = train_test_split(t.lineitem, "l_extendedprice")
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(train, "train").unionByName(count(test, "test"))


@query("train_test_split_stratified", """
    WITH c AS (SELECT event_type, count(*) AS n, count(*) * 0.25 AS q FROM events GROUP BY 1),
         k AS (SELECT event_type, n, floor(q) AS whole, row_number() OVER (ORDER BY q - floor(q) DESC, event_type) AS r,
                      ceil(sum(n) OVER () * 0.25) - sum(floor(q)) OVER () AS extra FROM c)
    SELECT event_type, (whole + (r <= extra)::INTEGER)::BIGINT AS n_test, (n - whole - (r <= extra)::INTEGER)::BIGINT
           AS n_train FROM k""")
def _(t):
    train, test = train_test_split(t.events, "event_type", 0.25, stratify=True, key=["event_id"])
    marked = train.select("event_type", F.lit(0).alias("t")).unionByName(test.select("event_type", F.lit(1).alias("t")))
    return marked.groupBy("event_type").agg(F.count_if(F.col("t") == 1).alias("n_test"),
                                            F.count_if(F.col("t") == 0).alias("n_train"))


# --- models -----------------------------------------------------------------

def _lines(t):
    return t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice")


def _counts(t):
    """All documents with a few counts as features."""
    return t.documents.select("doc_id", "n_chars", F.length("text").alias("length"),
                              F.size(F.split("text", r"\s+")).alias("words"),
                              F.length(F.regexp_replace("text", r"[^0-9]", "")).alias("digits"))


def _classes(t):
    """The labelled documents with their quality label."""
    return _counts(t).join(t.labels.select("doc_id", "quality"), "doc_id").drop("doc_id")


def _three(t):
    return t.lineitem.select("l_quantity", "l_discount", "l_extendedprice", "l_returnflag")


@query("train_linear_regression", """
    SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
           round(regr_r2(l_extendedprice, l_quantity), 8) AS train_r2 FROM lineitem""")
def _(t):
    m = train_model(t.lineitem.select("l_quantity", "l_extendedprice"), "l_extendedprice", "linear_regression")
    row = [(float(m.model.coefficients[0]), float(m.model.intercept), m.train_score)]
    out = t.spark.createDataFrame(row, "slope double, intercept double, train_r2 double")
    return rounded(rounded(rounded(out, 4, ["slope"]), 2, ["intercept"]), 8, ["train_r2"])


for _type in ("random_forest", "gradient_boosting", "decision_tree"):
    @query(f"train_{_type}")
    def _(t, kind=_type):
        train, test = train_test_split(_lines(t), "l_extendedprice")
        return evaluate_model(train_model(train, "l_extendedprice", kind), test)


for _type in ("logistic_regression", "random_forest_classifier", "gradient_boosting_classifier",
              "decision_tree_classifier"):
    @query(f"train_{_type}")
    def _(t, kind=_type):
        train, test = train_test_split(_classes(t), "quality", stratify=True)
        return evaluate_model(train_model(train, "quality", kind), test)


@query("train_gradient_boosting_multiclass")
def _(t):
    m = train_model(_three(t), "l_returnflag", "gradient_boosting_classifier")
    return evaluate_model(m, _three(t))


@query("predict", """
    SELECT l_orderkey, l_linenumber, round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem)
           + l_quantity * (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem), 3) AS price FROM lineitem""")
def _(t):
    m = train_model(t.lineitem.select("l_quantity", "l_extendedprice"), "l_extendedprice", "linear_regression")
    return rounded(predict(m, t.lineitem, "price").select("l_orderkey", "l_linenumber", "price"), 3)


@query("predict_class_scores")
def _(t):
    m = train_model(_classes(t), "quality", "logistic_regression")
    return predict(m, _counts(t), "called", "score")


@query("list_models", """
    SELECT 'linear_regression_l_extendedprice' AS name, 'linear_regression' AS type, 4::INTEGER AS n_features,
           'l_extendedprice' AS target UNION ALL
    SELECT 'decision_tree_l_extendedprice', 'decision_tree', 4, 'l_extendedprice'""")
def _(t):
    models = [train_model(_lines(t), "l_extendedprice", "linear_regression"),
              train_model(_lines(t), "l_extendedprice", "decision_tree")]
    return list_models(t.spark, models).drop("trained_at", "train_score")


@query("cross_validate")
def _(t):
    return score_summary(cross_validate(_lines(t), "l_extendedprice", "linear_regression"))


@query("cross_validate_classifier")
def _(t):
    return cross_validate(_three(t), "l_returnflag", "decision_tree_classifier")


@query("compare_models")
def _(t):
    return compare_models(_lines(t), "l_extendedprice")


@query("grid_search")
def _(t):
    _, table = grid_search(_lines(t), "l_extendedprice", "decision_tree", {"max_depth": [2, 4]})
    return table


@query("model_feature_importance")
def _(t):
    m = train_model(_lines(t), "l_extendedprice", "random_forest")
    return model_feature_importance(t.spark, m)


@query("learning_curve")
def _(t):
    return learning_curve(_lines(t), "l_extendedprice", "linear_regression")


@query("permutation_importance")
def _(t):
    m = train_model(_lines(t), "l_extendedprice", "linear_regression")
    return permutation_importance(m, _lines(t))


# --- clusters and components ------------------------------------------------

@query("kmeans_cluster")
def _(t):
    rows, _ = kmeans_cluster(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 4)
    return rows


@query("kmeans_sizes")
def _(t):
    rows, _ = kmeans_cluster(t.lineitem.select("l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return cluster_sizes(rows, "cluster")


@query("kmeans_settled", """
    SELECT count(*) AS n_rows, 5::BIGINT AS n_clusters, true AS at_nearest_mean, true AS inertia_adds_up,
           true AS below_one_cluster FROM orders WHERE o_totalprice IS NOT NULL""")
def _(t):
    # what holds for any settled clustering: every row lies by the nearest of the clusters' means
    day = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double")
    data = t.orders.select("o_totalprice", day.alias("day"))
    scaling = fit_scaling(data, ["o_totalprice", "day"], "standard", fill=0.0)
    rows, inertia = kmeans_cluster(data, ["o_totalprice", "day"], 5)
    points = rows.select("cluster", *[scaling.column(n, fill=0.0).alias(n) for n in ("o_totalprice", "day")])
    means = points.groupBy("cluster").agg(F.avg("o_totalprice").alias("a"), F.avg("day").alias("b"))
    held = points.crossJoin(F.broadcast(means.agg(F.collect_list(F.struct("cluster", "a", "b")).alias("means"))))
    distances = held.select("cluster", F.expr("""transform(means, k -> struct((o_totalprice - k.a) * (o_totalprice - k.a)
                                                 + (day - k.b) * (day - k.b) as d, k.cluster as cluster))""").alias("ds"))
    own = F.expr("filter(ds, k -> k.cluster = cluster_)[0].d")
    checked = distances.withColumnRenamed("cluster", "cluster_").select("cluster_", own.alias("own"),
                                                                        F.array_min("ds")["d"].alias("least"))
    return checked.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cluster_").alias("n_clusters"),
                       (F.max(F.sqrt("own") - F.sqrt("least")) < 1e-2).alias("at_nearest_mean"),
                       (F.abs(F.sum("own") / inertia - 1) < 1e-3).alias("inertia_adds_up"),
                       (F.lit(inertia) < F.lit(2.0) * F.count(F.lit(1))).alias("below_one_cluster"))


@query("elbow_curve")
def _(t):
    return elbow_curve(t.part, ["p_size", "p_retailprice"])


@query("dbscan_cluster")
def _(t):
    return dbscan_cluster(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"],
                          eps=0.05, min_samples=10)


@query("dbscan_events", """
    WITH RECURSIVE s AS (SELECT event_id, value, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS x FROM events),
         g AS (SELECT x, count(*) AS w FROM s GROUP BY x),
         d AS (SELECT x, sum(w) OVER (ORDER BY x RANGE BETWEEN 0.002 PRECEDING AND 0.002 FOLLOWING) AS near FROM g),
         core AS (SELECT x FROM d WHERE near >= 8),
         starts AS (SELECT x, coalesce(x - lag(x) OVER (ORDER BY x) > 0.002, false) AS cut FROM core),
         labelled AS (SELECT x, sum(cut::INTEGER) OVER (ORDER BY x) AS label FROM starts)
    SELECT event_id, coalesce((SELECT min(label) FROM labelled l WHERE l.x BETWEEN s.x - 0.002 AND s.x + 0.002), -1)
           ::INTEGER AS cluster FROM s""")
def _(t):
    return dbscan_cluster(t.events.select("event_id", "value"), ["value"], eps=0.002, min_samples=8).drop("value")


@query("cluster_profile", """
    SELECT p_brand, count(*) AS size, round(avg(p_size), 4) AS p_size_mean, round(median(p_size), 4) AS p_size_median,
           round(avg(p_retailprice), 4) AS p_retailprice_mean, round(median(p_retailprice), 4) AS p_retailprice_median
    FROM part GROUP BY 1""")
def _(t):
    return cluster_profile(t.part, "p_brand", ["p_size", "p_retailprice"])


@query("silhouette_score", """
    WITH s AS (SELECT l_returnflag AS g, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x,
                      (l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER () AS y FROM lineitem),
         c AS (SELECT g AS k, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, avg(x * x + y * y) AS sq
               FROM s GROUP BY 1),
         p AS (SELECT g, x, y, count(*)::DOUBLE AS w FROM s GROUP BY ALL),
         d AS (SELECT g, x, y, w, k, n, greatest(x * x + y * y + sq - 2 * (x * mx + y * my), 0) AS d FROM p, c),
         m AS (SELECT w, max(CASE WHEN g = k THEN d * n / (n - 1) END) AS a, min(CASE WHEN g <> k THEN d END) AS b
               FROM d GROUP BY g, x, y, w),
         v AS (SELECT sum(w * (b - a) / greatest(a, b)) / sum(w) AS v, sum(w) AS n FROM m)
    SELECT round(v, 7) AS silhouette_sq, (SELECT count(*) FROM c) AS n_clusters, n::BIGINT AS n_used, 'Poor' AS quality
    FROM v""")
def _(t):
    return rounded(silhouette_score(t.lineitem, "l_returnflag", ["l_quantity", "l_discount"]), 7)


@query("silhouette_euclidean", """
    WITH s AS (SELECT c_custkey AS id, c_mktsegment AS g,
                      (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x,
                      (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS y FROM customer),
         d AS (SELECT a.id, a.g, b.g AS k, sum(sqrt((a.x - b.x)^2 + (a.y - b.y)^2)) AS d, count(*) AS n
               FROM s a, s b GROUP BY ALL),
         m AS (SELECT id, max(CASE WHEN g = k AND n > 1 THEN d / (n - 1) END) AS a,
                      min(CASE WHEN g <> k THEN d / n END) AS b FROM d GROUP BY id),
         v AS (SELECT avg(coalesce((b - a) / greatest(a, b), 0)) AS v, count(*) AS n FROM m)
    SELECT TRUE AS close, (SELECT count(DISTINCT g) FROM s) AS n_clusters, n AS n_used,
           CASE WHEN v >= 0.7 THEN 'Excellent' WHEN v >= 0.5 THEN 'Good' WHEN v >= 0.25 THEN 'Fair' ELSE 'Poor' END AS quality
    FROM v""")
def _(t):
    # the score has a stated error, so no fixed number of digits
    found = silhouette_euclidean(t.customer, "c_mktsegment", ["c_acctbal", "c_nationkey"])
    return found.select((F.col("error") <= 0.02).alias("close"), "n_clusters", "n_used", "quality")


@query("pca_transform")
def _(t):
    rows, _ = pca_transform(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
                            ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rows


@query("pca_two_columns", """
    WITH z AS (SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a,
                      (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b
               FROM lineitem), r AS (SELECT sign(corr(l_quantity, l_extendedprice)) AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(abs(a + s * b) / sqrt(2), 5) AS "PC1", round(abs(a - s * b) / sqrt(2), 5) AS "PC2"
    FROM z, r""")
def _(t):
    rows, _ = pca_transform(t.lineitem, ["l_quantity", "l_extendedprice"])
    # two equally large loadings leave the sign open
    return rounded(rows.select("l_orderkey", "l_linenumber", F.abs("PC1").alias("PC1"), F.abs("PC2").alias("PC2")), 5)


@query("pca_variance", """
    WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
    SELECT 'PC1' AS component, round(50 * (1 + r), 6) AS variance_pct, round(50 * (1 + r), 6) AS cumulative_pct FROM r
    UNION ALL SELECT 'PC2', round(50 * (1 - r), 6), 100 FROM r""")
def _(t):
    _, variance = pca_transform(t.lineitem, ["l_quantity", "l_extendedprice"])
    return rounded(variance, 6)
