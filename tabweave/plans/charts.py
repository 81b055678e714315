"""Checked queries: chart tables, and scores of given predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.operators.charts import (bar_counts, box_stats, cumulative, cumulative_marks, density_curve,
                                       distribution_comparison, heatmap, histogram, line_series, pair_bins, qq_line,
                                       qq_points, scatter_bins, stacked_bar, violin_stats)
from tabweave.operators.metrics import (average_precision, classification_metrics, confusion_matrix,
                                        precision_recall_curve, regression_metrics, residual_bins, residual_histogram,
                                        residuals, roc_auc, roc_curve)
from tabweave.plans.catalog import normal_quantile_sql, query, rounded


def _histogram_sql(table: str, x: str, bins: int) -> str:
    return f"""
    WITH h AS ({table}), e AS (SELECT min({x}) AS lo, (max({x}) - min({x})) / {bins} AS w FROM h),
         b AS (SELECT least(floor(({x} - lo) / w), {bins - 1})::INTEGER AS bin FROM h, e WHERE {x} IS NOT NULL),
         c AS (SELECT bin, count(*) AS n FROM b GROUP BY 1)
    SELECT i::INTEGER AS bin, round(lo + i * w, 4) AS "left", round(lo + (i + 1) * w, 4) AS "right",
           coalesce(n, 0) AS "count" FROM range({bins}) r(i) CROSS JOIN e LEFT JOIN c ON c.bin = i"""


@query("histogram", _histogram_sql("SELECT value FROM events", "value", 30))
def _(t):
    return rounded(histogram(t.events, "value"))


@query("bar_counts", """
    SELECT o_custkey AS value, count(*) AS "count" FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    return bar_counts(t.orders, "o_custkey")


@query("scatter_bins", """
    WITH e AS (SELECT min(l_quantity) AS ax, (max(l_quantity) - min(l_quantity)) / 50 AS wx,
                      min(l_extendedprice) AS ay, (max(l_extendedprice) - min(l_extendedprice)) / 50 AS wy FROM lineitem)
    SELECT least(floor((l_quantity - ax) / wx), 49)::INTEGER AS x_bin,
           least(floor((l_extendedprice - ay) / wy), 49)::INTEGER AS y_bin, l_returnflag, count(*) AS "count"
    FROM lineitem, e GROUP BY ALL""")
def _(t):
    return scatter_bins(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


def _box_sql(table: str, x: str, by: str = "") -> str:
    key, join = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    group = f"GROUP BY {by}" if by else ""
    return f"""
    WITH q AS (SELECT {key} count({x}) AS n, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median,
                      quantile_cont({x}, 0.75) AS q3 FROM {table} {group}),
         r AS (SELECT *, {x} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM {table} JOIN q {join})
    SELECT {key} any_value(n) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median,
           round(any_value(q3), 4) AS q3, round(min({x}) FILTER (inside), 4) AS whisker_low,
           round(max({x}) FILTER (inside), 4) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers
    FROM r {group}"""


@query("box_stats", _box_sql("events", "value"))
def _(t):
    return rounded(box_stats(t.events, "value"))


@query("box_stats_by_group", _box_sql("events", "value", "event_type"))
def _(t):
    return rounded(box_stats(t.events, "value", "event_type"))


@query("pair_bins", """
    WITH h AS (SELECT l_quantity AS q, l_discount AS d, l_linestatus AS hue FROM lineitem WHERE l_linenumber IS NOT NULL),
         e AS (SELECT min(q) AS aq, (max(q) - min(q)) / 20 AS wq, min(d) AS ad, (max(d) - min(d)) / 20 AS wd FROM h),
         b AS (SELECT least(floor((q - aq) / wq), 19)::INTEGER AS bq, least(floor((d - ad) / wd), 19)::INTEGER AS bd, hue
               FROM h, e)
    SELECT 'l_quantity' AS x, 'l_quantity' AS y, bq AS x_bin, NULL::INTEGER AS y_bin, hue, count(*) AS "count"
    FROM b GROUP BY ALL UNION ALL
    SELECT 'l_discount', 'l_discount', bd, NULL, hue, count(*) FROM b GROUP BY ALL UNION ALL
    SELECT 'l_quantity', 'l_discount', bq, bd, hue, count(*) FROM b GROUP BY ALL""")
def _(t):
    return pair_bins(t.lineitem, ["l_quantity", "l_discount"], "l_linestatus")


@query("line_series", """
    SELECT l_quantity, l_returnflag, 'l_extendedprice' AS y, count(*) AS n, round(avg(l_extendedprice), 3) AS mean,
           round(avg(l_extendedprice) - 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 3) AS low,
           round(avg(l_extendedprice) + 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 3) AS high
    FROM lineitem GROUP BY 1, 2""")
def _(t):
    return rounded(line_series(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag"), 3, ["mean", "low", "high"])


def _density_sql(table: str, x: str, by: str, points: int = 200) -> str:
    return f"""
    WITH f AS (SELECT {by}, count(*) AS n, stddev_samp({x}) * count(*) ** -0.2 AS h, min({x}) AS lo, max({x}) AS hi
               FROM {table} GROUP BY 1),
         g AS (SELECT *, i::INTEGER AS point, lo - 3 * h + i * (hi - lo + 6 * h) / {points - 1} AS x
               FROM f, range({points}) r(i)),
         w AS (SELECT {by}, {x} AS v, count(*) AS m FROM {table} GROUP BY 1, 2)
    SELECT {by}, point, round(any_value(x), 3) AS x,
           round(sum(m * exp(-0.5 * ((x - v) / h) ** 2)) / any_value(n * h / (hi - lo)) * 0.3989422804014327, 4) AS density
    FROM g JOIN w USING ({by}) GROUP BY 1, 2"""


def _scaled_density(df, by):
    """Density times the group's range, so that rounding keeps its digits."""
    return df.withColumn("density", F.round(F.col("density") * F.col("_range"), 4)).withColumn(
        "x", F.round("x", 3)).select(by, "point", "x", "density")


@query("violin_stats", _density_sql("events", "value", "event_type"))
def _(t):
    _, curve = violin_stats(t.events, "value", "event_type")
    spread = t.events.groupBy("event_type").agg((F.max("value") - F.min("value")).alias("_range"))
    return _scaled_density(curve.join(spread, "event_type"), "event_type")


@query("distribution_comparison", _density_sql(
    "(SELECT * FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1 "
    "ORDER BY count(*) DESC, 1 LIMIT 3))", "o_totalprice", "o_orderpriority"))
def _(t):
    curve = distribution_comparison(t.orders, "o_totalprice", "o_orderpriority", 3)
    spread = t.orders.groupBy("o_orderpriority").agg((F.max("o_totalprice") - F.min("o_totalprice")).alias("_range"))
    return _scaled_density(curve.join(spread, "o_orderpriority"), "o_orderpriority")


@query("density_curve")
def _(t):
    return density_curve(t.lineitem, "l_extendedprice")


@query("qq_points", """
    WITH n AS (SELECT count(*) AS n FROM orders),
         k AS (SELECT DISTINCT (round_even(i * (n - 1) / 199.0, 0) + 1)::BIGINT AS position FROM range(200) r(i), n),
         o AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) AS position FROM orders)
    SELECT position, o_totalprice AS sample FROM k JOIN o USING (position)""")
def _(t):
    return rounded(qq_points(t.orders, "o_totalprice").drop("theoretical"), 6)


@query("qq_line", f"""
    WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice)::DOUBLE AS i,
                      (SELECT count(*) FROM orders)::DOUBLE AS n FROM orders),
         p AS (SELECT v, CASE WHEN i = n THEN pow(0.5, 1 / n) WHEN i = 1 THEN 1 - pow(0.5, 1 / n)
                         ELSE (i - 0.3175) / (n + 0.365) END AS p FROM o),
         m AS {normal_quantile_sql('p')}
    SELECT round(regr_slope(v, m), 3) AS slope, round(regr_intercept(v, m), 3) AS intercept,
           round(sqrt(regr_r2(v, m)), 8) AS r FROM m""")
def _(t):
    return rounded(rounded(qq_line(t.orders, "o_totalprice"), 3, ["slope", "intercept"]), 8, ["r"])


@query("stacked_bar", """
    SELECT l_linenumber, round(count(*) FILTER (l_returnflag = 'A') * 100.0 / count(*), 4) AS "A",
           round(count(*) FILTER (l_returnflag = 'N') * 100.0 / count(*), 4) AS "N",
           round(count(*) FILTER (l_returnflag = 'R') * 100.0 / count(*), 4) AS "R"
    FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4""")
def _(t):
    return rounded(stacked_bar(t.lineitem, "l_linenumber", "l_returnflag", top_n=4))


@query("stacked_bar_counts", """
    SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS "N",
           count(*) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10""")
def _(t):
    return stacked_bar(t.lineitem, "l_linenumber", "l_returnflag", normalize=False)


@query("heatmap", """
    SELECT l_suppkey, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS "A",
           round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS "N",
           round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS "R"
    FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(heatmap(t.lineitem, "l_suppkey", "l_returnflag", "l_quantity", "sum"), 2)


@query("cumulative", """
    SELECT value, round(sum(n) OVER (ORDER BY value) * 100.0 / sum(n) OVER (), 6) AS cumulative_pct
    FROM (SELECT l_extendedprice AS value, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)""")
def _(t):
    return rounded(cumulative(t.lineitem, "l_extendedprice"), 6, ["cumulative_pct"])


@query("cumulative_marks", " UNION ALL ".join(
    f"SELECT {m}::INTEGER AS pct, round(quantile_cont(value, {m / 100}), 4) AS value FROM events" for m in (25, 50, 75, 90)))
def _(t):
    return rounded(cumulative_marks(t.events, "value"))


# --- scores of given predictions --------------------------------------------

_GUESS = """(SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity * 1500 + l_discount * 20000 AS p
    FROM lineitem)"""


def _guess(t):
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_extendedprice as y",
                                 "l_quantity * 1500 + l_discount * 20000 as p")


@query("evaluate_regression", f"""
    SELECT round(avg(abs(y - p)), 3) AS mae, round(avg((y - p) ** 2), 0) AS mse, round(sqrt(avg((y - p) ** 2)), 3) AS rmse,
           round(1 - avg((y - p) ** 2) / var_pop(y), 7) AS r2 FROM {_GUESS}""")
def _(t):
    out = regression_metrics(_guess(t), "y", "p")
    return rounded(rounded(rounded(out, 3, ["mae", "rmse"]), 0, ["mse"]), 7, ["r2"])


@query("residuals", f"SELECT l_orderkey, l_linenumber, round(y - p, 4) AS residual FROM {_GUESS}")
def _(t):
    return rounded(residuals(_guess(t), "y", "p").drop("y", "p"))


@query("residual_histogram", _histogram_sql(f"SELECT y - p AS e FROM {_GUESS}", "e", 50))
def _(t):
    return rounded(residual_histogram(_guess(t), "y", "p"))


@query("residual_bins", f"""
    WITH h AS (SELECT p AS x, y - p AS e FROM {_GUESS}),
         r AS (SELECT min(x) AS ax, (max(x) - min(x)) / 50 AS wx, min(e) AS ay, (max(e) - min(e)) / 50 AS wy FROM h)
    SELECT least(floor((x - ax) / wx), 49)::INTEGER AS x_bin, least(floor((e - ay) / wy), 49)::INTEGER AS y_bin,
           count(*) AS "count" FROM h, r GROUP BY ALL""")
def _(t):
    return residual_bins(_guess(t), "y", "p")


_CALLS = """(SELECT (l_returnflag = 'R')::INTEGER AS y, (l_quantity > 25)::INTEGER AS p,
    l_extendedprice AS s FROM lineitem)"""


def _calls(t):
    return t.lineitem.selectExpr("int(l_returnflag = 'R') as y", "int(l_quantity > 25) as p", "l_extendedprice as s")


@query("evaluate_binary", f"""
    WITH c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = p) AS hit,
                      count(*) FILTER (p = 1) AS called, count(*) FILTER (y = 1) AS support FROM {_CALLS})
    SELECT round(hit / n, 6) AS accuracy, round(tp / called, 6) AS precision, round(tp / support, 6) AS recall,
           round(2 * tp / (called + support), 6) AS f1 FROM c""")
def _(t):
    return rounded(classification_metrics(_calls(t), "y", "p"), 6)


_THREE = """(SELECT l_returnflag AS y, CASE WHEN l_quantity < 10 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS p
    FROM lineitem)"""


def _three(t):
    return t.lineitem.selectExpr("l_returnflag as y",
                                 "case when l_quantity < 10 then 'A' when l_quantity < 35 then 'N' else 'R' end as p")


@query("evaluate_multiclass", f"""
    WITH c AS (SELECT y, p, count(*)::DOUBLE AS n FROM {_THREE} GROUP BY ALL),
         s AS (SELECT y AS k, sum(n) AS support, sum(n) FILTER (y = p) AS tp FROM c GROUP BY 1),
         q AS (SELECT p AS k, sum(n) AS called FROM c GROUP BY 1), m AS (SELECT * FROM s JOIN q USING (k))
    SELECT round(sum(tp) / sum(support), 6) AS accuracy,
           round(sum(support * tp / called) / sum(support), 6) AS precision,
           round(sum(tp) / sum(support), 6) AS recall,
           round(sum(support * 2 * tp / (called + support)) / sum(support), 6) AS f1 FROM m""")
def _(t):
    return rounded(classification_metrics(_three(t), "y", "p"), 6)


@query("confusion_matrix", f"""
    SELECT y AS label, count(*) FILTER (p = 'A') AS "predicted_A", count(*) FILTER (p = 'N') AS "predicted_N",
           count(*) FILTER (p = 'R') AS "predicted_R" FROM {_THREE} GROUP BY 1""")
def _(t):
    return confusion_matrix(_three(t), "y", "p")


_THRESHOLDS = f"""
    WITH c AS (SELECT s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM {_CALLS} GROUP BY 1),
         w AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
                      sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM c)"""


@query("roc_curve", f"""
    {_THRESHOLDS}
    SELECT s AS threshold, fp / nn AS fpr, tp / np AS tpr FROM w UNION ALL
    SELECT 'Infinity'::DOUBLE, 0, 0""")
def _(t):
    return roc_curve(_calls(t), "y", "s")


@query("roc_auc", f"{_THRESHOLDS} SELECT round(sum(neg * (tp - pos / 2)) / any_value(np * nn), 8) AS auc FROM w")
def _(t):
    return rounded(roc_auc(_calls(t), "y", "s"), 8)


@query("precision_recall_curve", f"""
    {_THRESHOLDS}
    SELECT s AS threshold, tp / (tp + fp) AS precision, tp / np AS recall FROM w UNION ALL
    SELECT 'Infinity'::DOUBLE, 1, 0""")
def _(t):
    return precision_recall_curve(_calls(t), "y", "s")


@query("average_precision", f"""
    {_THRESHOLDS} SELECT round(sum(tp / (tp + fp) * pos) / any_value(np), 8) AS average_precision FROM w""")
def _(t):
    return rounded(average_precision(_calls(t), "y", "s"), 8)
