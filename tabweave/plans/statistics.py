"""Checked queries: profiles, aggregates, transforms, encodings, correlation,
feature selection and statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.core.numeric import _TAIL_BOTTOM, _TAIL_TOP
from tabweave.functions.dates import extract_datetime_parts
from tabweave.functions.transforms import (bin_column, bin_counts, log_domain_counts, log_transform, normalize,
                                           polynomial_features)
from tabweave.operators.aggregate import crosstab, describe_by_group, group_aggregate, group_aggregate_multi
from tabweave.operators.correlation import correlation_matrix, get_correlation
from tabweave.operators.encode import frequency_encode, label_encode, label_mapping, one_hot_encode, target_encode
from tabweave.operators.hypothesis import (_LAST_WEIGHT, _NEXT_WEIGHT, anova_test, chi_square_test, group_medians, kruskal_wallis_test,
                                           mann_whitney_test, normality_test, ttest_independent)
from tabweave.operators.missing import fill_missing
from tabweave.operators.profile import (detect_outliers, get_column_profile, get_info, get_shape, get_statistics,
                                        get_unique_values, get_value_counts, missing_patterns, quality_report)
from tabweave.operators.relational import merge_dataframes
from tabweave.operators.rows import sort_values
from tabweave.operators.neighbours import neighbour_information
from tabweave.operators.selection import (correlation_filter, drop_low_importance, feature_importance,
                                          mutual_information, variance_filter)
from tabweave.plans.catalog import normal_quantile_sql, query, rounded

# --- the flagship query -----------------------------------------------------


@query("revenue_by_year", """
    WITH j AS (SELECT year(o_orderdate)::INTEGER AS o_orderdate_year, l_returnflag, l_extendedprice, l_quantity,
                      CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
         f AS (SELECT * REPLACE (coalesce(l_discount, (SELECT median(l_discount) FROM j)) AS l_discount) FROM j)
    SELECT o_orderdate_year, l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice_sum,
           round(avg(l_extendedprice), 4) AS l_extendedprice_mean, round(median(l_quantity), 4) AS l_quantity_median,
           round(avg(l_discount), 6) AS l_discount_mean, count(l_discount) AS l_discount_count
    FROM f GROUP BY 1, 2""")
def _(t):
    lines = t.lineitem.selectExpr("l_orderkey as key", "l_returnflag", "l_extendedprice", "l_quantity",
                                  "if(l_orderkey % 7 = 0, null, l_discount) as l_discount")
    joined = merge_dataframes(lines, t.orders.selectExpr("o_orderkey as key", "o_orderdate"), ["key"])
    dated = extract_datetime_parts(joined, "o_orderdate", ["year"])
    filled = fill_missing(dated, ["l_discount"], "median")
    out = group_aggregate_multi(filled, ["o_orderdate_year", "l_returnflag"], {
        "l_extendedprice": ["sum", "mean"], "l_quantity": ["median"], "l_discount": ["mean", "count"]})
    out = rounded(rounded(rounded(out, 2, ["l_extendedprice_sum"]), 4, ["l_extendedprice_mean", "l_quantity_median"]),
                  6, ["l_discount_mean"])
    return sort_values(out, ["o_orderdate_year", "l_returnflag"])


# --- profiles ---------------------------------------------------------------

@query("get_shape", "SELECT count(*) AS n_rows, 11::BIGINT AS n_cols FROM lineitem")
def _(t):
    return get_shape(t.lineitem)


@query("get_info", """
    SELECT 'c_custkey' AS "column", 'bigint' AS dtype, count(c_custkey) AS non_null FROM customer UNION ALL
    SELECT 'c_nationkey', 'int', count(*) FILTER (c_custkey % 11 <> 0) FROM customer UNION ALL
    SELECT 'c_acctbal', 'double', count(c_acctbal) FROM customer UNION ALL
    SELECT 'c_mktsegment', 'string', count(c_mktsegment) FROM customer""")
def _(t):
    rows = t.customer.selectExpr("c_custkey", "if(c_custkey % 11 = 0, null, c_nationkey) as c_nationkey", "c_acctbal",
                                 "c_mktsegment")
    return get_info(rows)


def _statistics_sql(column: str) -> str:
    parts = [("count", "count({x})::DOUBLE"), ("mean", "avg({x})"), ("std", "stddev_samp({x})"), ("min", "min({x})"),
             ("25%", "quantile_cont({x}, 0.25)"), ("50%", "quantile_cont({x}, 0.5)"),
             ("75%", "quantile_cont({x}, 0.75)"), ("max", "max({x})")]
    return " UNION ALL ".join(
        f"SELECT '{column}' AS \"column\", '{s}' AS stat, round({e.format(x=column)}, 4) AS value, NULL::VARCHAR AS text "
        "FROM h" for s, e in parts)


@query("get_statistics", f"""
    WITH h AS (SELECT o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey::DOUBLE END AS o_custkey,
                      CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)
    {_statistics_sql('o_totalprice')} UNION ALL {_statistics_sql('o_custkey')} UNION ALL
    SELECT 'o_orderpriority', 'count', count(o_orderpriority), NULL FROM h UNION ALL
    SELECT 'o_orderpriority', 'unique', count(DISTINCT o_orderpriority), NULL FROM h UNION ALL
    (SELECT 'o_orderpriority', 'top', NULL, o_orderpriority FROM h WHERE o_orderpriority IS NOT NULL
     GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1) UNION ALL
    (SELECT 'o_orderpriority', 'freq', count(*), NULL FROM h WHERE o_orderpriority IS NOT NULL
     GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)""")
def _(t):
    rows = t.orders.selectExpr("o_totalprice", "if(o_orderkey % 7 = 0, null, o_custkey) as o_custkey",
                               "if(o_orderkey % 7 = 0, null, o_orderpriority) as o_orderpriority")
    return rounded(get_statistics(rows))


@query("quality_report", """
    WITH h AS (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS event_type FROM events),
         s AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM h)) AS d FROM h)
    SELECT "column", dtype, missing, round(missing * 100.0 / n, 4) AS missing_pct, "unique", n AS n_rows,
           n - d AS duplicate_rows, round((n - d) * 100.0 / n, 4) AS duplicate_pct
    FROM (SELECT 'user_id' AS "column", 'bigint' AS dtype, count(*) - count(user_id) AS missing,
                 count(DISTINCT user_id) AS "unique" FROM h UNION ALL
          SELECT 'event_type', 'string', count(*) - count(event_type), count(DISTINCT event_type) FROM h), s""")
def _(t):
    rows = t.events.selectExpr("user_id", "if(event_id % 4 = 0, null, event_type) as event_type")
    return rounded(quality_report(rows))


_TOP = """WITH h AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS value FROM orders),
    c AS (SELECT value, count(*) AS "count" FROM h GROUP BY value)"""


def _priority(t):
    return t.orders.selectExpr("if(o_orderkey % 7 = 0, null, o_orderpriority) as p")


@query("get_unique_values", f"""
    {_TOP} SELECT value, "count", round("count" * 100.0 / (SELECT count(*) FROM h), 4) AS pct,
                  (SELECT count(*) FROM c) AS n_unique FROM c ORDER BY "count" DESC, value LIMIT 50""")
def _(t):
    return rounded(get_unique_values(_priority(t), "p"))


@query("get_value_counts", f"""
    {_TOP}, v AS (SELECT value, "count", "count" * 100.0 / (SELECT count(*) FROM h) AS pct FROM c
                  ORDER BY "count" DESC, value LIMIT 4)
    SELECT value, "count", round(pct, 4) AS pct,
           round(sum(pct) OVER (ORDER BY "count" DESC, value ROWS UNBOUNDED PRECEDING), 4) AS cumulative_pct,
           (SELECT count(*) FROM c) AS n_unique FROM v""")
def _(t):
    return rounded(get_value_counts(_priority(t), "p", 4))


@query("get_column_profile", """
    WITH h AS (SELECT CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events)
    SELECT 'v' AS "column", 'double' AS dtype, count(*) AS n_rows, count(v) AS non_null, count(*) - count(v) AS missing,
           round((count(*) - count(v)) * 100.0 / count(*), 4) AS missing_pct, count(DISTINCT v) + 1 AS "unique",
           min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(median(v), 4) AS median,
           round(stddev_samp(v), 4) AS std, round(skewness(v), 4) AS skewness, round(kurtosis(v), 4) AS kurtosis,
           (SELECT string_agg(round(v, 6)::VARCHAR || ' x' || n, '; ' ORDER BY n DESC, v) FROM
            (SELECT v, count(*) AS n FROM h WHERE v IS NOT NULL GROUP BY v ORDER BY n DESC, v LIMIT 10)) AS top_values
    FROM h""")
def _(t):
    out = rounded(get_column_profile(t.events.selectExpr("if(event_id % 4 = 0, null, value) as v"), "v"))
    return out.withColumn("top_values", F.array_join(F.transform("top_values", lambda x: F.concat(
        F.round(x["value"].cast("double"), 6).cast("string"), F.lit(" x"), x["count"].cast("string"))), "; "))


@query("detect_outliers_iqr", """
    WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
         e AS (SELECT value, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM events, b)
    SELECT 'iqr' AS method, count(*) FILTER (value < lo OR value > hi) AS n_outliers,
           round(count(*) FILTER (value < lo OR value > hi) * 100.0 / count(value), 4) AS pct,
           round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound, round(min(value), 4) AS min,
           round(max(value), 4) AS max, round(min(value) FILTER (value < lo OR value > hi), 4) AS outlier_min,
           round(max(value) FILTER (value < lo OR value > hi), 4) AS outlier_max FROM e""")
def _(t):
    return rounded(detect_outliers(t.events, "value"))


@query("detect_outliers_zscore", """
    WITH b AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem),
         e AS (SELECT l_extendedprice AS v, abs(l_extendedprice - m) / s > 1.5 AS o, m, s FROM lineitem, b)
    SELECT 'zscore' AS method, count(*) FILTER (o) AS n_outliers, round(count(*) FILTER (o) * 100.0 / count(v), 4) AS pct,
           round(any_value(m - 1.5 * s), 4) AS lower_bound, round(any_value(m + 1.5 * s), 4) AS upper_bound,
           round(min(v), 4) AS min, round(max(v), 4) AS max, round(min(v) FILTER (o), 4) AS outlier_min,
           round(max(v) FILTER (o), 4) AS outlier_max FROM e""")
def _(t):
    return rounded(detect_outliers(t.lineitem, "l_extendedprice", "zscore"))


@query("missing_patterns", """
    SELECT a::INTEGER AS a, b::INTEGER AS b, count(*) AS n_rows FROM (
        SELECT event_id % 3 = 0 AS a, event_id % 4 = 0 AS b FROM events) GROUP BY 1, 2""")
def _(t):
    rows = t.events.selectExpr("if(event_id % 3 = 0, null, user_id) as a", "if(event_id % 4 = 0, null, value) as b")
    return missing_patterns(rows)


# --- grouped aggregates -----------------------------------------------------

_FUNCTIONS = {"mean": "avg(p)", "sum": "coalesce(sum(p), 0)", "count": "count(p)", "min": "min(p)", "max": "max(p)",
              "median": "median(p)", "std": "stddev_samp(p)"}
for _f, _sql in _FUNCTIONS.items():
    @query(f"group_aggregate_{_f}", f"""
        SELECT g, {_sql if _f == 'count' else f'round({_sql}, 3)'} AS p_{_f} FROM (
            SELECT CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS g,
                   CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders)
        WHERE g IS NOT NULL GROUP BY g""")
    def _(t, f=_f):
        rows = t.orders.selectExpr("if(o_custkey % 9 = 0, null, o_orderpriority) as g",
                                   "if(o_orderkey % 7 = 0, null, o_totalprice) as p")
        return rounded(group_aggregate(rows, ["g"], "p", f), 3)


@query("group_aggregate_multi", """
    SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS l_quantity_mean,
           round(median(l_extendedprice), 4) AS l_extendedprice_median, max(l_shipdate) AS l_shipdate_max,
           round(sum(l_extendedprice), 2) AS l_extendedprice_sum, count(l_discount) AS l_discount_count,
           round(stddev_samp(l_discount), 6) AS l_discount_std
    FROM lineitem GROUP BY 1, 2""")
def _(t):
    out = group_aggregate_multi(t.lineitem, ["l_returnflag", "l_linestatus"], {
        "l_quantity": ["mean"], "l_extendedprice": ["median", "sum"], "l_shipdate": ["max"],
        "l_discount": ["count", "std"]})
    out = rounded(out, 6, ["l_discount_std"])
    return rounded(rounded(out, 4, ["l_quantity_mean", "l_extendedprice_median"]), 2, ["l_extendedprice_sum"])


def _describe_sql(column: str) -> str:
    return (f"SELECT l_returnflag, '{column}' AS \"column\", count({column}) AS count, round(avg({column}), 4) AS mean, "
            f"round(median({column}), 4) AS median, round(stddev_samp({column}), 4) AS std, min({column}) AS min, "
            f"max({column}) AS max FROM lineitem GROUP BY 1")


@query("describe_by_group", f"{_describe_sql('l_quantity')} UNION ALL {_describe_sql('l_extendedprice')}")
def _(t):
    return describe_by_group(t.lineitem, "l_returnflag", ["l_quantity", "l_extendedprice"])


@query("crosstab_counts", """
    SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
           count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def _(t):
    return crosstab(t.orders, "o_orderpriority", "o_orderstatus")


@query("crosstab_normalized", """
    SELECT o_orderpriority, round(round(count(*) FILTER (o_orderstatus = 'F') / n, 4) * 100, 2) AS "F",
           round(round(count(*) FILTER (o_orderstatus = 'O') / n, 4) * 100, 2) AS "O",
           round(round(count(*) FILTER (o_orderstatus = 'P') / n, 4) * 100, 2) AS "P"
    FROM orders, (SELECT count(*)::DOUBLE AS n FROM orders) GROUP BY o_orderpriority, n""")
def _(t):
    return rounded(crosstab(t.orders, "o_orderpriority", "o_orderstatus", normalize=True), 2)


# --- numeric transforms -----------------------------------------------------

for _m, _sql in (("log1p", "CASE WHEN x > -1 THEN ln(1 + x) END"), ("log", "CASE WHEN x > 0 THEN ln(x) END"),
                 ("log10", "CASE WHEN x > 0 THEN log10(x) END")):
    @query(f"log_transform_{_m}", f"""
        SELECT c_custkey, x, round({_sql}, 6) AS "Log_x" FROM (SELECT c_custkey, c_acctbal AS x FROM customer)""")
    def _(t, m=_m):
        return rounded(log_transform(t.customer.selectExpr("c_custkey", "c_acctbal as x"), ["x"], m), 6, ["Log_x"])


@query("log_domain_counts", """
    SELECT 'c_acctbal' AS "column", count(*) FILTER (c_acctbal <= 0) AS n_outside FROM customer""")
def _(t):
    return log_domain_counts(t.customer, ["c_acctbal"], "log")


_SCALED = {"minmax": "(q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ())",
           "standard": "(q - avg(q) OVER ()) / stddev_pop(q) OVER ()",
           "robust": "(q - (SELECT median(q) FROM h)) / (SELECT quantile_cont(q, 0.75) - quantile_cont(q, 0.25) FROM h)"}
for _m, _sql in _SCALED.items():
    @query(f"normalize_{_m}", f"""
        WITH h AS (SELECT l_orderkey, l_linenumber,
                          CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS q FROM lineitem)
        SELECT l_orderkey, l_linenumber, round({_sql}, 5) AS q FROM h""")
    def _(t, m=_m):
        rows = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "if(l_orderkey % 7 = 0, null, l_extendedprice) as q")
        return rounded(normalize(rows, ["q"], m), 5)


@query("polynomial_features", """
    SELECT l_orderkey, l_linenumber, round(q * q, 4) AS "l_quantity^2", round(q * d, 4) AS l_quantity_l_discount,
           round(d * d, 4) AS "l_discount^2"
    FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q,
                 CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE l_discount END AS d FROM lineitem)""")
def _(t):
    rows = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_quantity",
                                 "if(l_orderkey % 7 = 0, null, l_discount) as l_discount")
    return rounded(polynomial_features(rows, ["l_quantity", "l_discount"]).drop("l_quantity", "l_discount"))


@query("polynomial_interactions", """
    SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 4) AS l_quantity_l_discount,
           round(l_quantity * l_tax, 4) AS l_quantity_l_tax, round(l_discount * l_tax, 4) AS l_discount_l_tax,
           round(l_quantity * l_discount * l_tax, 4) AS l_quantity_l_discount_l_tax FROM lineitem""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    out = polynomial_features(rows, ["l_quantity", "l_discount", "l_tax"], 3, interaction_only=True)
    return rounded(out.drop("l_quantity", "l_discount", "l_tax"))


@query("bin_quantile", """
    WITH e AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b,
                      quantile_cont(o_totalprice, 0.75) AS c FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 'low' WHEN o_totalprice <= b THEN 'mid'
           WHEN o_totalprice <= c THEN 'high' ELSE 'top' END AS band FROM orders, e""")
def _(t):
    out = bin_column(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 4, "quantile",
                     ["low", "mid", "high", "top"], "band")
    return out.drop("o_totalprice")


@query("bin_uniform", """
    WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 3 AS w FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice <= lo + w THEN 'small' WHEN o_totalprice <= lo + 2 * w THEN 'medium'
           ELSE 'large' END AS band FROM orders, e""")
def _(t):
    out = bin_column(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 3, "uniform",
                     ["small", "medium", "large"], "band")
    return out.drop("o_totalprice")


@query("bin_custom", """
    SELECT p_partkey, CASE WHEN p_size < 1 OR p_size > 40 THEN NULL WHEN p_size <= 10 THEN '[1, 10]'
           WHEN p_size <= 25 THEN '(10, 25]' ELSE '(25, 40]' END AS p_size_binned FROM part""")
def _(t):
    return bin_column(t.part.select("p_partkey", "p_size"), "p_size", [1, 10, 25, 40], "custom").drop("p_size")


@query("bin_counts", """
    SELECT CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 25 THEN 'medium' ELSE 'large' END AS bin, count(*) AS n
    FROM part WHERE p_size BETWEEN 1 AND 40 GROUP BY 1""")
def _(t):
    return bin_counts(t.part, "p_size", [1, 10, 25, 40], "custom", ["small", "medium", "large"])


# --- encodings --------------------------------------------------------------

@query("one_hot_encode", """
    SELECT o_orderkey, coalesce(s = 'O', false) AS "s_O", coalesce(s = 'P', false) AS "s_P"
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)""")
def _(t):
    return one_hot_encode(t.orders.selectExpr("o_orderkey", "if(o_orderkey % 7 = 0, null, o_orderstatus) as s"), ["s"])


@query("one_hot_encode_all", """
    SELECT o_orderkey, o_orderstatus = 'F' AS "o_orderstatus_F", o_orderstatus = 'O' AS "o_orderstatus_O",
           o_orderstatus = 'P' AS "o_orderstatus_P" FROM orders""")
def _(t):
    return one_hot_encode(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], drop_first=False)


@query("target_encode", """
    WITH h AS (SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey END AS g, o_totalprice AS y
               FROM orders),
         m AS (SELECT g, count(y) AS n, avg(y) AS m FROM h GROUP BY g),
         p AS (SELECT avg(y) AS prior FROM h)
    SELECT o_orderkey, round(prior * (1 - 1 / (1 + exp(-(n - 20) / 10.0))) + m * (1 / (1 + exp(-(n - 20) / 10.0))), 3)
           AS g, y FROM h JOIN m ON h.g IS NOT DISTINCT FROM m.g, p""")
def _(t):
    rows = t.orders.selectExpr("o_orderkey", "if(o_custkey % 9 = 0, null, o_custkey) as g", "o_totalprice as y")
    return rounded(target_encode(rows, ["g"], "y"), 3, ["g"])


@query("label_encode", """
    WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders),
         k AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS code FROM (SELECT DISTINCT p FROM h WHERE p IS NOT NULL))
    SELECT o_orderkey, code::BIGINT AS p FROM h LEFT JOIN k USING (p)""")
def _(t):
    rows = t.orders.selectExpr("o_orderkey", "if(o_orderkey % 7 = 0, null, o_orderpriority) as p")
    return label_encode(rows, ["p"])


@query("label_mapping", """
    SELECT category, (row_number() OVER (ORDER BY category) - 1)::BIGINT AS code FROM (
        SELECT DISTINCT o_custkey::VARCHAR AS category FROM orders)""")
def _(t):
    return label_mapping(t.orders, "o_custkey")


@query("frequency_encode", """
    WITH h AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS k, user_id FROM events)
    SELECT event_id, round(CASE WHEN k IS NOT NULL THEN count(k) OVER (PARTITION BY k) END / count(k) OVER (), 8) AS k,
           round(count(user_id) OVER (PARTITION BY user_id) / count(user_id) OVER (), 8) AS user_id FROM h""")
def _(t):
    rows = t.events.selectExpr("event_id", "if(event_id % 7 = 0, null, event_type) as k", "user_id")
    return rounded(frequency_encode(rows, ["k", "user_id"]), 8)


# --- correlation ------------------------------------------------------------

_STRENGTH = """CASE WHEN abs(corr) >= 0.8 THEN 'very strong' WHEN abs(corr) >= 0.6 THEN 'strong'
    WHEN abs(corr) >= 0.4 THEN 'moderate' WHEN abs(corr) >= 0.2 THEN 'weak' ELSE 'very weak / none' END AS strength,
    CASE WHEN corr > 0 THEN 'positive' ELSE 'negative' END AS direction"""


@query("correlation_pearson", f"""
    SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, 'pearson' AS method, round(corr, 6) AS corr, {_STRENGTH}
    FROM (SELECT corr(l_quantity, l_extendedprice) AS corr FROM lineitem)""")
def _(t):
    return rounded(get_correlation(t.lineitem, "l_quantity", "l_extendedprice"), 6)


def _ranks_sql(table: str, a: str, b: str) -> str:
    """Average ranks of two columns of a table expression."""
    return f"""(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
                       rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM {table})"""


@query("correlation_spearman", f"""
    SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, 'spearman' AS method, round(corr, 6) AS corr, {_STRENGTH}
    FROM (SELECT corr(ra, rb) AS corr FROM {_ranks_sql('lineitem', 'l_quantity', 'l_extendedprice')})""")
def _(t):
    return rounded(get_correlation(t.lineitem, "l_quantity", "l_extendedprice", "spearman"), 6)


def _kendall_sql(table: str, a: str, b: str) -> str:
    return f"""(
        WITH t AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {table} GROUP BY 1, 2),
             s AS (SELECT sum(x.n * y.n * sign(x.a - y.a) * sign(x.b - y.b)) / 2 AS s FROM t x, t y),
             z AS (SELECT sum(n) * (sum(n) - 1) / 2 AS z FROM t),
             ta AS (SELECT sum(m * (m - 1) / 2) AS ta FROM (SELECT sum(n) AS m FROM t GROUP BY a)),
             tb AS (SELECT sum(m * (m - 1) / 2) AS tb FROM (SELECT sum(n) AS m FROM t GROUP BY b))
        SELECT s / sqrt((z - ta) * (z - tb)) AS corr FROM s, z, ta, tb)"""


@query("correlation_kendall", f"""
    SELECT 'l_quantity' AS col_a, 'l_discount' AS col_b, 'kendall' AS method, round(corr, 6) AS corr, {_STRENGTH}
    FROM {_kendall_sql('lineitem', 'l_quantity', 'l_discount')}""")
def _(t):
    return rounded(get_correlation(t.lineitem, "l_quantity", "l_discount", "kendall"), 6)


_MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(y, x) for i, y in enumerate(_MATRIX) for x in _MATRIX[:i]]


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{y}' AS x, '{x}' AS y, round(corr({y}, {x}), 6) AS corr FROM lineitem" for y, x in _PAIRS))
def _(t):
    return rounded(correlation_matrix(t.lineitem, _MATRIX), 6)


@query("correlation_matrix_spearman", " UNION ALL ".join(
    f"SELECT '{y}' AS x, '{x}' AS y, round(corr(ra, rb), 6) AS corr FROM {_ranks_sql('orders', y, x)}"
    for y, x in (("o_custkey", "o_orderkey"), ("o_totalprice", "o_orderkey"), ("o_totalprice", "o_custkey"))))
def _(t):
    return rounded(correlation_matrix(t.orders, ["o_orderkey", "o_custkey", "o_totalprice"], "spearman"), 6)


# --- feature selection ------------------------------------------------------

@query("correlation_filter", " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", round(abs(corr({n}, l_extendedprice)), 6) AS abs_corr, "
    f"abs(corr({n}, l_extendedprice)) < 0.05 AS below FROM lineitem"
    for n in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")))
def _(t):
    return rounded(correlation_filter(t.lineitem, "l_extendedprice"), 6)


@query("variance_filter", " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", round(var_samp({e}), 6) AS variance, var_samp({e}) <= 0.001 AS low FROM lineitem"
    for n, e in (("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("l_tax", "l_tax"), ("fixed", "42"))))
def _(t):
    rows = t.lineitem.select("l_quantity", "l_discount", "l_tax").withColumn("fixed", F.lit(42))
    return rounded(variance_filter(rows, 0.001), 6)


@query("drop_low_importance_variance", "SELECT l_orderkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return drop_low_importance(rows.withColumn("fixed", F.lit(42)), "l_extendedprice")


@query("drop_low_importance_correlation", """
    SELECT l_extendedprice, l_returnflag, round(l_extendedprice * (1 + l_tax), 4) AS gross FROM lineitem""")
def _(t):
    rows = t.lineitem.select("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                             F.round(F.expr("l_extendedprice * (1 + l_tax)"), 4).alias("gross"))
    return drop_low_importance(rows, "l_extendedprice", "correlation", 0.1)


@query("feature_importance_forest")
def _(t):
    rows = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    return feature_importance(rows, "l_extendedprice")


def _information_sql(feature: str, target: str, table: str, bins: int = 10) -> str:
    def place(x: str) -> str:
        cuts = ", ".join(f"quantile_cont({x}, {i / bins})" for i in range(1, bins))
        return f"(SELECT list_distinct([{cuts}]) FROM {table})", f"len(list_filter(e_{x}, lambda q: q < {x}))"
    (ef, bf), (et, bt) = place(feature), place(target)
    return f"""SELECT '{feature}' AS feature, round(sum(n / t * ln(n * t / (nf * ny))), 5) AS importance FROM (
        SELECT n::DOUBLE AS n, sum(n) OVER ()::DOUBLE AS t, sum(n) OVER (PARTITION BY f)::DOUBLE AS nf,
               sum(n) OVER (PARTITION BY y)::DOUBLE AS ny
        FROM (SELECT {bf} AS f, {bt} AS y, count(*) AS n
              FROM {table}, (SELECT {ef} AS e_{feature}, {et} AS e_{target}) GROUP BY 1, 2))"""


@query("mutual_info_regression", " UNION ALL ".join(
    _information_sql(n, "l_extendedprice", "lineitem") for n in ("l_quantity", "l_discount")))
def _(t):
    return rounded(mutual_information(t.lineitem, "l_extendedprice", True, features=["l_quantity", "l_discount"]), 5)


@query("mutual_info_classif", """
    SELECT 'l_quantity' AS feature, 1::INTEGER AS rank,
           round(sum(n / t * ln(n * t / (nf * ny))), 5) AS importance FROM (
        SELECT n::DOUBLE AS n, sum(n) OVER ()::DOUBLE AS t, sum(n) OVER (PARTITION BY f)::DOUBLE AS nf,
               sum(n) OVER (PARTITION BY y)::DOUBLE AS ny
        FROM (SELECT len(list_filter(e, lambda q: q < l_quantity)) AS f, l_returnflag AS y, count(*) AS n FROM lineitem,
              (SELECT list_distinct([quantile_cont(l_quantity, 0.1), quantile_cont(l_quantity, 0.2),
                quantile_cont(l_quantity, 0.3), quantile_cont(l_quantity, 0.4), quantile_cont(l_quantity, 0.5),
                quantile_cont(l_quantity, 0.6), quantile_cont(l_quantity, 0.7), quantile_cont(l_quantity, 0.8),
                quantile_cont(l_quantity, 0.9)]) AS e FROM lineitem) GROUP BY 1, 2))""")
def _(t):
    rows = t.lineitem.select("l_quantity", "l_returnflag")
    return rounded(feature_importance(rows, "l_returnflag", "mutual_info_classif"), 5)


def _psi_sql(n: str) -> str:
    z = f"({n} + 8.0)"
    tail = "".join(f" - 1.0 / ({n} + {j})" for j in range(8))
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z}^2) + 1 / (120 * {z}^4) - 1 / (252 * {z}^6) + 1 / (240 * {z}^8){tail})"


@query("neighbour_information", f"""
    WITH raw AS (SELECT 'c_nationkey' AS feature, c_custkey AS id, c_nationkey::DOUBLE AS x, c_acctbal AS y FROM customer
                 UNION ALL SELECT 'c_custkey', c_custkey, c_custkey::DOUBLE, c_acctbal FROM customer),
    p AS (SELECT feature, id, x / stddev_pop(x) OVER (PARTITION BY feature) AS x,
                 y / stddev_pop(y) OVER (PARTITION BY feature) AS y FROM raw),
    reach AS (SELECT a.feature, a.id, a.x, a.y, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] AS e
              FROM p a JOIN p b ON a.feature = b.feature AND a.id <> b.id GROUP BY ALL),
    counted AS (SELECT a.feature, a.id,
                       sum((abs(a.x - b.x) < a.e * (1 - 1e-12) - 1e-14 * abs(a.x) OR (a.e = 0 AND a.x = b.x))::INT) AS nx,
                       sum((abs(a.y - b.y) < a.e * (1 - 1e-12) - 1e-14 * abs(a.y) OR (a.e = 0 AND a.y = b.y))::INT) AS ny
                FROM reach a JOIN p b ON a.feature = b.feature GROUP BY ALL)
    SELECT feature, round(greatest(0, {_psi_sql("count(*)")} + {_psi_sql("3")}
                                      - avg({_psi_sql("nx")} + {_psi_sql("ny")})), 5) AS importance
    FROM counted GROUP BY feature""")
def _(t):
    return rounded(neighbour_information(t.customer, "c_acctbal", ["c_nationkey", "c_custkey"]), 5)


@query("neighbour_information_classes", f"""
    WITH raw AS (SELECT 'c_nationkey' AS feature, c_custkey AS id, c_nationkey::DOUBLE AS x, c_mktsegment AS g FROM customer
                 UNION ALL SELECT 'c_acctbal', c_custkey, c_acctbal, c_mktsegment FROM customer),
    p AS (SELECT feature, id, g, x / stddev_pop(x) OVER (PARTITION BY feature) AS x,
                 count(*) OVER (PARTITION BY feature, g) AS n FROM raw),
    lists AS (SELECT a.feature, a.id, a.x, a.n, min(abs(a.x - b.x), 3) AS near
              FROM p a JOIN p b ON a.feature = b.feature AND a.g = b.g AND a.id <> b.id GROUP BY ALL),
    reach AS (SELECT feature, id, x, n, least(n - 1, 3) AS k, near[least(n - 1, 3)] AS e FROM lists),
    counted AS (SELECT a.feature, a.id, a.k, a.n,
                       sum((abs(a.x - b.x) < a.e * (1 - 1e-12) - 1e-14 * abs(a.x) OR (a.e = 0 AND a.x = b.x))::INT) AS nx
                FROM reach a JOIN p b ON a.feature = b.feature GROUP BY ALL)
    SELECT feature, round(greatest(0, {_psi_sql("count(*)")}
                                      + avg({_psi_sql("k")} - {_psi_sql("n")} - {_psi_sql("nx")})), 5) AS importance
    FROM counted GROUP BY feature""")
def _(t):
    return rounded(neighbour_information(t.customer, "c_mktsegment", ["c_nationkey", "c_acctbal"],
                                         continuous_target=False), 5)


# --- statistical tests ------------------------------------------------------

@query("ttest_independent", """
    WITH g AS (SELECT l_linestatus AS g, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v
               FROM lineitem GROUP BY 1),
         x AS (SELECT a.n AS na, a.m AS ma, a.v AS va, b.n AS nb, b.m AS mb, b.v AS vb
               FROM g a, g b WHERE a.g = 'F' AND b.g = 'O')
    SELECT 'F' AS group_a, na::BIGINT AS n_a, round(ma, 3) AS mean_a, round(sqrt(va), 3) AS std_a, 'O' AS group_b,
           nb::BIGINT AS n_b, round(mb, 3) AS mean_b, round(sqrt(vb), 3) AS std_b,
           round((ma - mb) / sqrt(va / na + vb / nb), 5) AS t,
           round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 2) AS dof,
           round(abs(ma - mb) / sqrt((va + vb) / 2), 6) AS cohens_d FROM x""")
def _(t):
    out = ttest_independent(t.lineitem, "l_extendedprice", "l_linestatus").drop("p_value", "significant")
    for digits, names in ((3, ["mean_a", "std_a", "mean_b", "std_b"]), (5, ["t"]), (2, ["dof"]), (6, ["cohens_d"])):
        out = rounded(out, digits, names)
    return out


@query("anova_test", """
    WITH g AS (SELECT o_orderpriority AS g, count(*)::DOUBLE AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v
               FROM orders GROUP BY 1),
         s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS w FROM g),
         b AS (SELECT sum(g.n * (g.m - s.gm) ** 2) AS b FROM g, s)
    SELECT k AS n_groups, n::BIGINT AS n, round((b / (k - 1)) / (w / (n - k)), 5) AS f, k - 1 AS dof_between,
           (n - k)::BIGINT AS dof_within, round(b / (b + w), 8) AS eta_squared FROM s, b""")
def _(t):
    out = anova_test(t.orders, "o_totalprice", "o_orderpriority").drop("p_value", "significant")
    return rounded(rounded(out, 5, ["f"]), 8, ["eta_squared"])


@query("chi_square_test", """
    WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
         r AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1),
         t AS (SELECT sum(n) AS t FROM c),
         e AS (SELECT na * nb / t AS e, coalesce(n, 0) AS n FROM r CROSS JOIN k CROSS JOIN t
               LEFT JOIN c ON c.a = r.a AND c.b = k.b),
         x AS (SELECT sum((n - e) ** 2 / e) AS x FROM e)
    SELECT (SELECT count(*) FROM r) AS n_rows_a, (SELECT count(*) FROM k) AS n_rows_b, t::BIGINT AS n,
           round(x, 4) AS chi2, 2::BIGINT AS dof, round(exp(-x / 2), 8) AS p_value, exp(-x / 2) < 0.05 AS significant,
           round(sqrt(x / t), 6) AS cramers_v FROM x, t""")
def _(t):
    out = chi_square_test(t.lineitem, "l_returnflag", "l_linestatus")
    return rounded(rounded(rounded(out, 4, ["chi2"]), 8, ["p_value"]), 6, ["cramers_v"])


@query("chi_square_corrected", """
    WITH h AS (SELECT l_linestatus = 'F' AS a, l_quantity > 25 AS b FROM lineitem),
         c AS (SELECT a, b, count(*)::DOUBLE AS n FROM h GROUP BY 1, 2),
         e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e,
                      sum(n) OVER () AS t FROM c),
         x AS (SELECT sum((abs(n - e) - least(0.5, abs(n - e))) ** 2 / e) AS x, any_value(t) AS t FROM e)
    SELECT 2::BIGINT AS n_rows_a, 2::BIGINT AS n_rows_b, t::BIGINT AS n, round(x, 6) AS chi2, 1::BIGINT AS dof,
           round(sqrt(x / t), 8) AS cramers_v FROM x""")
def _(t):
    rows = t.lineitem.selectExpr("l_linestatus = 'F' as a", "l_quantity > 25 as b")
    out = chi_square_test(rows, "a", "b").drop("p_value", "significant")
    return rounded(rounded(out, 6, ["chi2"]), 8, ["cramers_v"])


def _polynomial_sql(coefficients: tuple[float, ...]) -> str:
    return " + ".join(f"{k!r} * u ** {i}" for i, k in enumerate(coefficients))


@query("normality_shapiro", f"""
    WITH s AS (SELECT count(*)::DOUBLE AS n, avg(o_totalprice) AS mean FROM orders),
         o AS (SELECT o_totalprice - mean AS v, row_number() OVER (ORDER BY o_totalprice) AS i, n FROM orders, s),
         p AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM o),
         m AS {normal_quantile_sql('p')},
         a AS (SELECT any_value(n) AS n, 1 / sqrt(any_value(n)) AS u, sum(m * m) AS sq, sum(v * v) AS ss,
                      max(m) AS m1, max(m) FILTER (i = n - 1) AS m2, sum(m * v) FILTER (i > 2 AND i < n - 1) AS inside,
                      max(v) - min(v) AS outer1, max(v) FILTER (i = n - 1) - max(v) FILTER (i = 2) AS outer2 FROM m),
         e AS (SELECT *, {_polynomial_sql(_LAST_WEIGHT)} + m1 / sqrt(sq) AS e1,
                      {_polynomial_sql(_NEXT_WEIGHT)} + m2 / sqrt(sq) AS e2 FROM a),
         t AS (SELECT ss, inside / sqrt((sq - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * e1 * e1 - 2 * e2 * e2))
                      + e1 * outer1 + e2 * outer2 AS top FROM e)
    SELECT 'shapiro' AS method, (SELECT count(*) FROM orders) AS n,
           (SELECT round(skewness(o_totalprice), 5) FROM orders) AS skewness,
           (SELECT round(kurtosis(o_totalprice), 5) FROM orders) AS kurtosis, round(top * top / ss, 8) AS statistic FROM t""")
def _(t):
    out = normality_test(t.orders, "o_totalprice").drop("p_value", "normal")
    return rounded(rounded(out, 5, ["skewness", "kurtosis"]), 8, ["statistic"])


def _horner_sql(coefficients: tuple[float, ...]) -> str:
    text = repr(coefficients[0])
    for k in coefficients[1:]:
        text = f"({text}) * a + {k!r}"
    return text


@query("normality_ks", f"""
    WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd, count(*)::DOUBLE AS n FROM lineitem),
         v AS (SELECT l_extendedprice AS v, count(*)::DOUBLE AS c FROM lineitem GROUP BY 1),
         r AS (SELECT v, sum(c) OVER (ORDER BY v) AS upto, c, (v - m) / sd AS z, abs((v - m) / sd) AS a, n FROM v, s),
         p AS (SELECT *, exp(-a * a / 2) * ({_horner_sql(_TAIL_TOP)}) / ({_horner_sql(_TAIL_BOTTOM)}) AS tail FROM r),
         d AS (SELECT max(greatest(upto / n - phi, phi - (upto - c) / n)) AS d FROM
               (SELECT *, CASE WHEN z > 0 THEN 1 - tail ELSE tail END AS phi FROM p))
    SELECT 'ks' AS method, (SELECT count(*) FROM lineitem) AS n,
           (SELECT round(skewness(l_extendedprice), 5) FROM lineitem) AS skewness,
           (SELECT round(kurtosis(l_extendedprice), 5) FROM lineitem) AS kurtosis, round(d, 7) AS statistic FROM d""")
def _(t):
    out = normality_test(t.lineitem, "l_extendedprice", "ks").drop("p_value", "normal")
    return rounded(rounded(out, 5, ["skewness", "kurtosis"]), 7, ["statistic"])


@query("normality_dagostino", """
    WITH m AS (SELECT count(*)::DOUBLE AS n, avg(o_totalprice) AS m FROM orders),
         g AS (SELECT any_value(n) AS n, avg((o_totalprice - m) ** 3) / var_pop(o_totalprice) ** 1.5 AS g1,
                      avg((o_totalprice - m) ** 4) / var_pop(o_totalprice) ** 2 AS b2 FROM orders, m),
         s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
                      sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
                                / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
                      (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3)
                                / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
                      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
                        * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM g),
         a AS (SELECT *, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / sb ** 2)) AS a,
                      asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs FROM s),
         z AS (SELECT zs, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS zk
               FROM a)
    SELECT 'dagostino' AS method, (SELECT count(*) FROM orders) AS n,
           (SELECT round(skewness(o_totalprice), 5) FROM orders) AS skewness,
           (SELECT round(kurtosis(o_totalprice), 5) FROM orders) AS kurtosis,
           round(zs * zs + zk * zk, 2) AS statistic, exp(-(zs * zs + zk * zk) / 2) >= 0.05 AS normal FROM z""")
def _(t):
    out = normality_test(t.orders, "o_totalprice", "dagostino").drop("p_value")
    return rounded(rounded(out, 5, ["skewness", "kurtosis"]), 2, ["statistic"])


_RANKED = """(SELECT {g} AS g, {v} AS v, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS r
    FROM {t})"""


@query("mann_whitney_test", f"""
    WITH s AS (SELECT g, count(*)::DOUBLE AS n, sum(r)::DOUBLE AS r, median(v) AS m FROM
               {_RANKED.format(g='l_linestatus', v='l_extendedprice', t='lineitem')} GROUP BY g),
         x AS (SELECT a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.r - a.n * (a.n + 1) / 2 AS u
               FROM s a, s b WHERE a.g = 'F' AND b.g = 'O')
    SELECT 'F' AS group_a, na::BIGINT AS n_a, round(ma, 3) AS median_a, 'O' AS group_b, nb::BIGINT AS n_b,
           round(mb, 3) AS median_b, round(u, 1) AS u, round(1 - 2 * u / (na * nb), 7) AS rank_biserial FROM x""")
def _(t):
    out = mann_whitney_test(t.lineitem, "l_extendedprice", "l_linestatus").drop("p_value", "significant")
    return rounded(rounded(rounded(out, 3, ["median_a", "median_b"]), 1, ["u"]), 7, ["rank_biserial"])


@query("mann_whitney_exact", """
    WITH RECURSIVE v AS (
           SELECT n_regionkey = 0 AS inside, avg(c_acctbal) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey
           GROUP BY n_nationkey, n_regionkey),
         r AS (SELECT inside, row_number() OVER (ORDER BY v) AS r FROM v),
         s AS (SELECT count(*) AS n, count_if(inside) AS n1, (sum(r) FILTER (WHERE inside))::BIGINT AS rank_sum FROM r),
         sets AS (  -- how many sets of k of the first i ranks have a sum
           SELECT 0 AS i, 0 AS k, 0 AS total, 1::HUGEINT AS ways
           UNION ALL
           SELECT i + 1, k + d, total + d * (i + 1), sum(ways)::HUGEINT FROM sets, (VALUES (0), (1)) AS x(d), s
           WHERE i < s.n AND k + d <= s.n1 GROUP BY i, k + d, total + d * (i + 1)),
         u AS (SELECT *, rank_sum - n1 * (n1 + 1) // 2 AS u FROM s),
         t AS (SELECT sum(ways) AS everything, sum(ways) FILTER (
                 WHERE total - n1 * (n1 + 1) // 2 <= least(u, n1 * (n - n1) - u)) AS tail
               FROM sets, u WHERE i = n AND k = n1)
    SELECT (n - n1)::BIGINT AS n_a, n1::BIGINT AS n_b, (n1 * (n - n1) - u)::DOUBLE AS u,
           round(least(1, 2 * tail::DOUBLE / everything), 9) AS p_value FROM u, t""")
def _(t):
    # mean balances of the nations of one region against all others: few values and no ties
    nations = t.customer.join(t.nation, F.expr("n_nationkey = c_nationkey")).groupBy("n_nationkey", "n_regionkey").agg(
        F.avg("c_acctbal").alias("balance")).withColumn("inside", F.col("n_regionkey") == 0)
    out = mann_whitney_test(nations, "balance", "inside").select("n_a", "n_b", "u", "p_value")
    return rounded(out, 9, ["p_value"])


@query("kruskal_wallis_test", f"""
    WITH r AS {_RANKED.format(g='event_type', v='value', t='events')},
         s AS (SELECT g, count(*)::DOUBLE AS n, sum(r)::DOUBLE AS r FROM r GROUP BY g),
         t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v)),
         h AS (SELECT count(*) AS k, sum(n) AS n, (12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1))
                      / (1 - any_value(ties) / (sum(n) ** 3 - sum(n))) AS h FROM s, t)
    SELECT k AS n_groups, n::BIGINT AS n, round(h, 4) AS h, k - 1 AS dof, round(exp(-h / 2) * (1 + h / 2), 6) AS p_value,
           exp(-h / 2) * (1 + h / 2) < 0.05 AS significant, round((h - k + 1) / (n - k), 7) AS epsilon_squared FROM h""")
def _(t):
    # five groups: four degrees of freedom have a closed form
    out = kruskal_wallis_test(t.events, "value", "event_type")
    return rounded(rounded(rounded(out, 4, ["h"]), 6, ["p_value"]), 7, ["epsilon_squared"])


@query("group_medians", """
    SELECT event_type, count(*) AS n, round(median(value), 4) AS median FROM events GROUP BY 1""")
def _(t):
    return rounded(group_medians(t.events, "value", "event_type"))
