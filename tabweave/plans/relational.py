"""Checked queries: sources, joins, reshaping, projection, rows, repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.functions.dates import (datetime_diff, datetime_filter, datetime_range, extract_datetime_parts,
                                      set_datetime_index)
from tabweave.operators.columns import (apply_mapping, clip_outliers, clip_report, convert_dtype, count_value,
                                        create_column, drop_columns, rename_columns, replace_values, select_dtypes,
                                        string_clean)
from tabweave.operators.missing import fill_missing, missing_counts
from tabweave.operators.relational import concat_dataframes, melt_dataframe, merge_dataframes, pivot_table
from tabweave.operators.rows import (add_row_index, drop_duplicates, drop_missing, filter_rows, get_head, get_tail,
                                     sample_data, sort_values)
from tabweave.plans.catalog import query, rounded
from tabweave.session import scratch_path
from tabweave.sources.files import load_csv, load_parquet, save_csv, table_shapes

# --- sources and catalog ----------------------------------------------------


@query("load_csv", """
    SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') AS o_orderdate) FROM orders""")
def _(t):
    path = scratch_path(t.spark, "orders-csv")
    save_csv(t.orders, path)
    return load_csv(t.spark, path)


@query("load_csv_line_breaks", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || '"' || c_mktsegment || '", ' || chr(10) || chr(10) || 'x'
                           WHEN c_custkey % 3 = 1 THEN c_name || ' "' || c_mktsegment ELSE c_name END AS note,
           CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer""")
def _(t):
    path = scratch_path(t.spark, "notes-csv")
    note = F.expr("""case c_custkey % 3 when 0 then c_name || '\n"' || c_mktsegment || '", \n\nx'
                     when 1 then c_name || ' "' || c_mktsegment else c_name end""")
    save_csv(t.customer.select("c_custkey", note.alias("note"), F.expr("if(c_custkey % 4 = 0, null, c_acctbal)").alias("c_acctbal")), path)
    return load_csv(t.spark, path)


@query("save_csv", """
    SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal,
           CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def _(t):
    path = scratch_path(t.spark, "customer-csv")
    save_csv(t.customer.withColumn("c_mktsegment", F.expr("if(c_custkey % 5 = 0, null, c_mktsegment)")), path)
    return load_csv(t.spark, path)


@query("load_parquet", "SELECT * FROM part")
def _(t):
    return load_parquet(t.spark, f"{t.folder}/part.parquet")


@query("list_dataframes", """
    SELECT 'lineitem' AS name, (SELECT count(*) FROM lineitem) AS n_rows, 11::BIGINT AS n_cols UNION ALL
    SELECT 'orders', (SELECT count(*) FROM orders), 6 UNION ALL
    SELECT 'events', (SELECT count(*) FROM events), 6""")
def _(t):
    return table_shapes({n: getattr(t, n) for n in ("lineitem", "orders", "events")})


@query("get_head", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def _(t):
    return get_head(t.orders, ["o_orderdate", "o_orderkey"], 20)


@query("get_tail", """
    SELECT * FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)
    ORDER BY o_orderdate, o_orderkey""")
def _(t):
    return get_tail(t.orders, ["o_orderdate", "o_orderkey"], 20)


@query("sample_data")
def _(t):
    return sample_data(t.orders, 100, key=["o_orderkey"])


# --- joins and reshaping ----------------------------------------------------

_JOIN_LEFT = """
    (SELECT l_orderkey AS k, l_linenumber AS line, l_quantity AS amount FROM lineitem)"""
_JOIN_RIGHT = """
    (SELECT o_orderkey + 1000 AS k, o_totalprice AS amount, o_orderpriority AS priority FROM orders)"""


def _lines(t):
    return t.lineitem.selectExpr("l_orderkey as k", "l_linenumber as line", "l_quantity as amount")


def _orders(t):
    """All orders; shifted keys leave rows without a partner on both sides."""
    return t.orders.selectExpr("o_orderkey + 1000 as k", "o_totalprice as amount", "o_orderpriority as priority")


@query("merge_inner", f"""
    SELECT l.k, l.line, l.amount AS amount_x, r.amount AS amount_y, r.priority
    FROM {_JOIN_LEFT} l JOIN {_JOIN_RIGHT} r ON l.k = r.k""")
def _(t):
    return merge_dataframes(_lines(t), _orders(t), ["k"], "inner")


@query("merge_left", f"""
    SELECT l.k, l.line, l.amount AS amount_x, r.amount AS amount_y, r.priority
    FROM {_JOIN_LEFT} l LEFT JOIN {_JOIN_RIGHT} r ON l.k = r.k""")
def _(t):
    return merge_dataframes(_lines(t), _orders(t), ["k"], "left")


@query("merge_right", f"""
    SELECT r.k, l.line, l.amount AS amount_x, r.amount AS amount_y, r.priority
    FROM {_JOIN_LEFT} l RIGHT JOIN {_JOIN_RIGHT} r ON l.k = r.k""")
def _(t):
    return merge_dataframes(_lines(t), _orders(t), ["k"], "right")


@query("merge_outer", f"""
    SELECT coalesce(l.k, r.k) AS k, l.line, l.amount AS amount_x, r.amount AS amount_y, r.priority
    FROM {_JOIN_LEFT} l FULL JOIN {_JOIN_RIGHT} r ON l.k = r.k""")
def _(t):
    return merge_dataframes(_lines(t), _orders(t), ["k"], "outer")


@query("merge_null_keys", """
    WITH n AS (SELECT CASE WHEN n_nationkey = 3 THEN NULL ELSE n_nationkey END AS nk, n_name FROM nation),
         c AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS nk, c_custkey FROM customer)
    SELECT coalesce(c.nk, n.nk) AS nk, c.c_custkey, n.n_name
    FROM c FULL JOIN n ON c.nk IS NOT DISTINCT FROM n.nk""")
def _(t):
    nations = t.nation.selectExpr("if(n_nationkey = 3, null, n_nationkey) as nk", "n_name")
    customers = t.customer.selectExpr("if(c_custkey % 11 = 0, null, c_nationkey) as nk", "c_custkey")
    return merge_dataframes(customers, nations, ["nk"], "outer")


@query("pivot_mean", """
    SELECT l_shipmode_year AS ship_year,
           round(avg(l_extendedprice) FILTER (l_returnflag = 'A'), 2) AS "A",
           round(avg(l_extendedprice) FILTER (l_returnflag = 'N'), 2) AS "N",
           round(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS "R"
    FROM (SELECT year(l_shipdate)::INTEGER AS l_shipmode_year, * FROM lineitem) GROUP BY 1""")
def _(t):
    years = t.lineitem.withColumn("ship_year", F.year("l_shipdate"))
    return rounded(pivot_table(years, ["ship_year"], "l_returnflag", "l_extendedprice"), 2)


@query("pivot_median", """
    SELECT o_orderpriority,
           round(median(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS "F",
           round(median(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS "O",
           round(median(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS "P"
    FROM orders GROUP BY 1""")
def _(t):
    return rounded(pivot_table(t.orders, ["o_orderpriority"], "o_orderstatus", "o_totalprice", "median",
                               ["F", "O", "P"]))


@query("pivot_sum", """
    SELECT l_linestatus, l_linenumber, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS "A",
           round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS "N",
           round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS "R"
    FROM lineitem GROUP BY 1, 2""")
def _(t):
    return rounded(pivot_table(t.lineitem, ["l_linestatus", "l_linenumber"], "l_returnflag", "l_quantity", "sum"), 2)


@query("melt_dataframe", """
    SELECT l_orderkey, l_linenumber, variable, value FROM (
        SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL
        SELECT l_orderkey, l_linenumber, 'l_discount', CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END
        FROM lineitem UNION ALL
        SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem)""")
def _(t):
    rows = t.lineitem.withColumn("l_discount", F.expr("if(l_orderkey % 7 = 0, null, l_discount)"))
    return melt_dataframe(rows, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("melt_mixed_types", """
    SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS content FROM customer UNION ALL
    SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR FROM customer""")
def _(t):
    return melt_dataframe(t.customer, ["c_custkey"], ["c_mktsegment", "c_nationkey"], "field", "content")


@query("concat_rows", """
    SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL
    SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""")
def _(t):
    suppliers = t.supplier.selectExpr("s_suppkey as key", "s_name as name", "s_acctbal as balance")
    customers = t.customer.selectExpr("c_custkey as key", "c_name as name", "c_acctbal as balance",
                                      "c_mktsegment as segment")
    return concat_dataframes([suppliers, customers])


@query("concat_columns", """
    WITH a AS (SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS i, s_suppkey, s_acctbal FROM supplier),
         b AS (SELECT row_number() OVER (ORDER BY c_custkey DESC) AS i, c_custkey, c_name FROM customer)
    SELECT s_suppkey, s_acctbal, c_custkey, c_name FROM a FULL JOIN b ON a.i = b.i""")
def _(t):
    suppliers = t.supplier.select("s_suppkey", "s_acctbal")
    customers = t.customer.select("c_custkey", "c_name", (-F.col("c_custkey")).alias("_order"))
    return concat_dataframes([suppliers, customers], 1, [["s_acctbal", "s_suppkey"], ["_order"]]).drop("_order")


# --- projection, selection, typing ------------------------------------------

@query("drop_columns", "SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders")
def _(t):
    return drop_columns(t.orders, ["o_totalprice", "o_orderdate"])


@query("rename_columns", "SELECT * RENAME (p_partkey AS id, p_retailprice AS price) FROM part")
def _(t):
    return rename_columns(t.part, {"p_partkey": "id", "p_retailprice": "price"})


@query("select_dtypes_include", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return select_dtypes(t.orders, include=["number"])


@query("select_dtypes_exclude", "SELECT event_id, user_id, value FROM events")
def _(t):
    return select_dtypes(t.events, exclude=["object", "datetime"])


@query("create_column", """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) / (l_quantity + 0.00001), 4) AS unit_price
    FROM lineitem""")
def _(t):
    out = create_column(t.lineitem, "unit_price", "l_extendedprice * (1 - l_discount) / (l_quantity + 1e-5)")
    return rounded(out.select("l_orderkey", "l_linenumber", "unit_price"))


@query("convert_dtype", """
    SELECT o_orderkey::VARCHAR AS o_orderkey, trunc(o_totalprice)::BIGINT AS o_totalprice,
           (o_custkey <> 0) AS o_custkey FROM orders""")
def _(t):
    out = t.orders.select("o_orderkey", "o_totalprice", "o_custkey")
    out = convert_dtype(out, ["o_orderkey"], "str")
    out = convert_dtype(out, ["o_totalprice"], "int")
    return convert_dtype(out, ["o_custkey"], "bool")


@query("convert_dtype_from_text", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 3) END AS number, ts FROM events""")
def _(t):
    text = t.events.selectExpr("event_id", "if(event_id % 3 = 0, 'unknown', string(round(value, 3))) as number",
                               "string(ts) as ts")
    return convert_dtype(convert_dtype(text, ["number"], "float", errors="null"), ["ts"], "datetime")


_COMPARE = {"eq": ("==", "="), "gt": (">", ">"), "lt": ("<", "<"), "ge": (">=", ">="), "le": ("<=", "<=")}
for _name, (_op, _sql_op) in _COMPARE.items():
    @query(f"filter_rows_{_name}", f"""
        SELECT l_orderkey, l_linenumber, d FROM (
            SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS d
            FROM lineitem) WHERE d {_sql_op} 25""")
    def _(t, op=_op):
        rows = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "if(l_orderkey % 7 = 0, null, l_quantity) as d")
        return filter_rows(rows, "d", op, "25")


@query("filter_rows_ne", """
    SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)
    WHERE s IS DISTINCT FROM 'F'""")
def _(t):
    rows = t.orders.selectExpr("o_orderkey", "if(o_orderkey % 7 = 0, null, o_orderstatus) as s")
    return filter_rows(rows, "s", "!=", "F")


@query("filter_rows_contains", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(STANDARD|ECONOMY)')")
def _(t):
    return filter_rows(t.part.select("p_partkey", "p_type"), "p_type", "contains", "^(STANDARD|ECONOMY)")


@query("filter_rows_isin", "SELECT * FROM part WHERE p_size IN (1, 15, 49)")
def _(t):
    return filter_rows(t.part, "p_size", "isin", "1, 15,49")


@query("datetime_filter", """
    SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30'""")
def _(t):
    return datetime_filter(t.orders, "o_orderdate", "1994-01-01", "1996-06-30")


_HOLES = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS a,
            CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS b FROM events"""


def _holes(t):
    return t.events.selectExpr("event_id", "if(event_id % 3 = 0, null, user_id) as a",
                               "if(event_id % 4 = 0, null, value) as b")


@query("drop_missing_any", f"SELECT * FROM ({_HOLES}) WHERE a IS NOT NULL AND b IS NOT NULL")
def _(t):
    return drop_missing(_holes(t), ["a", "b"])


@query("drop_missing_all", f"SELECT * FROM ({_HOLES}) WHERE a IS NOT NULL OR b IS NOT NULL")
def _(t):
    return drop_missing(_holes(t), ["a", "b"], "all")


# --- duplicates, imputation, repair -----------------------------------------

@query("drop_duplicates_all", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return drop_duplicates(t.events.select("user_id", "event_type"))


@query("drop_duplicates_first", """
    SELECT event_id, ts, user_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) = 1""")
def _(t):
    return drop_duplicates(t.events.drop("props"), ["user_id", "event_type"], "first", ["ts"])


@query("drop_duplicates_last", """
    SELECT event_id, ts, user_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1""")
def _(t):
    return drop_duplicates(t.events.drop("props"), ["user_id", "event_type"], "last", ["ts"])


@query("drop_duplicates_none", """
    SELECT event_id, ts, user_id, event_type, value FROM events
    QUALIFY count(*) OVER (PARTITION BY user_id, event_type) = 1""")
def _(t):
    return drop_duplicates(t.events.drop("props"), ["user_id", "event_type"], "none")


@query("fill_missing_value", f"SELECT event_id, coalesce(a, -1) AS a, coalesce(b, -1) AS b FROM ({_HOLES})")
def _(t):
    return fill_missing(_holes(t), ["a", "b"], "value", "-1")


@query("fill_missing_mean", f"""
    SELECT event_id, a, round(coalesce(b, avg(b) OVER ()), 4) AS b FROM ({_HOLES})""")
def _(t):
    return rounded(fill_missing(_holes(t), ["b"], "mean"))


@query("fill_missing_median", f"""
    SELECT event_id, a, round(coalesce(b, (SELECT median(b) FROM ({_HOLES}))), 4) AS b FROM ({_HOLES})""")
def _(t):
    return rounded(fill_missing(_holes(t), ["b"], "median"))


@query("fill_missing_mode", """
    WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS kind,
                      CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id FROM events),
         k AS (SELECT kind FROM e WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
         u AS (SELECT user_id FROM e WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT event_id, coalesce(kind, (SELECT kind FROM k)) AS kind,
           coalesce(user_id, (SELECT user_id FROM u)) AS user_id FROM e""")
def _(t):
    rows = t.events.selectExpr("event_id", "if(event_id % 5 = 0, null, event_type) as kind",
                               "if(event_id % 3 = 0, null, user_id) as user_id")
    return fill_missing(rows, ["kind", "user_id"], "mode")


_GAPS = """SELECT event_id, ts, user_id, CASE WHEN event_id % 3 <> 0 THEN NULL ELSE value END AS v,
           CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END AS kind FROM events"""


def _gaps(t):
    return t.events.selectExpr("event_id", "ts", "user_id", "if(event_id % 3 <> 0, null, value) as v",
                               "if(event_id % 2 = 0, null, event_type) as kind")


for _way, _sql_way in (("ffill", "last_value({x} IGNORE NULLS) OVER ({p} ORDER BY ts, event_id ROWS BETWEEN "
                        "UNBOUNDED PRECEDING AND CURRENT ROW)"),
                       ("bfill", "first_value({x} IGNORE NULLS) OVER ({p} ORDER BY ts, event_id ROWS BETWEEN "
                        "CURRENT ROW AND UNBOUNDED FOLLOWING)")):
    for _suffix, _part, _keys in (("", "", None), ("_by_key", "PARTITION BY user_id", ["user_id"])):
        @query(f"fill_missing_{_way}{_suffix}", f"""
            SELECT event_id, ts, user_id, {_sql_way.format(x='v', p=_part)} AS v,
                   {_sql_way.format(x='kind', p=_part)} AS kind FROM ({_GAPS})""")
        def _(t, way=_way, keys=_keys):
            return fill_missing(_gaps(t), ["v", "kind"], way, order_by=["ts", "event_id"], partition_by=keys)


@query("missing_counts", f"""
    SELECT "column", n_missing FROM (SELECT count(*) - count(a) AS a, count(*) - count(b) AS b FROM ({_HOLES}))
    UNPIVOT (n_missing FOR "column" IN (a, b))""")
def _(t):
    return missing_counts(_holes(t), ["a", "b"])


@query("replace_values", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE o_orderstatus END AS o_orderstatus
    FROM orders""")
def _(t):
    return replace_values(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "P", "PENDING")


@query("replace_values_count", "SELECT count(*) AS n_replaced FROM lineitem WHERE l_discount = 0.05")
def _(t):
    return count_value(t.lineitem, "l_discount", "0.05")


@query("apply_mapping_text", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END
           AS o_orderstatus FROM orders""")
def _(t):
    return apply_mapping(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus",
                         {"F": "finished", "O": "open"})


@query("apply_mapping_number", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END::BIGINT
           AS o_orderstatus FROM orders""")
def _(t):
    return apply_mapping(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus",
                         {"F": "1", "O": "2", "P": "3"})


_BOUNDS_IQR = """(SELECT quantile_cont(l_extendedprice, 0.25) - 0.2 * (quantile_cont(l_extendedprice, 0.75)
    - quantile_cont(l_extendedprice, 0.25)) AS lo, quantile_cont(l_extendedprice, 0.75) + 0.2 *
    (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS hi FROM lineitem)"""
_BOUNDS_Q = """(SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi
    FROM lineitem)"""


@query("clip_outliers_iqr", f"""
    SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 3) AS l_extendedprice
    FROM lineitem, {_BOUNDS_IQR}""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(clip_outliers(rows, "l_extendedprice", iqr_multiplier=0.2), 3)


@query("clip_outliers_quantile", f"""
    SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 3) AS l_extendedprice
    FROM lineitem, {_BOUNDS_Q}""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(clip_outliers(rows, "l_extendedprice", "quantile"), 3)


@query("clip_report", f"""
    SELECT round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound,
           count(*) FILTER (l_extendedprice < lo OR l_extendedprice > hi) AS n_clipped,
           round(min(l_extendedprice), 4) AS min_before, round(max(l_extendedprice), 4) AS max_before,
           round(min(least(greatest(l_extendedprice, lo), hi)), 4) AS min_after,
           round(max(least(greatest(l_extendedprice, lo), hi)), 4) AS max_after
    FROM lineitem, {_BOUNDS_IQR}""")
def _(t):
    return rounded(clip_report(t.lineitem, "l_extendedprice", iqr_multiplier=0.2))


@query("string_clean_strip", "SELECT p_partkey, p_name FROM part")
def _(t):
    padded = t.part.select("p_partkey", F.concat(F.lit(" \t"), "p_name", F.lit("\n ")).alias("p_name"))
    return string_clean(padded, "p_name", ["strip"])


@query("string_clean_lower", "SELECT p_partkey, lower(p_type) AS p_type FROM part")
def _(t):
    return string_clean(t.part.select("p_partkey", "p_type"), "p_type", ["lower"])


@query("string_clean_upper", "SELECT p_partkey, upper(p_name) AS p_name FROM part")
def _(t):
    return string_clean(t.part.select("p_partkey", "p_name"), "p_name", ["upper"])


@query("string_clean_title", """
    SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_type, '([a-zA-Z]+|[^a-zA-Z]+)'),
           lambda w: upper(w[1]) || lower(w[2:])), '') AS p_type FROM part""")
def _(t):
    return string_clean(t.part.select("p_partkey", "p_type"), "p_type", ["title"])


@query("string_clean_replace", "SELECT p_partkey, replace(lower(p_brand), '#', ' no. ') AS p_brand FROM part")
def _(t):
    return string_clean(t.part.select("p_partkey", "p_brand"), "p_brand", ["lower", "replace"], "#", " no. ")


# --- order and row numbers --------------------------------------------------

@query("sort_values", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders
    ORDER BY p DESC NULLS LAST, o_orderkey DESC NULLS LAST""")
def _(t):
    rows = t.orders.selectExpr("o_orderkey", "if(o_orderkey % 7 = 0, null, o_totalprice) as p")
    return sort_values(rows, ["p", "o_orderkey"], ascending=False)


@query("add_row_index", """
    SELECT event_id, user_id, value, (row_number() OVER (ORDER BY value, event_id) + 99)::BIGINT AS row_id
    FROM events""")
def _(t):
    return add_row_index(t.events.select("event_id", "user_id", "value"), ["value", "event_id"], "row_id", 100)


@query("set_datetime_index", "SELECT ts, event_id, user_id, value FROM events ORDER BY ts")
def _(t):
    return set_datetime_index(t.events.select("event_id", "user_id", "ts", "value"), "ts")


@query("datetime_index_range", "SELECT min(ts) AS first_time, max(ts) AS last_time FROM events")
def _(t):
    return datetime_range(t.events, "ts")


# --- date and time ----------------------------------------------------------

@query("extract_datetime_parts", """
    SELECT event_id, ts, year(ts)::INTEGER AS ts_year, month(ts)::INTEGER AS ts_month, day(ts)::INTEGER AS ts_day,
           (isodow(ts) - 1)::INTEGER AS ts_dayofweek, hour(ts)::INTEGER AS ts_hour, minute(ts)::INTEGER AS ts_minute,
           week(ts)::INTEGER AS ts_weekofyear, quarter(ts)::INTEGER AS ts_quarter,
           (isodow(ts) >= 6)::INTEGER AS ts_is_weekend FROM events""")
def _(t):
    return extract_datetime_parts(t.events.select("event_id", "ts"), "ts", [
        "year", "month", "day", "dayofweek", "hour", "minute", "weekofyear", "quarter", "is_weekend"])


@query("extract_datetime_parts_text", """
    SELECT o_orderkey, o_orderdate, year(o_orderdate)::INTEGER AS o_orderdate_year,
           week(o_orderdate)::INTEGER AS o_orderdate_weekofyear,
           CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE (isodow(o_orderdate) >= 6)::INTEGER END AS o_orderdate_is_weekend
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE date_trunc('day', o_orderdate) END
          ::TIMESTAMP AS o_orderdate FROM orders)""")
def _(t):
    text = t.orders.select("o_orderkey", F.expr(
        "if(o_orderkey % 7 = 0, null, date_format(o_orderdate, 'MM/dd/yyyy')) as o_orderdate"))
    return extract_datetime_parts(text, "o_orderdate", ["year", "weekofyear", "is_weekend"])


for _unit, _seconds in (("days", 86400), ("hours", 3600), ("minutes", 60), ("seconds", 1)):
    @query(f"datetime_diff_{_unit}", f"""
        SELECT l_orderkey, l_linenumber,
               round(date_diff('microsecond', o_orderdate, l_shipdate) / 1e6 / {_seconds}, 4) AS lag
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
    def _(t, unit=_unit):
        lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").withColumnRenamed("l_orderkey", "key")
        dates = t.orders.selectExpr("o_orderkey as key", "o_orderdate")
        joined = merge_dataframes(lines, dates, ["key"])
        out = datetime_diff(joined, "l_shipdate", "o_orderdate", "lag", unit)
        return rounded(out.selectExpr("key as l_orderkey", "l_linenumber", "lag"))
