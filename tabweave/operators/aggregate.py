"""Grouped aggregation and cross-tabulation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import all_present, as_list, c, numeric_columns, present, require_choice, require_columns, require_numeric
from tabweave.core.quantile import SMALL_DISTINCT, grouped_stats
from tabweave.operators.relational import AGGREGATES, MAX_DISTINCT, distinct_values, plain_aggregate


def group_aggregate_multi(df: DataFrame, group_by: Sequence[str], aggregations: Mapping[str, Sequence[str]],
                          keep_null_groups: bool = False, small: int = SMALL_DISTINCT) -> DataFrame:
    """Many aggregates in one pass, named ``{column}_{function}``.

    Rows with a null key drop unless asked for.
    """
    keys = as_list(group_by)
    require_columns(df, [*keys, *aggregations])
    pairs = [(n, f) for n, fs in aggregations.items() for f in as_list(fs)]
    for n, f in pairs:
        require_choice(f, AGGREGATES, "aggregate")
        if f in ("mean", "sum", "median", "std"):
            require_numeric(df, [n])
    rows = df.select(*map(c, dict.fromkeys([*keys, *aggregations])))
    if not keep_null_groups:
        rows = rows.where(all_present(rows, keys))
    medians = {n: [0.5] for n, f in pairs if f == "median"}
    plain = [plain_aggregate(f, c(n)).alias(f"{n}_{f}") for n, f in pairs if f != "median"]
    out = grouped_stats(rows, keys, plain, medians, small)
    return out.select(*map(c, keys), *[
        c(f"q_{n}")[0].alias(f"{n}_median") if f == "median" else c(f"{n}_{f}") for n, f in pairs])


def group_aggregate(df: DataFrame, group_by: Sequence[str], agg_column: str, agg_func: str = "mean",
                    keep_null_groups: bool = False) -> DataFrame:
    """One aggregate per group, the largest first."""
    out = group_aggregate_multi(df, group_by, {agg_column: [agg_func]}, keep_null_groups)
    return out.orderBy(c(f"{agg_column}_{agg_func}").desc_nulls_last(), *map(c, as_list(group_by)))


DESCRIBED = ("count", "mean", "median", "std", "min", "max")


def describe_by_group(df: DataFrame, group_column: str, numeric: Sequence[str] | None = None,
                      small: int = SMALL_DISTINCT) -> DataFrame:
    """One row per group and column: count, mean, median, std, min, max."""
    require_columns(df, [group_column])
    names = as_list(numeric) or numeric_columns(df, [group_column])
    require_numeric(df, names)
    if not names:
        raise ValueError("no numeric columns")
    rows = df.select(c(group_column), *[c(n) for n in names if n != group_column]).where(present(df, group_column))
    exprs = []
    for i, n in enumerate(names):
        x = c(n).cast("double")
        exprs += [F.count(x).alias(f"count_{i}"), F.avg(x).alias(f"mean_{i}"),
                  F.stddev_samp(x).alias(f"std_{i}"), F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}")]
    wide = grouped_stats(rows, [group_column], exprs, {n: [0.5] for n in names}, small)

    def stat(i: int, n: str, s: str) -> Column:
        if s == "count":
            return F.col(f"count_{i}")
        x = c(f"q_{n}")[0] if s == "median" else F.col(f"{s}_{i}")
        return F.round(x, 4)

    packed = F.array(*[F.struct(F.lit(n).alias("column"), *[stat(i, n, s).alias(s) for s in DESCRIBED])
                       for i, n in enumerate(names)])
    return wide.select(c(group_column), F.inline(packed))


def crosstab(df: DataFrame, index_col: str, columns_col: str, normalize: bool = False,
             column_values: Sequence | None = None, max_columns: int = MAX_DISTINCT) -> DataFrame:
    """Counts of value pairs, absent pairs 0; as % of all pairs on request."""
    require_columns(df, [index_col, columns_col])
    pairs = df.select(c(index_col).alias("_a"), c(columns_col).alias("_b")).dropna()
    names = list(column_values) if column_values is not None else distinct_values(pairs, "_b", max_columns)
    counts = pairs.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    wide = counts.groupBy("_a").pivot("_b", names).agg(F.first("_n"))
    cells = {str(v): F.coalesce(c(str(v)), F.lit(0)) for v in names}
    if not normalize:
        return wide.select(F.col("_a").alias(index_col), *[x.alias(n) for n, x in cells.items()])
    total = pairs.count()
    return wide.select(F.col("_a").alias(index_col), *[
        (F.round(x / F.lit(float(total or 1)), 4) * 100).alias(n) for n, x in cells.items()])
