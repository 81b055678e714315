"""Joins, reshaping and concatenation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.core.checks import all_present, as_list, c, is_numeric, require_choice, require_columns, require_numeric
from tabweave.core.quantile import grouped_stats
from tabweave.core.scan import attach, row_numbers

JOIN_TYPES = ("inner", "left", "right", "outer")
AGGREGATES = ("mean", "sum", "count", "min", "max", "median", "std")
MAX_DISTINCT = 1000


def merge_dataframes(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys; a null key matches a null key.

    Other columns the two sides share get the suffixes ``_x`` and ``_y``.  The
    join strategy and the splitting of hot keys are left to adaptive execution.
    Of an outer join only the side that is kept whole can be split at run time,
    so it is written as an inner join plus the rows without a partner, which
    an anti join with the other side's distinct keys finds.
    """
    on = as_list(on)
    require_choice(how, JOIN_TYPES, "join type")
    if not on:
        raise ValueError("at least one join key is needed")
    require_columns(left, on)
    require_columns(right, on)
    shared = (set(left.columns) & set(right.columns)) - set(on)
    left_others = [n for n in left.columns if n not in on]
    right_others = [n for n in right.columns if n not in on]

    def keyed(df: DataFrame, side: str, names: Sequence[str]) -> DataFrame:
        return df.select(*[c(k).alias(f"_{side}{i}") for i, k in enumerate(on)],
                         *[c(n).alias(f"_{side}v{i}") for i, n in enumerate(names)])

    a, b = keyed(left, "l", left_others), keyed(right, "r", right_others)
    match = reduce(lambda p, q: p & q,
                   [F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}")) for i in range(len(on))])

    def output(df: DataFrame, key_side: str, has_left: bool = True) -> DataFrame:
        left_position = {n: i for i, n in enumerate(left_others)}
        cols = []
        for n in left.columns:
            if n in on:
                cols.append(F.col(f"_{key_side}{on.index(n)}").alias(n))
                continue
            value = F.col(f"_lv{left_position[n]}") if has_left else F.lit(None).cast(left.schema[n].dataType)
            cols.append(value.alias(f"{n}_x" if n in shared else n))
        cols += [F.col(f"_rv{i}").alias(f"{n}_y" if n in shared else n) for i, n in enumerate(right_others)]
        return df.select(*cols)

    # both sides of an inner join can be split; keys without a partner combine before the shuffle
    out = output(a.join(b, match, "inner"), "l")
    if how in ("left", "outer"):
        right_keys = b.select(*[f"_r{i}" for i in range(len(on))]).distinct()
        alone = a.join(right_keys, match, "left_anti")
        out = out.unionByName(output(alone.select("*", *[
            F.lit(None).cast(right.schema[n].dataType).alias(f"_rv{i}") for i, n in enumerate(right_others)]), "l"))
    if how in ("right", "outer"):
        left_keys = a.select(*[f"_l{i}" for i in range(len(on))]).distinct()
        out = out.unionByName(output(b.join(left_keys, match, "left_anti"), "r", has_left=False))
    return out


def distinct_values(df: DataFrame, column: str, limit: int = MAX_DISTINCT) -> list:
    """The sorted non-null values of a low-cardinality column, needed where
    values turn into columns; more than ``limit`` is an error, never a cut."""
    rows = df.select(c(column).alias("v")).where("v is not null").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"column '{column}' has more than {limit} distinct values")
    return sorted(r.v for r in rows)


def plain_aggregate(name: str, x: Column) -> Column:
    """The aggregates that combine map-side; the median is handled apart."""
    require_choice(name, [a for a in AGGREGATES if a != "median"], "aggregate")
    return {"mean": lambda: F.avg(x), "sum": lambda: F.coalesce(F.sum(x), F.lit(0)),
            "count": lambda: F.count(x), "min": lambda: F.min(x), "max": lambda: F.max(x),
            "std": lambda: F.stddev_samp(x)}[name]()


def pivot_table(df: DataFrame, index: Sequence[str], columns: str, values: str,
                agg_func: str = "mean", column_values: Sequence | None = None,
                max_columns: int = MAX_DISTINCT) -> DataFrame:
    """Long to wide with aggregation; null keys drop, absent cells are null.

    ``column_values`` spares the job that looks for the distinct values, of
    which more than ``max_columns`` are an error.
    """
    index = as_list(index)
    require_columns(df, [*index, columns, values])
    require_choice(agg_func, AGGREGATES, "aggregate")
    if agg_func in ("mean", "sum", "median", "std"):
        require_numeric(df, [values])
    keys = [*index, columns]
    rows = df.select(*[c(n) for n in dict.fromkeys([*keys, values])]).where(all_present(df, keys))
    names = list(column_values) if column_values is not None else distinct_values(rows, columns, max_columns)
    if agg_func == "median":
        long = grouped_stats(rows, keys, [], {values: [0.5]}).select(
            *map(c, keys), c(f"q_{values}")[0].alias("_cell"))
    else:
        long = rows.groupBy(*map(c, keys)).agg(plain_aggregate(agg_func, c(values)).alias("_cell"))
    if agg_func not in ("count", "sum"):
        long = long.where("_cell is not null")
    wide = long.groupBy(*map(c, index)).pivot(columns, names).agg(F.first("_cell"))
    return wide


def melt_dataframe(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str] | None = None,
                   var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Wide to long, null values kept; mixed types meet as text, mixed numbers
    as doubles."""
    id_vars = as_list(id_vars)
    names = as_list(value_vars) or [n for n in df.columns if n not in id_vars]
    require_columns(df, [*id_vars, *names])
    types = {df.schema[n].dataType.simpleString() for n in names}
    if len(types) > 1:
        target = "double" if all(is_numeric(df, n) for n in names) else "string"
        df = df.select(*map(c, id_vars), *[c(n).cast(target).alias(n) for n in names])
    return df.unpivot([c(n) for n in id_vars], [c(n) for n in names], var_name, value_name)


def concat_dataframes(frames: Sequence[DataFrame], axis: int = 0,
                      order_by: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """axis 0: union by name, missing columns null.  axis 1: side by side by
    row position, each table in its own ``order_by``."""
    if not frames:
        raise ValueError("no tables given")
    if axis == 0:
        aligned = _align_types(list(frames))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)
    if axis != 1:
        raise ValueError("axis must be 0 or 1")
    if order_by is None or len(order_by) != len(frames):
        raise ValueError("side-by-side needs an order for each table")
    out, taken = None, []
    for df, order in zip(frames, order_by):
        require_columns(df, as_list(order))
        numbered = row_numbers(df, [c(n).asc_nulls_last() for n in as_list(order)], "_row")
        renames = {}
        for n in df.columns:
            new, k = n, 0
            while new in taken:
                k += 1
                new = f"{n}_{k}"
            renames[n] = new
            taken.append(new)
        numbered = numbered.select("_row", *[c(n).alias(renames[n]) for n in df.columns])
        out = numbered if out is None else out.join(numbered, "_row", "full")
    return out.drop("_row")


def _align_types(frames: list[DataFrame]) -> list[DataFrame]:
    """Columns of the same name but different type meet as double or text."""
    kinds: dict[str, list] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds.setdefault(f.name, []).append(f.dataType)
    target = {}
    for name, types in kinds.items():
        if len({t.simpleString() for t in types}) == 1:
            continue
        if all(isinstance(t, T.IntegralType) for t in types):
            target[name] = "bigint"
        elif all(isinstance(t, T.NumericType) for t in types):
            target[name] = "double"
        elif all(isinstance(t, (T.TimestampNTZType, T.TimestampType, T.DateType)) for t in types):
            target[name] = "timestamp_ntz"
        else:
            target[name] = "string"
    return [df.select(*[c(n).cast(target[n]).alias(n) if n in target else c(n) for n in df.columns])
            for df in frames]
