"""Imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabweave.core.checks import as_list, c, is_numeric, literal_for, require_choice, require_columns
from tabweave.core.quantile import quantile_values
from tabweave.core.scan import carry_forward
from tabweave.operators.rows import sort_columns

STRATEGIES = ("value", "mean", "median", "mode", "ffill", "bfill")
# rows of one key a single task may sort for a plain window
SMALL_GROUP = 5_000_000


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict:
    """The most frequent non-null value per column, the smallest of ties.

    Counts combine map-side; the winner is one more aggregate, not a sort.
    """
    found = {}
    for n in columns:
        counts = df.where(c(n).isNotNull()).groupBy(c(n).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        best = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("best")).first()["best"]
        found[n] = best["v"] if best is not None else None
    return found


def fill_missing(df: DataFrame, columns: Sequence[str] | None = None, strategy: str = "value", value=None,
                 order_by: Sequence[str] | None = None, partition_by: Sequence[str] | None = None,
                 small_group: int = SMALL_GROUP) -> DataFrame:
    """Fill nulls by a literal, the mean, the median, the mode, or the
    neighbouring row in ``order_by`` (optionally inside ``partition_by``).

    mean and median skip columns that are not numeric.
    """
    require_choice(strategy, STRATEGIES, "strategy")
    names = as_list(columns) or list(df.columns)
    require_columns(df, names)
    if strategy == "value":
        if value is None:
            raise ValueError("strategy 'value' needs a value")
        if not as_list(columns):  # all columns: those the value fits
            names = [n for n in names if not is_numeric(df, n) or _fits(value)]
        fills = {n: literal_for(df, n, value) for n in names}
    elif strategy == "mean":
        names = [n for n in names if is_numeric(df, n)]
        row = df.agg(*[F.avg(c(n)).alias(f"m{i}") for i, n in enumerate(names)]).first() if names else []
        fills = {n: F.lit(row[f"m{i}"]) for i, n in enumerate(names)}
    elif strategy == "median":
        names = [n for n in names if is_numeric(df, n)]
        medians = quantile_values(df, {n: [0.5] for n in names}) if names else {}
        fills = {n: F.lit(medians[n][0] if medians[n] else None) for n in names}
    elif strategy == "mode":
        fills = {n: F.lit(v) for n, v in most_frequent(df, names).items()}
    else:
        return _fill_ordered(df, names, strategy, as_list(order_by), as_list(partition_by), small_group)
    return df.select(*[F.coalesce(c(n), fills[n]).alias(n) if n in fills else c(n) for n in df.columns])


def _fits(value) -> bool:
    try:
        float(value)
        return True
    except (TypeError, ValueError):
        return False


def _fill_ordered(df, names, strategy, order_by, partition_by, small_group):
    if not order_by:
        raise ValueError(f"strategy '{strategy}' needs order_by")
    require_columns(df, [*order_by, *partition_by])
    order = (sort_columns(order_by) if strategy == "ffill"
             else [c(n).desc_nulls_first() for n in order_by])
    if partition_by:
        largest = df.groupBy(*map(c, partition_by)).count().agg(F.max("count")).first()[0]
        if (largest or 0) <= small_group:
            seen = Window.partitionBy(*map(c, partition_by)).orderBy(*order).rowsBetween(
                Window.unboundedPreceding, Window.currentRow)
            return df.select(*[F.last(c(n), ignorenulls=True).over(seen).alias(n) if n in names else c(n)
                               for n in df.columns])
    # the whole table, or a key too large for one task: slots and carried values
    return carry_forward(df, names, order, partition_by)


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Column and number of nulls, one row per column."""
    names = as_list(columns) or list(df.columns)
    require_columns(df, names)
    wide = df.agg(*[F.count_if(c(n).isNull()).alias(n) for n in names])
    return wide.unpivot([], [c(n) for n in names], "column", "n_missing")
