"""Categorical encoding.  Lookup tables are joined; one that measures small is
broadcast, so that the rows need no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import as_list, c, require_columns, require_numeric
from tabweave.core.scan import attach_measured, row_numbers
from tabweave.operators.relational import MAX_DISTINCT, distinct_values

# Fixed value: the category size at which the category mean weighs one half.
HALF_WEIGHT_COUNT = 20


def one_hot_encode(df: DataFrame, columns: Sequence[str], drop_first: bool = True,
                   limit: int = MAX_DISTINCT) -> DataFrame:
    """Boolean columns ``{column}_{value}`` in value order in place of the
    source column; null is false everywhere."""
    names = as_list(columns)
    require_columns(df, names)
    dummies = []
    for n in names:
        values = distinct_values(df, n, limit)
        dummies += [F.coalesce(c(n) == F.lit(v), F.lit(False)).alias(f"{n}_{v}")
                    for v in values[1 if drop_first else 0:]]
    return df.select(*[c(n) for n in df.columns if n not in names], *dummies)


def _replace(df: DataFrame, column: str, lookup: DataFrame, value) -> DataFrame:
    """Swap a column for ``value``, an expression on the joined lookup row."""
    joined = attach_measured(df.withColumn("_cat", c(column)), lookup, ["_cat"])
    return joined.select(*[value.alias(n) if n == column else c(n) for n in df.columns])


def target_encode(df: DataFrame, columns: Sequence[str], target_column: str, smoothing: float = 10.0,
                  fit_on: DataFrame | None = None) -> DataFrame:
    """Replace a category by its smoothed mean of the target.

    ``fit_on`` learns the means from a training table, so that the test rows'
    targets do not leak; unseen categories get the overall mean.
    """
    names = as_list(columns)
    train = df if fit_on is None else fit_on
    require_columns(df, names)
    require_columns(train, names)
    require_numeric(train, [target_column])
    y = c(target_column).cast("double")
    prior = train.agg(F.avg(y)).first()[0]
    out = df
    for n in names:
        weight = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_n") - HALF_WEIGHT_COUNT) / F.lit(float(smoothing))))
        lookup = train.groupBy(c(n).alias("_cat")).agg(F.count(y).alias("_n"), F.avg(y).alias("_m")).select(
            "_cat", (F.lit(prior) * (1 - weight) + F.col("_m") * weight).alias("_e"))
        out = _replace(out, n, lookup, F.coalesce(F.col("_e"), F.lit(prior)))
    return out


def label_mapping(df: DataFrame, column: str) -> DataFrame:
    """Category (as text, sorted) and its code 0..k-1."""
    require_columns(df, [column])
    values = df.select(c(column).cast("string").alias("category")).where("category is not null").distinct()
    return row_numbers(values, [F.col("category").asc()], "code")


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace categories by their codes; null stays null."""
    names = as_list(columns)
    require_columns(df, names)
    out = df
    for n in names:
        lookup = label_mapping(df, n).select(F.col("category").alias("_cat"), F.col("code").alias("_e"))
        joined = attach_measured(out.withColumn("_cat", c(n).cast("string")), lookup, ["_cat"])
        out = joined.select(*[F.col("_e").alias(m) if m == n else c(m) for m in df.columns])
    return out


def frequency_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace categories by their share of the non-null rows."""
    names = as_list(columns)
    require_columns(df, names)
    totals = df.agg(*[F.count(c(n)).alias(f"t{i}") for i, n in enumerate(names)]).first()
    out = df
    for i, n in enumerate(names):
        lookup = df.where(c(n).isNotNull()).groupBy(c(n).alias("_cat")).agg(
            (F.count(F.lit(1)) / F.lit(float(totals[f"t{i}"] or 1))).alias("_e"))
        out = _replace(out, n, lookup, F.col("_e"))
    return out
