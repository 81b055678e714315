"""Column selection, typing and value repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.core.checks import (as_list, c, is_datetime, is_numeric, is_string, literal_for,
                                  require_choice, require_columns, require_numeric)
from tabweave.core.quantile import quantile_values
from tabweave.core.scan import attach_measured
from tabweave.functions.dates import parse_datetime
from tabweave.sources.files import NUMBER

TYPE_CLASSES = ("number", "object", "bool", "datetime", "category")
DTYPES = {"int": "bigint", "float": "double", "str": "string", "category": "string",
          "datetime": "timestamp_ntz", "bool": "boolean"}
# Above this a mapping is a join, not an expression.
MAP_LIMIT = 1000


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, as_list(columns))
    return df.drop(*as_list(columns))


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    require_columns(df, mapping)
    return df.select(*[c(n).alias(mapping.get(n, n)) for n in df.columns])


def _type_class(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "object"


def select_dtypes(df: DataFrame, include: Sequence[str] | None = None,
                  exclude: Sequence[str] | None = None) -> DataFrame:
    """Keep columns by type class; 'category' is text here."""
    include, exclude = as_list(include), as_list(exclude)
    if not include and not exclude:
        raise ValueError("give include or exclude")
    for kind in [*include, *exclude]:
        require_choice(kind, TYPE_CLASSES, "type class")
    plain = lambda kinds: {"object" if k == "category" else k for k in kinds}
    both = plain(include) & plain(exclude)
    if both:
        raise ValueError(f"type classes both included and excluded: {sorted(both)}")
    kept = [f.name for f in df.schema.fields
            if (not include or _type_class(f.dataType) in plain(include))
            and _type_class(f.dataType) not in plain(exclude)]
    return df.select(*map(c, kept))


def create_column(df: DataFrame, new_column: str, expression: str) -> DataFrame:
    """A computed column from a Spark SQL expression."""
    return df.withColumn(new_column, F.expr(expression))


def convert_dtype(df: DataFrame, columns: Sequence[str], dtype: str, errors: str = "raise") -> DataFrame:
    """Change column types; errors='null' turns uncastable values into null."""
    names = as_list(columns)
    require_columns(df, names)
    require_choice(dtype, DTYPES, "dtype")
    require_choice(errors, ("raise", "null"), "errors")

    def convert(n: str) -> Column:
        x = c(n)
        if dtype == "datetime":
            return parse_datetime(df, n, strict=errors == "raise")
        if dtype == "bool" and isinstance(df.schema[n].dataType, (T.FloatType, T.DoubleType)):
            return x != 0
        if dtype == "int" and is_string(df, n):
            x = F.trim(x)
        if errors == "raise":
            return x.cast(DTYPES[dtype])
        if dtype in ("int", "float") and is_string(df, n):
            x = F.when(F.trim(x).rlike(NUMBER), F.trim(x))
        return x.try_cast(DTYPES[dtype])

    return df.select(*[convert(n).alias(n) if n in names else c(n) for n in df.columns])


def replace_values(df: DataFrame, column: str, old_value, new_value) -> DataFrame:
    """Swap one exact value; both are read in the column's type."""
    require_columns(df, [column])
    old, new = literal_for(df, column, old_value), literal_for(df, column, new_value)
    return df.withColumn(column, F.when(c(column) == old, new).otherwise(c(column)))


def count_value(df: DataFrame, column: str, value) -> DataFrame:
    """How many rows ``replace_values`` would change."""
    require_columns(df, [column])
    return df.agg(F.count_if(c(column) == literal_for(df, column, value)).alias("n_replaced"))


def _number(text) -> float | int | None:
    if isinstance(text, bool):
        return None
    if isinstance(text, (int, float)):
        return text
    try:
        return float(text) if "." in text else int(text)
    except (TypeError, ValueError):
        return None


def apply_mapping(df: DataFrame, column: str, mapping: Mapping) -> DataFrame:
    """Dictionary lookup; values without a rule stay.

    The column turns numeric when every rule gives a number and either the
    column is numeric already or every value in it has a rule; otherwise it
    keeps its type, or becomes text.
    """
    require_columns(df, [column])
    if not mapping:
        return df
    numbers = {k: _number(v) for k, v in mapping.items()}
    all_numbers = all(v is not None for v in numbers.values())
    numeric_column = is_numeric(df, column)
    key_type = df.schema[column].dataType
    numeric = all_numbers
    if all_numbers and not numeric_column:
        rest = df.select(c(column).cast("string").alias("_rule")).where("_rule is not null")
        known = df.sparkSession.createDataFrame([(str(k),) for k in mapping], "_rule string")
        numeric = rest.join(known, "_rule", "left_anti").isEmpty()
    if numeric:
        whole = all(isinstance(v, int) for v in numbers.values())
        if numeric_column:
            whole = whole and isinstance(key_type, T.IntegralType)
        target = "bigint" if whole else "double"
        pairs = [(k, float(v) if target == "double" else v) for k, v in numbers.items()]
    else:
        target = "string"
        pairs = [(k, str(v)) for k, v in mapping.items()]
    keys = [float(k) if numeric_column else str(k) for k, _ in pairs]
    probe = c(column).cast("double" if numeric_column else "string")
    fallback = c(column).cast(target) if not (numeric and not numeric_column) else F.lit(None).cast(target)
    if len(pairs) <= MAP_LIMIT:
        table = F.create_map(*[x for k, (_, v) in zip(keys, pairs) for x in (F.lit(k), F.lit(v).cast(target))])
        return df.withColumn(column, F.coalesce(F.try_element_at(table, probe), fallback))
    rules = df.sparkSession.createDataFrame(
        [(k, v) for k, (_, v) in zip(keys, pairs)],
        f"_rule {'double' if numeric_column else 'string'}, _to {target}")
    joined = attach_measured(df.withColumn("_rule", probe), rules, ["_rule"])
    return joined.select(*[F.coalesce(F.col("_to"), fallback).alias(n) if n == column else c(n)
                           for n in df.columns])


def clip_bounds(df: DataFrame, column: str, method: str = "iqr", lower_quantile: float = 0.01,
                upper_quantile: float = 0.99, iqr_multiplier: float = 1.5) -> tuple[float, float] | None:
    """The two limits, or None for a column without values."""
    require_numeric(df, [column])
    require_choice(method, ("iqr", "quantile"), "method")
    probs = [0.25, 0.75] if method == "iqr" else [lower_quantile, upper_quantile]
    found = quantile_values(df, {column: probs})[column]
    if found is None:
        return None
    low, high = found
    if method == "iqr":
        reach = iqr_multiplier * (high - low)
        low, high = low - reach, high + reach
    return low, high


def clip_outliers(df: DataFrame, column: str, method: str = "iqr", lower_quantile: float = 0.01,
                  upper_quantile: float = 0.99, iqr_multiplier: float = 1.5) -> DataFrame:
    """Pull values outside the limits back to the limits; nulls stay."""
    bounds = clip_bounds(df, column, method, lower_quantile, upper_quantile, iqr_multiplier)
    if bounds is None:
        return df
    x = c(column).cast("double")
    low, high = F.lit(bounds[0]), F.lit(bounds[1])
    return df.withColumn(column, F.when(x < low, low).when(x > high, high).otherwise(x))


def clip_report(df: DataFrame, column: str, method: str = "iqr", lower_quantile: float = 0.01,
                upper_quantile: float = 0.99, iqr_multiplier: float = 1.5) -> DataFrame:
    """Limits, number of clipped values and the range before and after."""
    bounds = clip_bounds(df, column, method, lower_quantile, upper_quantile, iqr_multiplier)
    low, high = [F.lit(b).cast("double") for b in (bounds or (None, None))]
    x = c(column).cast("double")
    clipped = F.when(x < low, low).when(x > high, high).otherwise(x)
    return df.agg(low.alias("lower_bound"), high.alias("upper_bound"),
                  F.count_if((x < low) | (x > high)).alias("n_clipped"),
                  F.min(x).alias("min_before"), F.max(x).alias("max_before"),
                  F.min(clipped).alias("min_after"), F.max(clipped).alias("max_after"))


STRING_OPERATIONS = ("strip", "lower", "upper", "title", "replace")


def string_clean(df: DataFrame, column: str, operations: Sequence[str] | None = None,
                 replace_old: str = "", replace_new: str = "") -> DataFrame:
    """Text operations in the given order; null stays null."""
    require_columns(df, [column])
    x = c(column).cast("string")
    for op in as_list(operations) or ["strip"]:
        require_choice(op, STRING_OPERATIONS, "operation")
        if op == "strip":
            # all white space, not only blanks
            x = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
        elif op == "lower":
            x = F.lower(x)
        elif op == "upper":
            x = F.upper(x)
        elif op == "title":
            # a capital after every non-letter, so split at letter borders first
            runs = F.regexp_extract_all(x, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
            x = F.when(x.isNotNull(), F.array_join(F.transform(runs, F.initcap), ""))
        elif replace_old:
            x = F.replace(x, F.lit(replace_old), F.lit(replace_new))
    return df.withColumn(column, x)


