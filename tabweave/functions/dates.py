"""Date and time functions; all times are without time zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.core.checks import as_list, c, is_string, require_choice, require_columns
from tabweave.core.scan import tie_break

# Text layouts tried in this order after the ISO form.
LAYOUTS = ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd.MM.yyyy HH:mm:ss",
           "dd.MM.yyyy", "dd-MM-yyyy", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy")
PARTS = ("year", "month", "day", "dayofweek", "hour", "minute", "weekofyear", "quarter", "is_weekend")
DEFAULT_PARTS = ("year", "month", "day", "dayofweek", "hour")
UNIT_SECONDS = {"days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}


def parse_datetime(df: DataFrame, column: str, strict: bool = False) -> Column:
    """The column as timestamp_ntz; text is parsed by the layouts above.

    strict=True raises on text that fits none of them.
    """
    require_columns(df, [column])
    x = c(column)
    if not is_string(df, column):
        return x if isinstance(df.schema[column].dataType, T.TimestampNTZType) else x.cast("timestamp_ntz")
    text = F.trim(x)
    parsed = F.coalesce(text.try_cast("timestamp_ntz"), *[
        F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in LAYOUTS])
    if strict:
        failed = F.raise_error(F.concat(F.lit("not a date or time: "), text)).cast("timestamp_ntz")
        return F.when(parsed.isNotNull() | x.isNull(), parsed).otherwise(failed)
    return parsed


def extract_datetime_parts(df: DataFrame, column: str, parts: Sequence[str] | None = None) -> DataFrame:
    """New columns ``{column}_{part}``; Monday is day 0, weeks are ISO weeks."""
    wanted = as_list(parts) or list(DEFAULT_PARTS)
    for p in wanted:
        require_choice(p, PARTS, "part")
    t = parse_datetime(df, column)
    build = {"year": F.year, "month": F.month, "day": F.dayofmonth, "dayofweek": F.weekday, "hour": F.hour,
             "minute": F.minute, "weekofyear": F.weekofyear, "quarter": F.quarter,
             "is_weekend": lambda x: F.coalesce((F.weekday(x) >= 5).cast("int"), F.lit(0))}
    out = df.withColumn(column, t) if is_string(df, column) else df
    return out.withColumns({f"{column}_{p}": build[p](c(column)) for p in wanted})


def datetime_diff(df: DataFrame, column_a: str, column_b: str, new_column: str, unit: str = "days") -> DataFrame:
    """Fractional difference a - b in the unit."""
    require_choice(unit, UNIT_SECONDS, "unit")
    a, b = parse_datetime(df, column_a), parse_datetime(df, column_b)
    micros = F.timestamp_diff("MICROSECOND", b, a)
    return df.withColumn(new_column, micros / F.lit(1e6) / F.lit(float(UNIT_SECONDS[unit])))


def datetime_filter(df: DataFrame, column: str, start: str = "", end: str = "") -> DataFrame:
    """Rows within [start, end]; an empty bound is open; a date means midnight."""
    t = parse_datetime(df, column)
    if start:
        df = df.where(t >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(t <= F.lit(end).cast("timestamp_ntz"))
    return df


def set_datetime_index(df: DataFrame, column: str) -> DataFrame:
    """Sort by a time column and put it first; nulls last.

    Ties are spread by the row's content, so that one frequent time does not
    fill one task.
    """
    out = df.withColumn(column, parse_datetime(df, column))
    tied, order = tie_break(out, [c(column).asc_nulls_last()])
    ordered = tied.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select(c(column), *[c(n) for n in df.columns if n != column])


def datetime_range(df: DataFrame, column: str) -> DataFrame:
    t = parse_datetime(df, column)
    return df.agg(F.min(t).alias("first_time"), F.max(t).alias("last_time"))
