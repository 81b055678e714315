"""Argument checks that read only the schema (no Spark job)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def c(name: str) -> Column:
    """Column by exact name, safe for names holding dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns}")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.VarcharType, T.CharType))


def is_datetime(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def require_numeric(df: DataFrame, names: Iterable[str]) -> None:
    names = list(names)
    require_columns(df, names)
    bad = [n for n in names if not is_numeric(df, n)]
    if bad:
        raise ValueError(f"columns are not numeric: {bad}")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns, booleans left out, in schema order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def require_choice(value: str, allowed: Iterable[str], what: str) -> None:
    allowed = list(allowed)
    if value not in allowed:
        raise ValueError(f"unknown {what} '{value}'; use one of {allowed}")


def as_list(value) -> list:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def number_for(name: str, value) -> Decimal | float:
    """The exact number a value stands for; a double where it is not finite."""
    if hasattr(value, "item"):  # a numpy scalar
        value = value.item()
    try:
        # a float stands for the shortest decimal that reads back as it
        exact = Decimal(repr(value)) if isinstance(value, float) else Decimal(int(value) if isinstance(value, bool) else value)
    except (InvalidOperation, TypeError, ValueError):
        raise ValueError(f"'{value}' is not a number, but column '{name}' is numeric") from None
    return exact if exact.is_finite() else float(exact)


def _holds(kind: T.DataType, whole: int) -> bool:
    bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(kind)]
    return -(1 << bits) <= whole < 1 << bits


def literal_for(df: DataFrame, name: str, value) -> Column:
    """A literal in the column's own type.

    A number that an integer column cannot hold, being fractional or too
    large, stays what it is.
    """
    kind = df.schema[name].dataType
    if value is None:
        return F.lit(None)
    if not isinstance(kind, T.NumericType):
        return F.lit(value).cast(kind)
    number = number_for(name, value)
    if isinstance(number, float):
        return F.lit(number)
    if isinstance(kind, T.IntegralType):
        if number == number.to_integral_value():
            whole = int(number)
            return F.lit(whole).cast(kind) if _holds(kind, whole) else F.lit(Decimal(whole))
        return F.lit(float(number))
    if isinstance(kind, T.DecimalType):
        return F.lit(number)
    return F.lit(float(number))


def present(df: DataFrame, name: str) -> Column:
    """Neither null nor NaN."""
    known = c(name).isNotNull()
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        known = known & ~F.isnan(c(name))
    return known


def all_present(df: DataFrame, names: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [present(df, n) for n in names], F.lit(True))


def without_nan(x: Column) -> Column:
    """A number as a double, NaN as null."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)
