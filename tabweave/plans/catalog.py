"""The registry of checked queries: a Spark function and, where SQL can say
the same, the SQL text for it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.core.numeric import _CENTRE, _FLANK, _TAIL
from tabweave.sources.files import load_parquet


class Tables:
    """The tables of a folder, each read when it is asked for.  They hold nulls
    but no NaN, so their filters can be pushed down."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return load_parquet(self.spark, f"{self.folder}/{name}.parquet", nan_as_null=False)


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query '{name}' is registered twice")
        ENTRIES[name] = Entry(build, sql)
        return build
    return register


def rounded(df: DataFrame, digits: int = 4, names: list[str] | None = None) -> DataFrame:
    """Round the floating columns (or the named ones)."""
    floating = [n for n, t in df.dtypes if t in ("double", "float")] if names is None else names
    return df.select(*[F.round(c(n), digits).alias(n) if n in floating else c(n) for n in df.columns])


def _ratio_sql(x: str, coefficients) -> str:
    def polynomial(ks) -> str:
        text = repr(ks[-1])
        for k in ks[-2::-1]:
            text = f"(({text}) * {x} + {k!r})"
        return text
    return f"({polynomial(coefficients[0])} / {polynomial(coefficients[1])})"


def normal_quantile_sql(source: str) -> str:
    """The rows of a relation with ``m``, the normal quantile of their ``p``."""
    return f"""(SELECT *, CASE WHEN abs(q) <= 0.425 THEN q * {_ratio_sql('(0.180625 - q * q)', _CENTRE)}
        ELSE sign(q) * CASE WHEN r <= 5 THEN {_ratio_sql('(r - 1.6)', _FLANK)} ELSE {_ratio_sql('(r - 5)', _TAIL)} END END AS m
        FROM (SELECT *, p - 0.5 AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM {source}))"""
