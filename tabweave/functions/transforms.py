"""Numeric transforms: logarithms, scaling, polynomials, bins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import as_list, c, require_choice, require_numeric
from tabweave.core.quantile import quantile_values

LOGS = {"log1p": F.log1p, "log": F.ln, "log10": F.log10}
SCALINGS = ("minmax", "standard", "robust")
BINNINGS = ("quantile", "uniform", "custom")


def log_transform(df: DataFrame, columns: Sequence[str], method: str = "log1p") -> DataFrame:
    """New columns ``Log_{column}``; values outside the domain give null."""
    names = as_list(columns)
    require_choice(method, LOGS, "method")
    require_numeric(df, names)
    return df.withColumns({f"Log_{n}": LOGS[method](c(n).cast("double")) for n in names})


def log_domain_counts(df: DataFrame, columns: Sequence[str], method: str = "log1p") -> DataFrame:
    """Per column the values a warning is due for: negative for log1p,
    non-positive for the other logarithms."""
    names = as_list(columns)
    require_choice(method, LOGS, "method")
    require_numeric(df, names)
    wide = df.agg(*[F.count_if(c(n) < 0 if method == "log1p" else c(n) <= 0).alias(n) for n in names])
    return wide.unpivot([], [c(n) for n in names], "column", "n_outside")


@dataclass(frozen=True)
class Scaling:
    """Fitted shift and divisor per column; a divisor of 0 means constant."""

    shift: dict[str, float | None]
    divisor: dict[str, float | None]

    def column(self, name: str, fill: float | None = None) -> Column:
        x = c(name).cast("double")
        if fill is not None:
            x = F.coalesce(x, F.lit(float(fill)))
        shift = self.shift[name]
        if shift is None:
            return x
        return (x - F.lit(shift)) / F.lit(self.divisor[name] or 1.0)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.column(n).alias(n) if n in self.shift else c(n) for n in df.columns])


def fit_scaling(df: DataFrame, columns: Sequence[str], method: str = "minmax", fill: float | None = None) -> Scaling:
    """One aggregate over all columns.  ``fill`` replaces nulls beforehand."""
    names = as_list(columns)
    require_choice(method, SCALINGS, "method")
    require_numeric(df, names)
    x = {n: F.coalesce(c(n).cast("double"), F.lit(float(fill))) if fill is not None else c(n).cast("double")
         for n in names}
    if method == "robust":
        source = df.select(*[v.alias(n) for n, v in x.items()])
        found = quantile_values(source, {n: [0.25, 0.5, 0.75] for n in names})
        return Scaling({n: q and q[1] for n, q in found.items()},
                       {n: q and q[2] - q[0] for n, q in found.items()})
    low, spread = (F.min, lambda v: F.max(v) - F.min(v)) if method == "minmax" else (F.avg, F.stddev_pop)
    row = df.agg(*[e for i, n in enumerate(names)
                   for e in (low(x[n]).alias(f"s{i}"), spread(x[n]).alias(f"d{i}"))]).first()
    return Scaling({n: row[f"s{i}"] for i, n in enumerate(names)},
                   {n: row[f"d{i}"] for i, n in enumerate(names)})


def normalize(df: DataFrame, columns: Sequence[str], method: str = "minmax") -> DataFrame:
    """Scale in place: minmax to 0..1, standard by the population deviation,
    robust by the quartile range.  Nulls stay, a constant column gives 0."""
    return fit_scaling(df, columns, method).apply(df)


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2,
                        interaction_only: bool = False) -> DataFrame:
    """All products of degree 2..degree as new columns; nulls count as 0."""
    names = as_list(columns)
    require_numeric(df, names)
    if degree < 1:
        raise ValueError("degree must be positive")
    choose = combinations if interaction_only else combinations_with_replacement
    x = {n: F.coalesce(c(n).cast("double"), F.lit(0.0)) for n in names}
    new = {}
    for d in range(2, degree + 1):
        for term in choose(names, d):
            powers = [(n, term.count(n)) for n in dict.fromkeys(term)]
            label = "_".join(n if k == 1 else f"{n}^{k}" for n, k in powers).replace(" ", "_")
            new[label] = prod([x[n] for n in term[1:]], start=x[term[0]])
    return df.withColumns(new) if new else df


def bin_edges(df: DataFrame, column: str, bins: int | Sequence[float] = 3, method: str = "quantile") -> list[float]:
    """Increasing bin edges; empty for a column without values."""
    require_numeric(df, [column])
    require_choice(method, BINNINGS, "method")
    if method == "custom":
        if isinstance(bins, int):
            raise ValueError("custom bins are a list of edges")
        edges = [float(e) for e in bins]
        if any(b <= a for a, b in zip(edges, edges[1:])):
            raise ValueError("bin edges must increase")
        return edges
    n = bins if isinstance(bins, int) else 3
    if method == "quantile":
        found = quantile_values(df, {column: [i / n for i in range(n + 1)]})[column]
        return sorted(set(found or []))
    low, high = df.agg(F.min(c(column).cast("double")), F.max(c(column).cast("double"))).first()
    if low is None:
        return []
    if low == high:
        reach = 0.001 * abs(low) if low != 0 else 0.001
        low, high = low - reach, high + reach
        return [low + (high - low) * i / n for i in range(n + 1)]
    edges = [low + (high - low) * i / n for i in range(n)] + [high]
    edges[0] = low - (high - low) * 0.001
    return edges


def bin_labels(edges: Sequence[float], lowest_included: bool) -> list[str]:
    """Interval labels with as many digits (3 or more) as keep them apart."""
    for digits in range(3, 18):
        text = [f"{e:.{digits}g}" for e in edges]
        if len(set(text)) == len(text):
            break
    return [f"{'[' if i == 0 and lowest_included else '('}{a}, {b}]"
            for i, (a, b) in enumerate(zip(text, text[1:]))]


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """Number of the right-closed interval; the lowest edge belongs to the
    first one; outside or null gives null."""
    out = F.when((x < edges[0]) | (x > edges[-1]), F.lit(None).cast("int"))
    for i, upper in enumerate(edges[1:]):
        out = out.when(x <= upper, F.lit(i))
    return out


def bin_column(df: DataFrame, column: str, bins: int | Sequence[float] = 3, method: str = "quantile",
               labels: Sequence[str] | None = None, new_column: str = "") -> DataFrame:
    """Discretise into right-closed bins, equal edges merged."""
    edges = bin_edges(df, column, bins, method)
    target = new_column or f"{column}_binned"
    if len(edges) < 2:
        return df.withColumn(target, F.lit(None).cast("string"))
    names = list(labels) if labels else bin_labels(edges, method != "uniform")
    if len(names) != len(edges) - 1:
        raise ValueError(f"{len(edges) - 1} bins need as many labels, got {len(names)}")
    index = bin_index(c(column).cast("double"), edges)
    return df.withColumn(target, F.get(F.array(*map(F.lit, names)), index))


def bin_counts(df: DataFrame, column: str, bins: int | Sequence[float] = 3, method: str = "quantile",
               labels: Sequence[str] | None = None) -> DataFrame:
    """Label and number of rows of each bin that holds rows."""
    return bin_column(df, column, bins, method, labels, "bin").where("bin is not null").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
