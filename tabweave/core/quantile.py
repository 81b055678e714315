"""Exact interpolated quantiles, for whole tables and per group.

Whole tables and few groups: counting scans that narrow down on the wanted
positions; no row is shuffled.  Many groups: Spark's ``percentile``, which
holds one value->count map per group in a task, only where the number of
distinct values is known to be small; beyond that a distributed table of value
counts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.core.checks import c, without_nan
from tabweave.core.scan import attach, running_totals

# distinct values one task may hold in a percentile map (tens of MB)
SMALL_DISTINCT = 1_000_000
# a percentile map is cheaper than scans for so few rows, or distinct values
SMALL_ROWS = 5_000_000
TINY_DISTINCT = 10_000
# most (group, column, position) combinations that are scanned for together
SCANNED_TARGETS = 200
# parts a bracket is split into by one counting scan
PARTS = 1024
# values of open brackets that are fetched instead of narrowed further
FETCHED = 20_000


def _bounds(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> tuple[int, int, int]:
    """Rows, and about how many groups and distinct values (the most of any
    column) there are, from one scan."""
    rows, groups, *values = df.agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct(*map(c, by))).alias("g"),
        *[F.approx_count_distinct(c(n)).alias(f"d{i}") for i, n in enumerate(columns)]).first()
    return rows, groups, max(values)


def _size_exprs(x: Column, i: int) -> list[Column]:
    """Number of values, least and largest finite value, infinities of each sign."""
    infinite = float("inf")
    finite = F.when(F.abs(x) < infinite, x)
    return [F.count(x).alias(f"n{i}"), F.min(finite).alias(f"a{i}"), F.max(finite).alias(f"b{i}"),
            F.count_if(x == -infinite).alias(f"d{i}"), F.count_if(x == infinite).alias(f"u{i}")]


def _size(row, i: int) -> tuple:
    return tuple(row[f"{k}{i}"] for k in "nabdu")


def _clean(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Group columns, and the wanted columns as doubles without NaN."""
    doubles = df.select(*[c(k).alias(f"_by{i}") for i, k in enumerate(by)],
                        *[c(n).cast("double").alias(f"_c{i}") for i, n in enumerate(names)])
    return doubles.select(*[f"_by{i}" for i in range(len(by))], *[
        F.when(~F.isnan(f"_c{i}"), F.col(f"_c{i}")).alias(f"_c{i}") for i in range(len(names))])


def _interpolated(found: Mapping, key, total: int, probs: Sequence[float]) -> list[float] | None:
    if not total:
        return None
    out = []
    for p in probs:
        position = (total - 1) * float(p)
        low, high = found[key, math.floor(position)], found[key, math.ceil(position)]
        part = position - math.floor(position)
        out.append(low if low == high or part == 0 else low * (1 - part) + high * part)
    return out


def _positions(total: int, probs: Sequence[float]) -> list[int]:
    return sorted({f((total - 1) * float(p)) for p in probs for f in (math.floor, math.ceil)}) if total else []


def _scanned_quantiles(df: DataFrame, by: Sequence[str], wanted: Mapping[str, Sequence[float]],
                       limit: int) -> DataFrame | None:
    """(group, arrays) by counting scans over all groups at once; None if
    there are more than ``limit`` groups."""
    names = list(wanted)
    plain = _clean(df, by, names)
    keys = [F.col(f"_by{i}") for i in range(len(by))]
    groups = plain.groupBy(*keys).agg(*[e for i in range(len(names)) for e in _size_exprs(F.col(f"_c{i}"), i)]).limit(
        limit + 1).collect()
    if len(groups) > limit:
        return None
    which = F.lit(None).cast("int")
    sizes, positions = {}, {}
    for j, g in enumerate(groups):
        mine = F.lit(True)
        for k, key in enumerate(keys):
            mine = mine & key.eqNullSafe(F.lit(g[f"_by{k}"]))
        which = F.when(mine, F.lit(j)).otherwise(which)
        for i, n in enumerate(names):
            sizes[i, j] = _size(g, i)
            positions[i, j] = _positions(sizes[i, j][0], wanted[n])
    numbered = plain.select(which.alias("_g"), *[f"_c{i}" for i in range(len(names))])
    families = [[((i, j), f"_c{i}", f"_g = {j} AND ") for j in range(len(groups))] for i in range(len(names))]
    found = order_statistics(numbered, families, positions, sizes)
    rows = [(*[g[f"_by{k}"] for k in range(len(by))],
             *[_interpolated(found, (i, j), sizes[i, j][0], wanted[n]) for i, n in enumerate(names)])
            for j, g in enumerate(groups)]
    schema = T.StructType([df.schema[k] for k in by] + [
        T.StructField(f"q_{n}", T.ArrayType(T.DoubleType())) for n in names])
    return df.sparkSession.createDataFrame(rows, schema)


def _quantile_table(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str], out: str) -> DataFrame:
    """Quantiles from value counts: the counts are combined map-side, the
    positions come from distributed running totals."""
    by = list(by)
    source = df.select(*map(c, by), without_nan(c(column)).alias("_v")).where("_v is not null")
    counts = source.groupBy(*map(c, by), "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counts, ["_v"], {"_before": "_n"}, keys=by)
    sizes = counts.groupBy(*map(c, by)).agg(F.sum("_n").alias("_total"))
    placed = attach(placed, sizes, by)
    picks = []
    for i, p in enumerate(probs):
        position = (F.col("_total") - 1) * F.lit(float(p))
        for tag, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (F.col("_before") <= index) & (index < F.col("_before") + F.col("_n"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"{tag}{i}"))
    picked = placed.groupBy(*map(c, by)).agg(F.max("_total").alias("_total"), *picks)
    values = []
    for i, p in enumerate(probs):
        position = (F.col("_total") - 1) * F.lit(float(p))
        part = position - F.floor(position)
        low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        # no part of an infinite value, where none is wanted
        values.append(F.when((low == high) | (part == 0), low).otherwise(low * (F.lit(1.0) - part) + high * part))
    return picked.select(*map(c, by), F.array(*values).alias(out))


def grouped_stats(df: DataFrame, by: Sequence[str], exprs: Sequence[Column],
                  quantiles: Mapping[str, Sequence[float]], small: int = SMALL_DISTINCT) -> DataFrame:
    """One row per group: plain aggregates, and ``q_<column>`` quantile arrays.

    Quantiles leave out null and NaN, whichever way they are found.
    """
    by = list(by)
    wanted = {n: list(p) for n, p in quantiles.items() if p}
    if not by:
        found = quantile_values(df, wanted) if wanted else {}
        arrays = {f"q_{n}": F.array(*map(F.lit, v)) if v else F.lit(None).cast("array<double>") for n, v in found.items()}
        return df.agg(*(exprs or [F.count(F.lit(1)).alias("_rows")])).withColumns(arrays).drop("_rows")
    if not wanted:
        return df.groupBy(*map(c, by)).agg(*exprs)
    rows, groups, distinct = _bounds(df, by, list(wanted))
    limit = SCANNED_TARGETS // sum(len(p) for p in wanted.values())
    scanned = None
    fits = rows <= SMALL_ROWS or distinct <= TINY_DISTINCT
    if not fits and groups <= limit:
        scanned = _scanned_quantiles(df, by, wanted, limit)
    if fits or (scanned is None and distinct <= small):
        arrays = [F.percentile(without_nan(c(n)), F.array(*[F.lit(float(x)) for x in p])).alias(f"q_{n}")
                  for n, p in wanted.items()]
        return df.groupBy(*map(c, by)).agg(*exprs, *arrays)
    out = df.groupBy(*map(c, by)).agg(F.count(F.lit(1)).alias("_rows"), *exprs)
    if scanned is not None:
        return attach(out, F.broadcast(scanned), by).drop("_rows")
    for n, p in wanted.items():
        out = attach(out, _quantile_table(df, n, p, by, f"q_{n}"), by)
    return out.drop("_rows")


def _in_brackets(df: DataFrame, cells: Sequence[tuple[str, str]]) -> DataFrame:
    """``b, x``: the bracket and the value of each row and cell; rows outside have nulls.

    A filter on ``b`` would be pushed below the columns that its cases read, and
    repeat their expressions in every case; so there is none without an explode.
    """
    if len(cells) > 1:
        return df.select(F.explode(F.array(*[F.expr(f"named_struct('b', {b}, 'x', {x})") for b, x in cells])).alias("s")).select(
            "s.*").where("b is not null")
    [(b, x)] = cells
    rows = df.select(F.expr(b).alias("b"), F.col(x).alias("x"))
    return rows.select("b", F.when(F.col("b").isNotNull(), F.col("x")).alias("x"))


def _part(limits: Sequence[tuple[float, float]], parts: int) -> Column:
    """Which of its bracket's equal parts holds a value."""
    # halves where the width would overflow
    halves = [1.0 if math.isfinite(high - low) else 0.5 for low, high in limits]

    def of(values: Sequence[float]) -> Column:
        # rows outside have no part, as their value is null
        return F.get(F.array(*map(F.lit, values)), F.coalesce("b", F.lit(0)))

    low = of([low * h for (low, _), h in zip(limits, halves)])
    width = of([high * h - low * h for (low, high), h in zip(limits, halves)])
    return F.least(F.floor((F.col("x") * of(halves) - low) / width * F.lit(float(parts))), F.lit(parts - 1).cast("long"))


def order_statistics(df: DataFrame, families: Sequence[Sequence[tuple]], wanted: Mapping, sizes: Mapping,
                     parts: int = PARTS, fetched: int = FETCHED) -> dict[tuple, float]:
    """The k-th smallest values, counted from 0, as {(key, k): value}.

    A family is a column, whole or split by groups: (key, column, condition)
    triples of which a row meets one at most.  ``wanted`` holds the positions
    and ``sizes`` the facts of ``_size_exprs`` per key.

    A scan counts the rows of every part of the open brackets.  A part whose
    values are all the same is an answer; otherwise it becomes the next
    bracket, cut to its values.  Once few values are left they are fetched.
    """
    answers: dict[tuple, float] = {}
    open_: dict[tuple, tuple[float, float, int, int]] = {}
    for key, ks in wanted.items():
        total, low, high, below, above = sizes[key]
        for k in ks:
            if k < below:
                answers[key, k] = -math.inf
            elif k >= total - above:
                answers[key, k] = math.inf
            elif low == high or k == below:
                answers[key, k] = low
            elif k == total - above - 1:
                answers[key, k] = high
            else:
                open_[key, k] = (low, high, below, total - below - above)
    while open_:
        brackets = sorted({(key, state) for (key, _), state in open_.items()})
        number = {b: i for i, b in enumerate(brackets)}
        last = sum(state[3] for _, state in brackets) <= fetched
        cells = []
        for family in families:
            # the brackets of one key do not overlap
            cases = [f"WHEN {condition}{x} BETWEEN {state[0]!r}D AND {state[1]!r}D THEN {number[key, state]}"
                     for key, x, condition in family for state in (s for k, s in brackets if k == key)]
            if cases:
                cells.append((f"CASE {' '.join(cases)} END", family[0][1]))
        rows = _in_brackets(df, cells)
        if last:
            found = [(r.b, r.x, r.x, r.n) for r in rows.groupBy("b", "x").agg(F.count(F.lit(1)).alias("n")).collect()]
        else:
            part = _part([state[:2] for _, state in brackets], parts)
            found = [(r.b, r.low, r.high, r.n) for r in rows.groupBy("b", part.alias("part")).agg(
                F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()]
        found = [r for r in found if r[0] is not None]
        by_bracket: dict[int, list] = {}
        for b, low, high, n in sorted(found):
            by_bracket.setdefault(b, []).append((low, high, n))
        still = {}
        for (key, k), state in open_.items():
            before = state[2]
            for low, high, size in by_bracket[number[key, state]]:
                if k < before + size:
                    if low == high:
                        answers[key, k] = low
                    else:
                        still[key, k] = (low, high, before, size)
                    break
                before += size
        open_ = still
    return answers


def quantile_values(df: DataFrame, quantiles: Mapping[str, Sequence[float]], parts: int = PARTS,
                    fetched: int = FETCHED) -> dict[str, list[float] | None]:
    """Whole-table quantiles as plain numbers; None for a column without values."""
    names = list(quantiles)
    plain = _clean(df, [], names)
    row = plain.agg(*[e for i in range(len(names)) for e in _size_exprs(F.col(f"_c{i}"), i)]).first()
    sizes = {i: _size(row, i) for i in range(len(names))}
    positions = {i: _positions(sizes[i][0], quantiles[n]) for i, n in enumerate(names)}
    families = [[(i, f"_c{i}", "")] for i in range(len(names))]
    found = order_statistics(plain, families, positions, sizes, parts, fetched)
    return {n: _interpolated(found, i, sizes[i][0], quantiles[n]) for i, n in enumerate(names)}
