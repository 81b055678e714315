"""Pearson, Spearman and Kendall correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import as_list, c, numeric_columns, require_choice, require_numeric, without_nan
from tabweave.core.numeric import pearson
from tabweave.core.scan import BROADCAST_ROWS, attach, running_totals
from tabweave.session import cut_lineage

METHODS = ("pearson", "spearman", "kendall")
DIGIT_BITS = 4


def _pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct complete pairs with their counts, combined map-side."""
    pairs = df.select(c(a).cast("double").alias("a"), c(b).cast("double").alias("b")).dropna()
    return cut_lineage(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))


def _spearman_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[float | None]:
    """Pearson on the average ranks of each pair's complete rows.

    All pairs go through one chain of jobs: rows become counted (pair, a, b),
    the values of all sides are ranked in one ordered scan by (pair, side), and
    one aggregate gives all sums.  Ranks are taken around their mean so that
    large tables lose no digits.
    """
    names = sorted({n for p in pairs for n in p})
    places = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(names.index(x)).alias("x"), F.lit(names.index(y)).alias("y"))
                       for i, (x, y) in enumerate(pairs)])
    rows = df.select(F.array(*[without_nan(c(n)) for n in names]).alias("v")).select(F.inline(F.transform(
        places, lambda p: F.struct(p["pair"].alias("pair"), F.get("v", p["x"]).alias("a"), F.get("v", p["y"]).alias("b"))))).dropna()
    counted = cut_lineage(rows.groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n")))
    sides = F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("v")), F.struct(F.lit(1).alias("side"), F.col("b").alias("v"))))
    values = cut_lineage(counted.select("pair", "n", sides).groupBy("pair", "side", "v").agg(F.sum("n").alias("m")))
    distinct = values.count()
    placed = running_totals(values, ["v"], {"before": "m"}, keys=["pair", "side"], rows_bound=distinct)
    # one row a pair
    totals = counted.groupBy("pair").agg(F.sum("n").alias("total"))
    around = F.col("before") + (F.col("m") + 1) / F.lit(2.0) - (F.col("total") + 1) / F.lit(2.0)
    ranks = placed.join(F.broadcast(totals), "pair").select("pair", "side", "v", around.alias("r"))
    ranks = F.broadcast(ranks) if distinct <= BROADCAST_ROWS else cut_lineage(ranks)
    ranked = counted
    for k, side in enumerate(("a", "b")):
        ranked = attach(ranked, ranks.where(F.col("side") == k).select("pair", F.col("v").alias(side), F.col("r").alias(f"r{side}")),
                        ["pair", side])
    sums = ranked.groupBy("pair").agg(*[F.sum(F.col("n") * F.col(x) * F.col(y)) for x, y in (("ra", "rb"), ("ra", "ra"), ("rb", "rb"))])
    found = {r[0]: r[1] / math.sqrt(r[2] * r[3]) for r in sums.collect() if r[2] and r[3]}
    return [found.get(i) for i in range(len(pairs))]


def _spearman(df: DataFrame, a: str, b: str) -> float | None:
    return _spearman_pairs(df, [(a, b)])[0]


def _kendall(df: DataFrame, a: str, b: str) -> float | None:
    """tau-b with the concordant pairs counted by digits, not by comparing pairs.

    Two rows first differ in some base-16 digit of their rank in ``a``.  For
    each digit position the rows with equal higher digits are scanned in the
    order of ``b`` with one running total per digit value, so the work is
    rows x digit positions.
    """
    pairs = _pair_counts(df, a, b)
    na, nb = pairs.agg(F.countDistinct("a"), F.countDistinct("b")).first()
    if na < 2 or nb < 2:
        return None
    if nb < na:
        pairs, na = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"), nb
    half = lambda n: F.sum(n.cast("double") * (n - 1) / 2)
    total, ties_ab = pairs.agg(F.sum("n"), half(F.col("n"))).first()
    ties = [pairs.groupBy(s).agg(F.sum("n").alias("m")).agg(half(F.col("m"))).first()[0] for s in ("a", "b")]
    dense = running_totals(pairs.select("a").distinct().withColumn("one", F.lit(1)), ["a"], {"rank": "one"}, rows_bound=na)
    dense = dense.select("a", "rank")
    ranked = attach(pairs, F.broadcast(dense) if na <= BROADCAST_ROWS else dense, ["a"])
    levels = max(1, math.ceil(math.log2(na) / DIGIT_BITS))
    # one row per level, with the digits above it as key
    spread = ranked.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(levels)])))
    shift = lambda k: F.expr(f"shiftright(rank, {DIGIT_BITS * k})")
    prefix, digit = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for k in range(levels):
        here = F.col("level") == k
        prefix = F.when(here, shift(k + 1)).otherwise(prefix)
        digit = F.when(here, shift(k).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))).otherwise(digit)
    base = 1 << DIGIT_BITS
    cells = spread.select("level", prefix.alias("prefix"), digit.alias("digit"), "b", "n").groupBy(
        "level", "prefix", "b").agg(*[
            F.coalesce(F.sum(F.when(F.col("digit") == d, F.col("n"))), F.lit(0)).alias(f"n{d}") for d in range(base)])
    scanned = running_totals(cells, ["b"], {f"s{d}": f"n{d}" for d in range(base - 1)}, keys=["level", "prefix"])
    smaller, agree = F.lit(0.0), F.lit(0.0)
    for d in range(1, base):
        smaller = smaller + F.col(f"s{d - 1}")
        agree = agree + F.col(f"n{d}").cast("double") * smaller
    concordant = scanned.agg(F.sum(agree)).first()[0]
    everything = total * (total - 1) / 2.0
    discordant = everything - ties[0] - ties[1] + ties_ab - concordant
    return (concordant - discordant) / math.sqrt((everything - ties[0]) * (everything - ties[1]))


def correlation(df: DataFrame, a: str, b: str, method: str = "pearson") -> float | None:
    """The coefficient over complete pairs; None for a constant column."""
    require_choice(method, METHODS, "method")
    require_numeric(df, [a, b])
    if method == "pearson":
        return df.agg(pearson(c(a), c(b))).first()[0]
    return (_spearman if method == "spearman" else _kendall)(df, a, b)


def get_correlation(df: DataFrame, col_a: str, col_b: str, method: str = "pearson") -> DataFrame:
    """One row: the coefficient, its strength and direction in words."""
    value = correlation(df, col_a, col_b, method)
    size = F.abs(F.col("corr"))
    out = df.sparkSession.createDataFrame([(col_a, col_b, method, value)],
                                          "col_a string, col_b string, method string, corr double")
    return out.withColumns({
        "strength": F.when(size >= 0.8, "very strong").when(size >= 0.6, "strong").when(size >= 0.4, "moderate")
        .when(size >= 0.2, "weak").otherwise("very weak / none"),
        "direction": F.when(F.col("corr") > 0, "positive").otherwise("negative")})


def correlation_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], method: str) -> DataFrame:
    """(x, y, corr) for given pairs; all Pearson pairs share one aggregate."""
    require_choice(method, METHODS, "method")
    require_numeric(df, sorted({n for p in pairs for n in p}))
    if not pairs:
        raise ValueError("at least two numeric columns are needed")
    if method == "pearson":
        wide = df.agg(*[pearson(c(x), c(y)).alias(f"p{i}") for i, (x, y) in enumerate(pairs)])
        return wide.select(F.inline(F.array(*[
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"p{i}").alias("corr"))
            for i, (x, y) in enumerate(pairs)])))
    values = _spearman_pairs(df, pairs) if method == "spearman" else [correlation(df, x, y, method) for x, y in pairs]
    rows = [(x, y, v) for (x, y), v in zip(pairs, values)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, corr double")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """The lower triangle without the diagonal, as (x, y, corr) rows."""
    names = as_list(columns) or numeric_columns(df)
    return correlation_pairs(df, [(y, x) for x, y in combinations(names, 2)], method)
