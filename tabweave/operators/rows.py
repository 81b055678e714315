"""Row selection: filters, duplicates, order, head, tail, samples, splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabweave.core.checks import as_list, c, is_numeric, literal_for, number_for, present, require_choice, require_columns
from tabweave.core.scan import row_numbers

# above this a sample is cut by a threshold instead of sorted out
TOP_N_ROWS = 1000
COMPARISONS = ("==", "!=", ">", "<", ">=", "<=", "contains", "isin")


def filter_rows(df: DataFrame, column: str, operator: str, value, literal: bool = False) -> DataFrame:
    """Keep rows by one condition; ``!=`` keeps nulls, the others drop them.

    ``contains`` takes a regular expression (``literal=True``: plain text),
    ``isin`` a list or a comma-separated string.
    """
    require_columns(df, [column])
    require_choice(operator, COMPARISONS, "operator")
    x = c(column)
    if operator == "contains":
        text = x.cast("string")
        return df.where(text.contains(value) if literal else text.rlike(value))
    if operator == "isin":
        items = [v.strip() for v in value.split(",")] if isinstance(value, str) else list(value)
        if is_numeric(df, column):
            items = [v for v in items if not _between_whole(df, column, v)]
        return df.where(x.isin([literal_for(df, column, v) for v in items]) if items else F.lit(False))
    if _between_whole(df, column, value):
        # an integer column meets a fraction: the next whole number decides
        below = literal_for(df, column, floor(number_for(column, value)))
        return df.where({"==": F.lit(False), "!=": F.lit(True), ">": x > below, ">=": x > below,
                         "<": x <= below, "<=": x <= below}[operator])
    v = literal_for(df, column, value)
    if operator == "!=":
        return df.where(~x.eqNullSafe(v))
    return df.where({"==": x == v, ">": x > v, "<": x < v, ">=": x >= v, "<=": x <= v}[operator])


def _between_whole(df: DataFrame, column: str, value) -> bool:
    if value is None or not isinstance(df.schema[column].dataType, T.IntegralType):
        return False
    number = number_for(column, value)
    return not isinstance(number, float) and number != number.to_integral_value()


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Drop rows with any (or all) of the columns missing."""
    require_choice(how, ("any", "all"), "how")
    names = as_list(subset) or df.columns
    require_columns(df, names)
    known = [present(df, n) for n in names]
    return df.where(reduce((lambda a, b: a & b) if how == "any" else (lambda a, b: a | b), known))


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first",
                    order_by: Sequence[str] | None = None) -> DataFrame:
    """Remove duplicates; nulls equal each other.

    keep='none' drops every member of a duplicate group.  Which row is first
    or last in a subset group is set by ``order_by``.  All forms are
    aggregates that combine map-side, so a hot group stays small.
    """
    require_choice(keep, ("first", "last", "none"), "keep")
    names = as_list(subset)
    require_columns(df, names)
    keys = names or df.columns
    others = [n for n in df.columns if n not in keys]
    if keep == "none":
        single = df.groupBy(*map(c, keys)).agg(
            F.count(F.lit(1)).alias("_n"), F.first(F.struct(*map(c, others))).alias("_row")
            if others else F.lit(None).alias("_row")).where("_n = 1")
        return single.select(*[c(n) if n in keys else F.col("_row").getField(n).alias(n) for n in df.columns])
    if not others:
        return df.dropDuplicates()
    order = as_list(order_by)
    if not order:
        raise ValueError("keeping the first or last row of a group needs order_by")
    require_columns(df, order)
    # a flag in front of each order column sorts its nulls last in both directions
    rank = []
    for n in order:
        missing = c(n).isNull()
        rank += [missing, c(n)]
    packed = F.struct(*[r.alias(f"o{i}") for i, r in enumerate(rank)],
                      F.struct(*map(c, others)).alias("row"))
    best = (F.min if keep == "first" else F.max)(packed)
    picked = df.groupBy(*map(c, keys)).agg(best.alias("_best"))
    return picked.select(*[c(n) if n in keys else F.col("_best")["row"].getField(n).alias(n)
                           for n in df.columns])


def sort_columns(columns: Sequence[str], ascending: bool = True) -> list[Column]:
    """Sort keys with nulls last in both directions."""
    return [c(n).asc_nulls_last() if ascending else c(n).desc_nulls_last() for n in as_list(columns)]


def sort_values(df: DataFrame, columns: Sequence[str], ascending: bool = True) -> DataFrame:
    require_columns(df, as_list(columns))
    return df.orderBy(*sort_columns(columns, ascending))


def get_head(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    require_columns(df, as_list(order_by))
    return df.orderBy(*sort_columns(order_by)).limit(n)


def get_tail(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The last n rows, in ascending order."""
    require_columns(df, as_list(order_by))
    backwards = [c(x).desc_nulls_first() for x in as_list(order_by)]
    return df.orderBy(*backwards).limit(n).orderBy(*sort_columns(order_by))


def add_row_index(df: DataFrame, order_by: Sequence[str], column_name: str = "index",
                  start: int = 0) -> DataFrame:
    """Consecutive row numbers in a global order, without a one-task window."""
    require_columns(df, as_list(order_by))
    return row_numbers(df, sort_columns(order_by), column_name, start)


def hash_order(df: DataFrame, key: Sequence[str] | None, seed: int) -> Column:
    """A reproducible pseudo-random number, from the row's key or content."""
    names = as_list(key) or df.columns
    require_columns(df, names)
    return F.xxhash64(F.lit(seed), *map(c, names))


def with_hash(df: DataFrame, key: Sequence[str] | None, seed: int, name: str = "_h") -> DataFrame:
    """Add a reproducible pseudo-random number of each row's own.

    It comes from a key that tells rows apart.  Without one, copies share
    their content: rows are then numbered in the order of a hash of it, and the
    number is hashed.  Which of several copies gets which number makes no
    difference.
    """
    if as_list(key):
        return df.withColumn(name, hash_order(df, key, seed))
    numbered = row_numbers(df, [hash_order(df, None, seed).asc()], "_number")
    return numbered.withColumn(name, F.xxhash64(F.lit(seed), "_number")).drop("_number")


def sample_data(df: DataFrame, n: int = 10, random_state: int = 42,
                key: Sequence[str] | None = None) -> DataFrame:
    """A uniform sample of min(n, rows) rows, the same for the same seed.

    ``key`` names columns that tell all rows apart; without it rows are
    numbered first, which sorts the table.
    Small samples are a top-n by hash, of which every task keeps n rows;
    larger ones a hash threshold.
    """
    if n <= TOP_N_ROWS:
        out = with_hash(df, key, random_state)
        return out.orderBy("_h").limit(n).drop("_h")
    chosen, _ = split_by_hash(df, {None: n}, None, key, random_state)
    return chosen


def split_by_hash(df: DataFrame, wanted: dict, by: str | None, key: Sequence[str] | None,
                  seed: int) -> tuple[DataFrame, DataFrame]:
    """Two frames: per class exactly ``wanted[class]`` rows, and the rest.

    The cut value of the hash is found by counting: each pass splits the
    64-bit range into 1024 parts and keeps the part that holds the cut, until
    the cut is a single hash value.  No row moves; only counts reach the driver.
    Rows that share the cut's hash are shared out by a row number over them.
    """
    keyed = with_hash(df, key, seed).withColumn(
        "_g", c(by).cast("string") if by else F.lit("all"))
    goals = {("all" if by is None else (None if k is None else str(k))): int(v) for k, v in wanted.items()}
    # per class: [low, high] of the part that holds the cut, and rows still wanted from it
    state = {g: [-(1 << 63), (1 << 63) - 1, w] for g, w in goals.items() if w > 0}
    pending = dict(state)
    while pending:
        part = F.lit(None).cast("long")
        for g, (low, high, _) in pending.items():
            width = max(1, (high - low + 1 + 1023) // 1024)
            # shifted to decimal, so that the full 64-bit range does not overflow
            offset = F.col("_h").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
            inside = F.col("_g").eqNullSafe(F.lit(g)) & F.col("_h").between(F.lit(low), F.lit(high))
            part = F.when(inside, F.floor(offset / F.lit(width).cast("decimal(20,0)")).cast("long")).otherwise(part)
        counts = keyed.select("_g", part.alias("_p")).where("_p is not null").groupBy("_g", "_p").count()
        running = Window.partitionBy("_g").orderBy("_p")
        hit = counts.withColumn("_upto", F.sum("count").over(running)).withColumn(
            "_before", F.col("_upto") - F.col("count"))
        want = F.create_map(*[x for g, s in pending.items() for x in (F.lit("" if g is None else "=" + g), F.lit(s[2]))])
        tag = F.when(F.col("_g").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("_g")))
        found = hit.where((F.col("_before") < want[tag]) & (F.col("_upto") >= want[tag])).collect()
        settled = {r["_g"] for r in found}
        for g in list(pending):
            if g not in settled:  # fewer rows than wanted: take the whole class
                state[g] = [-(1 << 63), (1 << 63) - 1, None]
                del pending[g]
        for r in found:
            low, high, w = pending[r["_g"]]
            width = max(1, (high - low + 1 + 1023) // 1024)
            new = [low + r["_p"] * width, min(high, low + (r["_p"] + 1) * width - 1), w - r["_before"]]
            state[r["_g"]] = new
            # a part taken whole, or a single hash value, ends the search
            if new[2] == r["count"]:
                state[r["_g"]] = [new[0], new[1], None]
                del pending[r["_g"]]
            elif new[0] == new[1]:
                del pending[r["_g"]]
            else:
                pending[r["_g"]] = new
    below, tied, quota = F.lit(False), F.lit(False), {}
    for g, (low, high, w) in state.items():
        mine = F.col("_g").eqNullSafe(F.lit(g))
        if w is None:
            below = below | (mine & (F.col("_h") <= F.lit(high)))
        else:
            below = below | (mine & (F.col("_h") < F.lit(low)))
            tied = tied | (mine & (F.col("_h") == F.lit(low)))
            quota[g] = w
    if not quota:
        return (keyed.where(below).drop("_h", "_g"), keyed.where(~below).drop("_h", "_g"))
    numbered = None
    for g, w in quota.items():
        mine = keyed.where(F.col("_g").eqNullSafe(F.lit(g)) & tied)
        one = row_numbers(mine, [F.col("_h").asc()], "_i").withColumn("_take", F.col("_i") < F.lit(w))
        numbered = one if numbered is None else numbered.unionByName(one)
    drop = ("_h", "_g", "_i", "_take")
    chosen = keyed.where(below).drop("_h", "_g").unionByName(numbered.where("_take").drop(*drop))
    rest = keyed.where(~below & ~tied).drop("_h", "_g").unionByName(numbered.where("not _take").drop(*drop))
    return chosen, rest
