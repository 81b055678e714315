"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabweave.core.checks import c, is_numeric, numeric_columns, require_choice, require_columns, require_numeric
from tabweave.core.numeric import div, sample_kurtosis, sample_skewness
from tabweave.core.quantile import grouped_stats, quantile_values


def get_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"))


def get_info(df: DataFrame) -> DataFrame:
    """Column, type and number of non-null values."""
    counts = df.agg(*[F.count(c(n)).alias(n) for n in df.columns])
    return counts.unpivot([], [c(n) for n in df.columns], "column", "non_null").select(
        "column", _type_of(df).alias("dtype"), "non_null")


def _type_of(df: DataFrame):
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return types[F.col("column")]


def get_statistics(df: DataFrame) -> DataFrame:
    """Long table (column, stat, value as text): count, mean, std, min,
    quartiles and max of numbers; count, unique, top and freq of the rest."""
    numbers = numeric_columns(df)
    others = [n for n in df.columns if n not in numbers]
    exprs = []
    for i, n in enumerate(numbers):
        x = c(n).cast("double")
        exprs += [F.count(x).alias(f"n{i}_count"), F.avg(x).alias(f"n{i}_mean"),
                  F.stddev_samp(x).alias(f"n{i}_std"), F.min(x).alias(f"n{i}_min"), F.max(x).alias(f"n{i}_max")]
    out = None
    if numbers:
        wide = grouped_stats(df.select(*map(c, numbers)), [], exprs, {n: [0.25, 0.5, 0.75] for n in numbers})
        cells = []
        for i, n in enumerate(numbers):
            stats = [("count", F.col(f"n{i}_count").cast("double")), ("mean", F.col(f"n{i}_mean")),
                     ("std", F.col(f"n{i}_std")), ("min", F.col(f"n{i}_min")),
                     *[(label, c(f"q_{n}")[k]) for k, label in enumerate(("25%", "50%", "75%"))],
                     ("max", F.col(f"n{i}_max"))]
            cells += [F.struct(F.lit(n).alias("column"), F.lit(s).alias("stat"), v.alias("value"),
                               F.lit(None).cast("string").alias("text")) for s, v in stats]
        out = wide.select(F.inline(F.array(*cells)))
    if others:
        # the values of all columns are counted in one scan
        cells = F.array(*[F.struct(F.lit(i).alias("place"), c(n).cast("string").alias("v")) for i, n in enumerate(others)])
        counts = df.select(F.inline(cells)).groupBy("place", "v").agg(F.count(F.lit(1)).alias("n"))
        known = F.col("v").isNotNull()
        best = F.min(F.when(known, F.struct((-F.col("n")).alias("n"), "v")))
        one = counts.groupBy("place").agg(F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).cast("double").alias("count"),
                                          F.count("v").cast("double").alias("unique"), best.alias("best"))
        # a line for every column, also of a table without rows
        lines = df.sparkSession.createDataFrame(list(enumerate(others)), "place int, column string")
        text, zero = F.lit(None).cast("string"), F.lit(0.0)
        cells = [F.struct("column", F.lit(s).alias("stat"), v.alias("value"), t.alias("text"))
                 for s, v, t in (("count", F.coalesce("count", zero), text), ("unique", F.coalesce("unique", zero), text),
                                 ("top", F.lit(None).cast("double"), F.col("best.v")),
                                 ("freq", (-F.col("best.n")).cast("double"), text))]
        part = lines.join(F.broadcast(one), "place", "left").select(F.inline(F.array(*cells)))
        out = part if out is None else out.unionByName(part)
    return out


def quality_report(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: type, missing count and %, distinct values; the table's
    rows, duplicate rows and their % on every line.

    One scan: every value becomes (column, 128-bit hash), the whole row is one
    column more, and equal pairs combine before they are shuffled.  ``approx``
    estimates the distinct values of columns by sketches instead.
    """
    def cell(place: int, *values) -> Column:
        known = values[0].isNotNull() if place >= 0 else F.lit(True)
        hashes = [F.when(known, F.xxhash64(F.lit(seed), *values)) for seed in (1, 2)]
        return F.struct(F.lit(place).alias("place"), hashes[0].alias("h1"), hashes[1].alias("h2"))

    each = [c(n) for n in df.columns]
    cells = [cell(-1, *each), *([] if approx else [cell(i, x) for i, x in enumerate(each)])]
    counts = df.select(F.inline(F.array(*cells))).groupBy("place", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    found = {r.place: r for r in counts.groupBy("place").agg(  # one row a column
        F.sum("n").alias("n"), F.count("h1").alias("unique"),
        F.coalesce(F.sum(F.when(F.col("h1").isNull(), F.col("n"))), F.lit(0)).alias("missing")).collect()}
    n_rows, duplicates = (found[-1].n, found[-1].n - found[-1].unique) if found else (0, 0)
    if approx:
        row = df.agg(*[e for i, x in enumerate(each) for e in (
            F.approx_count_distinct(x).alias(f"u{i}"), F.count_if(x.isNull()).alias(f"m{i}"))]).first()
        facts = [(row[f"m{i}"], row[f"u{i}"]) for i in range(len(each))]
    else:
        facts = [(found[i].missing, found[i].unique) if found else (0, 0) for i in range(len(each))]
    share = lambda k: k * 100.0 / n_rows if n_rows else 0.0
    lines = [(n, df.schema[n].dataType.simpleString(), m, share(m), u, n_rows, duplicates, share(duplicates))
             for n, (m, u) in zip(df.columns, facts)]
    return df.sparkSession.createDataFrame(lines, "column string, dtype string, missing long, missing_pct double, unique long, "
                                                  "n_rows long, duplicate_rows long, duplicate_pct double")


def get_unique_values(df: DataFrame, column: str, top_n: int = 50) -> DataFrame:
    """The most frequent values (null included) with count and %, ties by
    value, and the number of distinct values."""
    require_columns(df, [column])
    counts = df.groupBy(c(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.agg(F.sum("count"), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("count"), F.col("value").asc_nulls_last()).limit(top_n)
    return top.select("value", "count", (F.col("count") * 100.0 / F.lit(float(totals[0] or 1))).alias("pct"),
                      F.lit(totals[1]).cast("long").alias("n_unique"))


def get_value_counts(df: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    """As get_unique_values, with the cumulative %.  The running sum is over
    at most ``top_n`` rows."""
    top = get_unique_values(df, column, top_n)
    so_far = Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), F.col("value").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return top.withColumn("cumulative_pct", F.sum("pct").over(so_far)).select(
        "value", "count", "pct", "cumulative_pct", "n_unique")


# most frequent values of a profile
PROFILE_VALUES = 10


def get_column_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: type, nulls, distinct values (null counts as one), and for
    numbers min, max, mean, median, std, skewness, kurtosis; the ten most
    frequent non-null values with their counts, as an array."""
    require_columns(df, [column])
    x = c(column)
    exprs = [F.count(F.lit(1)).alias("n_rows"), F.count(x).alias("non_null"),
             F.count_if(x.isNull()).alias("missing"),
             (F.countDistinct(x) + F.max(x.isNull().cast("int"))).alias("unique")]
    stats = []
    if is_numeric(df, column):
        v = x.cast("double")
        exprs += [F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
                  F.stddev_samp(v).alias("std"), sample_skewness(v).alias("skewness"),
                  sample_kurtosis(v).alias("kurtosis")]
        stats = ["min", "max", "mean", c(f"q_{column}")[0].alias("median"), "std", "skewness", "kurtosis"]
    wide = grouped_stats(df.select(x), [], exprs, {column: [0.5]} if stats else {})
    counts = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    most = counts.orderBy(F.desc("n"), F.asc("v")).limit(PROFILE_VALUES).select(F.col("v").cast("string").alias("v"), "n").collect()
    top = F.array(*[F.struct(F.lit(r.v).alias("value"), F.lit(r.n).cast("long").alias("count")) for r in most]).cast(
        "array<struct<value:string,count:bigint>>").alias("top_values")
    return wide.select(F.lit(column).alias("column"), F.lit(df.schema[column].dataType.simpleString()).alias("dtype"),
                       "n_rows", "non_null", "missing",
                       F.coalesce(div(F.col("missing") * 100.0, F.col("n_rows")), F.lit(0.0)).alias("missing_pct"),
                       "unique", *stats, top)


OUTLIER_METHODS = ("iqr", "zscore")


def detect_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """One row: bounds, count and % of outliers, the column's range and the
    range of the outliers."""
    require_numeric(df, [column])
    require_choice(method, OUTLIER_METHODS, "method")
    x = c(column).cast("double")
    if method == "iqr":
        q = quantile_values(df, {column: [0.25, 0.75]})[column]
        low, high = ((q[0] - threshold * (q[1] - q[0]), q[1] + threshold * (q[1] - q[0])) if q else (None, None))
        outside = (x < F.lit(low)) | (x > F.lit(high))
    else:
        mean, std = df.agg(F.avg(x), F.stddev_samp(x)).first()
        low, high = ((mean - threshold * std, mean + threshold * std) if std is not None else (None, None))
        outside = F.abs(div(x - F.lit(mean), F.lit(std))) > F.lit(threshold)
    hit = F.when(outside, x)
    return df.agg(F.lit(method).alias("method"), F.count(hit).alias("n_outliers"),
                  F.coalesce(div(F.count(hit) * 100.0, F.count(x)), F.lit(0.0)).alias("pct"),
                  F.lit(low).cast("double").alias("lower_bound"), F.lit(high).cast("double").alias("upper_bound"),
                  F.min(x).alias("min"), F.max(x).alias("max"),
                  F.min(hit).alias("outlier_min"), F.max(hit).alias("outlier_max"))


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each distinct pattern of nulls (one 0/1 flag per column) and its rows."""
    names = list(columns or df.columns)
    require_columns(df, names)
    return df.groupBy(*[c(n).isNull().cast("int").alias(n) for n in names]).agg(F.count(F.lit(1)).alias("n_rows"))
