"""CSV and Parquet sources and the CSV sink."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.core.checks import c
from tabweave.sources.records import read_records

# The text tokens a CSV reader takes for a missing value.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                  "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# The tokens of a boolean column.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
# Text of a number.  Matching it is far cheaper than a failing cast per value.
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def _records_span_lines(spark: SparkSession, path: str) -> bool:
    """True if some line holds an odd number of quotes, so that a quoted value
    goes on in the next line.  A splittable text scan with an early stop."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def load_csv(spark: SparkSession, path: str, separator: str = ",", infer: bool = True,
             multiline: bool | None = None) -> DataFrame:
    """Read CSV files with a header; missing tokens become null, types are
    inferred over all rows (boolean, long, double, else string).

    Quoted values may contain line breaks; whether they do is checked unless
    ``multiline`` says so.  Files are read in parts either way.
    """
    if multiline is None:
        multiline = _records_span_lines(spark, path)
    raw = (read_records(spark, path, separator) if multiline else
           spark.read.csv(path, header=True, sep=separator, quote='"', escape='"', inferSchema=False))
    text = raw.select(*[F.when(~c(n).isin(*MISSING_TOKENS), c(n)).alias(n) for n in raw.columns])
    return _with_inferred_types(text) if infer else text


def _with_inferred_types(text: DataFrame) -> DataFrame:
    checks = []
    for i, n in enumerate(text.columns):
        trimmed = F.trim(c(n))
        checks += [F.count(c(n)).alias(f"n{i}"),
                   # an integer has no point or exponent, and has to fit
                   F.count(F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("bigint"))).alias(f"l{i}"),
                   F.count_if(trimmed.rlike(NUMBER)).alias(f"d{i}"),
                   F.count_if(c(n).isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"b{i}")]
    seen = text.agg(*checks).first() if checks else None
    out = []
    for i, n in enumerate(text.columns):
        total = seen[f"n{i}"]
        if total and seen[f"b{i}"] == total:
            out.append(c(n).isin(*TRUE_TOKENS).alias(n))
        elif total and seen[f"l{i}"] == total:
            out.append(F.trim(c(n)).try_cast("bigint").alias(n))
        elif seen[f"d{i}"] == total:
            # a column without any value is a double column
            out.append(F.trim(c(n)).try_cast("double").alias(n))
        else:
            out.append(c(n))
    return text.select(*out)


def save_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> None:
    """Write a folder of CSV parts with a header, nulls as empty fields."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def load_parquet(spark: SparkSession, path: str, nan_as_null: bool = True) -> DataFrame:
    """Read Parquet; NaN means missing, as everywhere in this library.

    Files known to hold no NaN are better read with ``nan_as_null=False``:
    filters on floating columns then reach the file's statistics.
    """
    df = spark.read.parquet(path)
    return nan_to_null(df) if nan_as_null else df


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = (T.DoubleType, T.FloatType)
    if not any(isinstance(f.dataType, floating) for f in df.schema.fields):
        return df
    return df.select(*[F.when(~F.isnan(c(f.name)), c(f.name)).alias(f.name)
                       if isinstance(f.dataType, floating) else c(f.name) for f in df.schema.fields])


def table_shapes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name, number of rows and number of columns of each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"))
        for name, df in tables.items()]
    if not parts:
        raise ValueError("no tables given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
