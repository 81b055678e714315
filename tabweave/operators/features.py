"""Feature vectors for MLlib: numeric columns, nulls as 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import c, numeric_columns, require_columns

VECTOR = "_features"
LABEL = "_label"


def feature_columns(df: DataFrame, target_column: str) -> list[str]:
    require_columns(df, [target_column])
    names = numeric_columns(df, [target_column])
    if not names:
        raise ValueError("no numeric feature columns besides the target")
    return names


def with_features(df: DataFrame, names: Sequence[str], output: str = VECTOR) -> DataFrame:
    """Add the vector column; nulls and NaN count as 0."""
    require_columns(df, names)
    values = [F.nanvl(F.coalesce(c(n).cast("double"), F.lit(0.0)), F.lit(0.0)) for n in names]
    return df.withColumn(output, array_to_vector(F.array(*values)))
