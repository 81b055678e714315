"""Principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import as_list, c
from tabweave.functions.transforms import fit_scaling
from tabweave.operators.features import VECTOR


def pca_transform(df: DataFrame, columns: Sequence[str], n_components: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows with PC1.., table of explained variance) on standardised columns.

    The sign of a component makes its largest loading positive.  The scores
    are plain column arithmetic on the fitted loadings.
    """
    names = as_list(columns)
    k = min(n_components, len(names))
    scaling = fit_scaling(df, names, "standard", fill=0.0)
    scaled = [scaling.column(n, fill=0.0) for n in names]
    vectors = df.select(array_to_vector(F.array(*scaled)).alias(VECTOR))
    model = PCA(k=k, inputCol=VECTOR, outputCol="_pc").fit(vectors)
    loadings = model.pc.toArray()
    new = {}
    for j in range(k):
        column = loadings[:, j]
        sign = 1.0 if max(column) >= -min(column) else -1.0
        total = F.lit(0.0)
        for x, w in zip(scaled, column):
            total = total + x * F.lit(float(sign * w))
        new[f"PC{j + 1}"] = total
    ratios = [float(v) for v in model.explainedVariance.toArray()]
    table = [(f"PC{j + 1}", 100 * r, 100 * sum(ratios[:j + 1])) for j, r in enumerate(ratios)]
    variance = df.sparkSession.createDataFrame(table, "component string, variance_pct double, cumulative_pct double")
    return df.select(*[c(n) for n in df.columns if n not in new], *[v.alias(n) for n, v in new.items()]), variance
