"""PCA with two components (H15): fit on the original, project both tables.

``pyspark.ml.feature.PCA`` builds the covariance with a tree aggregate (rows stay on
the executors, only a p x p matrix reaches the driver) but does not centre the
scores, so a ``StandardScaler(withMean=True, withStd=False)`` fitted on the original
comes first.  Component signs are fixed so the largest loading is positive.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.functions.names import named
from facsimile.operators.profile import num
from facsimile.schema import common_numeric_columns, numeric_columns


def _vectors(df: DataFrame, columns: list[str], id_col: str | None = None) -> DataFrame:
    """(id, x): the columns' values in one vector, missing ones (NaN too) as 0; plain inner names, whatever the columns are called."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    values = [F.coalesce(num(c, types[c]), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)]
    kept = [named(id_col).alias("id")] if id_col else []
    plain = df.select(*kept, *values)
    return VectorAssembler(inputCols=[f"c{i}" for i in range(len(columns))], outputCol="x").transform(plain)


def fit_pca(original: DataFrame, columns: list[str], k: int = 2):
    vec = _vectors(original, columns)
    scaler = StandardScaler(inputCol="x", outputCol="c", withMean=True, withStd=False).fit(vec)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(scaler.transform(vec))
    pc = model.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    return scaler, model, signs


def pca_scores(original: DataFrame, synthetic: DataFrame, k: int = 2, id_col: str | None = None) -> DataFrame:
    """(side, [id,] pc1, pc2) for both tables, projected on the original's components."""
    cols = [c for c in common_numeric_columns(original, synthetic) if c != id_col]
    if len(cols) < 2:
        raise ValueError("PCA needs at least 2 common numeric columns")
    scaler, model, signs = fit_pca(original, cols, k)

    def project(df: DataFrame, side: str) -> DataFrame:
        p = model.transform(scaler.transform(_vectors(df, cols, id_col))).withColumn("a", vector_to_array("p"))
        kept = [F.col("id").alias(id_col)] if id_col else []
        return p.select(F.lit(side).alias("side"), *kept, *[(F.col("a")[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)])

    return project(original, "original").unionByName(project(synthetic, "synthetic"))


def pca_variance(original: DataFrame, columns: list[str] | None = None, k: int = 2) -> DataFrame:
    """(component, explained_variance_ratio) of the original."""
    cols = columns or numeric_columns(original)
    _, model, _ = fit_pca(original, cols, k)
    ratios = model.explainedVariance.toArray().tolist()
    return original.sparkSession.createDataFrame([(j + 1, float(r)) for j, r in enumerate(ratios)],
                                                 "component int, explained_variance_ratio double")
