"""Principal components of pre-scaled columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _assemble(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="error").transform(df)


def pca_fit(df: DataFrame, cols: Sequence[str], k: int):
    """Fitted components; the covariance is a distributed aggregation."""
    return PCA(k=k, inputCol="_v", outputCol="_pc").fit(_assemble(df, cols))


def _signs(model) -> list[float]:
    """Sign per component that makes its largest loading positive."""
    pc = model.pc.toArray()
    return [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(pc.shape[1])]


def pca_transform(model, df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    out = model.transform(_assemble(df, cols)).withColumn("_pc", vector_to_array("_pc"))
    return out.select(*keep, *[(F.get("_pc", F.lit(i)) * s).alias(f"pc{i + 1}") for i, s in enumerate(_signs(model))])


def pca_explained(model, spark) -> DataFrame:
    share = model.explainedVariance.toArray()
    rows = [(i + 1, float(v), float(share[: i + 1].sum())) for i, v in enumerate(share)]
    return spark.createDataFrame(rows, "component int, share double, cumulative double")


def pca_loadings(model, cols: Sequence[str], spark, component: int = 1, top_n: int | None = None) -> DataFrame:
    """Signed loadings of one component by descending magnitude."""
    pc, sign = model.pc.toArray()[:, component - 1], _signs(model)[component - 1]
    out = spark.createDataFrame(
        [(c, float(v * sign)) for c, v in zip(cols, pc)], "feature string, loading double"
    ).orderBy(F.desc(F.abs("loading")), "feature")
    return out.limit(top_n) if top_n else out


def pca_extreme_row(model, df: DataFrame, cols: Sequence[str], id_col: str = "row_id", top_n: int = 5) -> DataFrame:
    """Row with the largest PC1 and its ``top_n`` standard scores by magnitude.

    ``df`` holds standard scores, so the values themselves are the z-scores.
    """
    scored = pca_transform(model, df, cols, [id_col, *cols])
    top = scored.agg(F.max_by(F.struct(id_col, "pc1", *cols), F.struct("pc1", -F.col(id_col))).alias("r")).select("r.*")
    return (
        top.unpivot([id_col, "pc1"], list(cols), "feature", "z")
        .orderBy(F.desc(F.abs("z")), "feature")
        .limit(top_n)
    )
