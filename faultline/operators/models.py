"""Estimator registry and scoring on MLlib."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.sampling import fitted_weights, with_weights

Builder = Callable[[int], object]


def model_registry(seed: int = 42, iterations: int = 20, depth: int = 5) -> dict[str, Builder]:
    """Model name -> function of the feature count that returns an unfitted estimator.

    Boosting libraries are replaced by MLlib's gradient-boosted trees. Class weights go
    through ``weightCol``; ``*_pos50`` uses a fixed positive weight instead.
    """
    common = dict(featuresCol="features", labelCol="label")
    weighted = dict(common, weightCol="weight")
    return {
        "gbt": lambda n: GBTClassifier(maxIter=iterations, maxDepth=depth, seed=seed, **weighted),
        "hist_gbt": lambda n: GBTClassifier(
            maxIter=iterations, maxDepth=depth, seed=seed, maxBins=255, subsamplingRate=0.8, **weighted
        ),
        "gbt_pos50": lambda n: GBTClassifier(maxIter=iterations, maxDepth=depth, seed=seed, **weighted),
        "logistic": lambda n: LogisticRegression(maxIter=1000, **weighted),
        "forest": lambda n: RandomForestClassifier(numTrees=iterations, maxDepth=depth, seed=seed, **weighted),
        "tree": lambda n: DecisionTreeClassifier(maxDepth=depth, seed=seed, **weighted),
        "mlp": lambda n: MultilayerPerceptronClassifier(
            layers=[n, 16, 2], maxIter=iterations * 5, seed=seed, **common
        ),
    }


def assemble(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="error").transform(df)


def fit_model(name: str, train: DataFrame, cols: Sequence[str], registry: dict[str, Builder] | None = None):
    """Fit a registered model on labelled rows with class weights attached."""
    builder = (registry or model_registry())[name]
    scheme = "positive" if name.endswith("_pos50") else "balanced"
    rows = with_weights(train, fitted_weights(train, scheme=scheme))
    ready = assemble(rows, cols).select("features", F.col("label").cast("double").alias("label"), "weight")
    return builder(len(cols)).fit(ready)


def predict(model, df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """``(keep..., prob)``: probability of class 1."""
    out = model.transform(assemble(df.select(*dict.fromkeys([*keep, *cols])), cols))
    return out.select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias("prob"))
