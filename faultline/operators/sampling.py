"""Seeded splits, folds and class samples, exact in size and independent of partitioning."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.order import seeded_rank, seeded_take


def stratified_split(
    df: DataFrame, share: float = 0.8, label: str = "label", seed: int = 42, id_col: str = "row_id"
) -> DataFrame:
    """Add ``is_train``: the first round(share * n) rows of each class in seeded order."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n")).withColumnRenamed(label, "_l")
    ranked = seeded_rank(df, [label], seed, id_col, "_rank")
    # One row per class.
    return ranked.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_l"))).select(
        *df.columns, (F.col("_rank") <= F.round(F.col("_n") * F.lit(share))).cast("int").alias("is_train")
    )


def split_frames(df: DataFrame, share: float = 0.8, label: str = "label", seed: int = 42, id_col: str = "row_id"):
    marked = stratified_split(df, share, label, seed, id_col)
    return marked.where("is_train = 1").drop("is_train"), marked.where("is_train = 0").drop("is_train")


def stratified_kfold(
    df: DataFrame, k: int, label: str = "label", seed: int = 42, id_col: str = "row_id"
) -> DataFrame:
    """Add ``fold`` 0..k-1; every class is dealt out in seeded order."""
    return seeded_rank(df, [label], seed, id_col, "_rank").select(
        *df.columns, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int").alias("fold")
    )


def undersample_majority(
    df: DataFrame, ratio: float = 1.0, label: str = "label", seed: int = 42, id_col: str = "row_id"
) -> DataFrame:
    """All positives and int(n_pos * ratio) negatives without replacement."""
    n_pos = df.where(F.col(label) == 1).agg(F.count("*")).first()[0]
    negatives = seeded_take(df.where(F.col(label) == 0), int(n_pos * ratio), (), seed, id_col)
    return df.where(F.col(label) == 1).unionByName(negatives)


def row_subsample(df: DataFrame, n: int, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Exactly min(n, rows) rows in seeded order."""
    return seeded_take(df, n, (), seed, id_col)


def class_weights(df: DataFrame, label: str = "label", scheme: str = "balanced", pos_weight: float = 50.0) -> DataFrame:
    """``(label, n, weight)``: balanced n/(2 n_c), or ``pos_weight`` for class 1."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    if scheme == "positive":
        return sizes.withColumn("weight", F.when(F.col(label) == 1, float(pos_weight)).otherwise(1.0))
    total = sizes.agg(F.sum("n"), F.count("*")).first()
    return sizes.withColumn("weight", F.lit(float(total[0])) / (F.lit(total[1]) * F.col("n")))


def fitted_weights(df: DataFrame, label: str = "label", scheme: str = "balanced", pos_weight: float = 50.0) -> dict[object, float]:
    """``class_weights`` as numbers, by one job: one for each class."""
    sizes = {r[label]: r["n"] for r in class_weights(df, label, "positive").collect()}
    if scheme == "positive":
        return {c: float(pos_weight) if c == 1 else 1.0 for c in sizes}
    total = float(sum(sizes.values()))
    return {c: total / (len(sizes) * n) for c, n in sizes.items()}


def with_weights(df: DataFrame, weights: DataFrame | Mapping, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach class weights as a literal expression."""
    expr = F.lit(1.0)
    pairs = weights.items() if isinstance(weights, Mapping) else [(r[label], r["weight"]) for r in weights.collect()]
    for c, weight in pairs:
        expr = F.when(F.col(label) == c, F.lit(float(weight))).otherwise(expr)
    return df.withColumn(out, expr)
