"""Synthetic minority samples by interpolation or copula, and neighbour-based cleaning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import special
from faultline.functions.seeded import seeded_normal, seeded_uniform
from faultline.operators.knn import knn_self
from faultline.operators.marginals import Marginal, fit_marginals, score_correlation
from faultline.operators.order import seeded_rank


def _vector(cols: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in cols])


def _class_sizes(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    return row[0], row[1]


def smote(
    df: DataFrame, cols: Sequence[str], ratio: float = 1.0, k: int = 5, label: str = "label",
    seed: int = 42, id_col: str = "row_id",
) -> DataFrame:
    """Add int(n_maj * ratio - n_min) interpolated minority rows.

    Bases are dealt out evenly in seeded order (no draw, no join); neighbour and
    position come from hashes. Synthetic ids are negative: -(copy * n_min + rank).
    """
    n_maj, n_min = _class_sizes(df, label)
    extra = int(n_maj * ratio - n_min)
    base = df.select(id_col, label, *[F.col(c).cast("double").alias(c) for c in cols])
    if extra <= 0 or n_min < 2:
        return base
    minority = base.where(F.col(label) == 1).select(F.col(id_col).alias("id"), _vector(cols).alias("vec"))
    near = knn_self(minority, k, "id", "vec", seed)
    nbrs = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("nn", "nbr"))).alias("near"))
    each, rest = divmod(extra, n_min)
    copies = F.lit(each) + (F.col("rank") <= rest).cast("int")
    dealt = (
        seeded_rank(minority, (), seed, "id")
        .where(copies > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
        .join(nbrs, "id")
    )
    pick = F.floor(seeded_uniform(f"{seed}n", "id", "copy") * F.size("near")).cast("int")
    dealt = dealt.withColumn("nbr", F.get("near", pick)["nbr"])
    other = minority.select(F.col("id").alias("nbr"), F.col("vec").alias("to"))
    u = seeded_uniform(f"{seed}u", "id", "copy")
    made = dealt.join(other, "nbr").select(
        (-(F.col("copy") * F.lit(n_min) + F.col("rank"))).alias(id_col),
        F.lit(1).alias(label),
        F.zip_with("vec", "to", lambda a, b: a + u * (b - a)).alias("v"),
    )
    return base.unionByName(
        made.select(id_col, label, *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(cols)])
    )


def edited_neighbours(
    df: DataFrame, cols: Sequence[str], k: int = 3, kind: str = "all", label: str = "label",
    seed: int = 42, id_col: str = "row_id",
) -> DataFrame:
    """Drop rows whose neighbours disagree with their class.

    ``kind="all"``: every neighbour must agree; ``"mode"``: the majority must.
    """
    near = knn_self(df.select(id_col, _vector(cols).alias("vec")), k, id_col, "vec", seed)
    labels = df.select(F.col(id_col).alias("_id"), F.col(label).alias("_label"))
    votes = (
        near.join(labels.withColumnRenamed("_id", "nbr"), "nbr")
        .groupBy(F.col("id").alias("_i"))
        .agg(F.count_if(F.col("_label") == 1).alias("ones"), F.count("*").alias("n"))
    )
    same = F.when(F.col(label) == 1, F.col("ones")).otherwise(F.col("n") - F.col("ones"))
    keep = same == F.col("n") if kind == "all" else same * 2 > F.col("n")
    return df.join(votes, F.col(id_col) == F.col("_i")).where(keep).select(*df.columns)


def smote_enn(df: DataFrame, cols: Sequence[str], ratio: float = 1.0, label: str = "label", seed: int = 42,
              id_col: str = "row_id", kind: str = "all") -> DataFrame:
    """SMOTE, then removal of rows that their three neighbours contradict."""
    return edited_neighbours(smote(df, cols, ratio, 5, label, seed, id_col), cols, 3, kind, label, seed, id_col)


def tomek_links(df: DataFrame, cols: Sequence[str], label: str = "label", seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """``(id, nbr)`` with id < nbr: mutual nearest neighbours of different class."""
    near = knn_self(df.select(id_col, _vector(cols).alias("vec")), 1, id_col, "vec", seed).select("id", "nbr")
    back = near.select(F.col("id").alias("nbr"), F.col("nbr").alias("id"))
    labels = df.select(F.col(id_col).alias("_id"), F.col(label).alias("_label"))
    mutual = near.join(back, ["id", "nbr"]).where("id < nbr")
    return (
        mutual.join(labels.select(F.col("_id").alias("id"), F.col("_label").alias("la")), "id")
        .join(labels.select(F.col("_id").alias("nbr"), F.col("_label").alias("lb")), "nbr")
        .where("la <> lb")
        .select("id", "nbr")
    )


def smote_tomek(df: DataFrame, cols: Sequence[str], ratio: float = 1.0, label: str = "label", seed: int = 42,
                id_col: str = "row_id") -> DataFrame:
    """SMOTE, then removal of both ends of every Tomek link."""
    grown = smote(df, cols, ratio, 5, label, seed, id_col)
    links = tomek_links(grown, cols, label, seed, id_col)
    ends = links.select(F.explode(F.array("id", "nbr")).alias(id_col)).distinct()
    return grown.join(ends, id_col, "left_anti")


def _binary_columns(df: DataFrame, cols: Sequence[str]) -> set[str]:
    row = df.agg(*[F.bool_and(F.col(c).isin(0.0, 1.0)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    return {c for i, c in enumerate(cols) if row[i] or "is_missing" in c}


def copula_fit(minority: DataFrame, cols: Sequence[str]) -> tuple[dict[str, Marginal], np.ndarray]:
    """The closest parametric marginal of each column and the Cholesky factor of the normal scores' correlation."""
    marginals = fit_marginals(minority, cols)
    values, vectors = np.linalg.eigh(score_correlation(minority, marginals))
    fixed = vectors @ np.diag(np.maximum(values, 1e-8)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    return marginals, np.linalg.cholesky(fixed / np.outer(scale, scale))


def copula_balance(
    df: DataFrame, cols: Sequence[str], ratio: float = 1.0, label: str = "label", seed: int = 42,
    id_col: str = "row_id",
) -> DataFrame:
    """Add int(n_maj * ratio) - n_min minority rows drawn from a Gaussian copula.

    Marginals are beta, gamma, normal or uniform, whichever comes closest to the minority's values.
    No-op when the ratio is met; NULLs are an error. Binary columns are rounded into
    {0, 1}, others are >= 0, and columns named with a final digit are whole numbers.
    Synthetic ids are negative.
    """
    nulls = df.agg(F.count_if(sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)) > 0)).first()[0]
    if nulls:
        raise ValueError("copula_balance needs imputed columns: NULLs found")
    n_maj, n_min = _class_sizes(df, label)
    extra = int(n_maj * ratio) - n_min
    base = df.select(id_col, label, *[F.col(c).cast("double").alias(c) for c in cols])
    if extra <= 0 or n_min < 2:
        return base
    minority = base.where(F.col(label) == 1)
    binary = _binary_columns(base, cols)
    marginals, chol = copula_fit(minority, cols)
    # Quantiles tabulated by normal score; a column of two values has a step that no table keeps.
    knots = np.linspace(-8.0, 8.0, 1025)
    grids = [marginals[c].quantile(special.normal_cdf(knots)) for c in cols]
    whole = [c in binary or c[-1].isdigit() for c in cols]
    is_binary = [c in binary for c in cols]

    def draw(batches):
        for pdf in batches:
            z = pdf.drop(columns=[id_col]).to_numpy() @ chol.T
            out = {id_col: pdf[id_col], label: np.ones(len(pdf), dtype="int32")}
            for i, c in enumerate(cols):
                m = marginals[c]
                v = m.quantile(special.normal_cdf(z[:, i])) if m.family == "two values" else np.interp(z[:, i], knots, grids[i])
                v = np.maximum(0.0, v)
                v = np.round(v) if whole[i] else v
                out[c] = np.minimum(v, 1.0) if is_binary[i] else v
            yield pd.DataFrame(out)

    schema = f"{id_col} long, {label} int, " + ", ".join(f"`{c}` double" for c in cols)
    made = (
        df.sparkSession.range(1, extra + 1)
        .select((-F.col("id")).alias(id_col), *[seeded_normal(f"{seed}:{c}", "id").alias(c) for c in cols])
        .mapInPandas(draw, schema)
    )
    return base.unionByName(made)
