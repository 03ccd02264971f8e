"""Second moments of all column pairs in one pass, with pairwise-complete rows.

Every partition keeps running sums for its rows in numpy and emits one small row per
pair; Spark adds them up. Rows never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.numeric import finite_or_null

_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(finite_or_null(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[i] if row[i] is not None else 0.0) for i, c in enumerate(cols)}


def pair_moments(df: DataFrame, cols: Sequence[str], center: dict[str, float] | None = None) -> DataFrame:
    """``(i, j, n, sx, sy, sxx, syy, sxy)`` for pairs i <= j of positions in ``cols``.

    Sums are over rows where both columns are present, after subtracting ``center``.
    """
    cols = list(cols)
    shift = np.array([(center or {}).get(c, 0.0) for c in cols])
    upper = np.triu_indices(len(cols))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - shift
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            m = seen.astype(float)
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame(
                {
                    "i": upper[0].astype("int32"),
                    "j": upper[1].astype("int32"),
                    **{s: total[k][upper] for k, s in enumerate(_SUMS)},
                }
            )

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)
    return (
        df.select(*[finite_or_null(c).alias(c) for c in cols])
        .mapInPandas(partial, schema)
        .groupBy("i", "j")
        .agg(*[F.sum(s).alias(s) for s in _SUMS])
    )


def _corr_expr():
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    floor_x = F.lit(1e-12) * F.greatest(F.col("sxx"), F.lit(1e-300))
    floor_y = F.lit(1e-12) * F.greatest(F.col("syy"), F.lit(1e-300))
    return F.when((F.col("n") > 1) & (vx > floor_x) & (vy > floor_y), cov / F.sqrt(vx * vy))


def pearson_matrix(df: DataFrame, cols: Sequence[str], center: dict[str, float] | None = None) -> DataFrame:
    """``(a, b, r)`` for every ordered pair of columns, diagonal included.

    Columns are centred by their means unless ``center`` is given.
    """
    cols = list(cols)
    center = column_means(df, cols) if center is None else center
    half = pair_moments(df, cols, center).select("i", "j", _corr_expr().alias("r"))
    names = F.array(*[F.lit(c) for c in cols])
    both = half.unionByName(half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    return both.select(F.get(names, "i").alias("a"), F.get(names, "j").alias("b"), "r")


def high_corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Pairs with threshold < |r| < 1, in both directions."""
    r = F.abs("r")
    return pearson_matrix(df, cols).where((F.col("a") != F.col("b")) & (r > threshold) & (r < 1))


def moments_to_numpy(df: DataFrame, cols: Sequence[str], center: dict[str, float] | None = None) -> dict[str, np.ndarray]:
    """Collect the p x p sums (a per-feature summary) for a small solve on the driver."""
    p = len(cols)
    out = {s: np.zeros((p, p)) for s in _SUMS}
    for r in pair_moments(df, cols, center).collect():
        i, j = r["i"], r["j"]
        for s in _SUMS:
            out[s][i, j] = r[s]
        for s, t in (("n", "n"), ("sxy", "sxy"), ("sx", "sy"), ("sy", "sx"), ("sxx", "syy"), ("syy", "sxx")):
            out[s][j, i] = r[t]
    return out
