"""Scalers and discretisers: fitted on the driver as per-column constants, applied lazily."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.prefix import quantile_map

Affine = Mapping[str, tuple[float, float]]


def _per_column(df: DataFrame, cols: Sequence[str], **aggs) -> dict[str, dict[str, float]]:
    row = df.agg(*[fn(c).alias(f"{k}_{i}") for i, c in enumerate(cols) for k, fn in aggs.items()]).first()
    return {c: {k: row[f"{k}_{i}"] for k in aggs} for i, c in enumerate(cols)}


def fit_standard(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population sd; a zero sd becomes 1."""
    s = _per_column(df, cols, m=F.avg, s=F.stddev_pop)
    return {c: (v["m"] or 0.0, v["s"] or 1.0) for c, v in s.items()}


def fit_sample(df: DataFrame, cols: Sequence[str], eps: float = 1e-6) -> dict[str, tuple[float, float]]:
    s = _per_column(df, cols, m=F.avg, s=F.stddev_samp)
    return {c: (v["m"] or 0.0, (v["s"] or 0.0) + eps) for c, v in s.items()}


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    s = _per_column(df, cols, a=F.min, b=F.max)
    return {c: (v["a"] or 0.0, ((v["b"] or 0.0) - (v["a"] or 0.0)) or 1.0) for c, v in s.items()}


def fit_robust(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Exact median and interquartile range; a zero range becomes 1."""
    q = quantile_map(df, cols, [0.25, 0.5, 0.75])
    return {c: (v[1], (v[2] - v[0]) or 1.0) for c, v in q.items()}


def apply_affine(df: DataFrame, params: Affine) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, (m, s) in params.items()})


def standard_scale(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    return apply_affine(df, fit_standard(train if train is not None else df, cols))


def sample_scale(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    return apply_affine(df, fit_sample(train if train is not None else df, cols))


def minmax_scale(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    return apply_affine(df, fit_minmax(train if train is not None else df, cols))


def robust_scale(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    return apply_affine(df, fit_robust(train if train is not None else df, cols))


def apply_edges(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Right-closed intervals: bin = number of inner edges below the value; NULL -> 0."""
    def code(c, inner):
        hits = F.lit(0)
        for e in inner:
            hits = hits + (F.col(c) > F.lit(float(e))).cast("int")
        return F.coalesce(hits, F.lit(0)).cast("int")

    return df.withColumns({c: code(c, e) for c, e in edges.items()})


def more_than(df: DataFrame, cols: Sequence[str], k: int) -> list[str]:
    """Columns with more than ``k`` distinct non-null values, in one scan.

    A task hands on at most ``k + 1`` values of a column; so many distinct ones settle it.
    """
    names = list(cols)

    def few(batches):
        found: list[set] = [set() for _ in names]
        for pdf in batches:
            for i, seen in enumerate(found):
                if len(seen) <= k:
                    seen.update(pd.unique(pdf[f"c{i}"].dropna())[: k + 1].tolist())
        rows = [(i, v) for i, seen in enumerate(found) for v in sorted(seen)[: k + 1]]
        yield pd.DataFrame(rows, columns=["i", "v"]).astype({"i": "int32", "v": "float64"})

    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).mapInPandas(few, "i int, v double")
    many = {r["i"] for r in values.groupBy("i").agg(F.countDistinct("v").alias("n")).where(F.col("n") > k).collect()}
    return [c for i, c in enumerate(names) if i in many]


def fit_quantile_edges(df: DataFrame, cols: Sequence[str], bins: int = 3) -> dict[str, list[float]]:
    """Inner quantile edges with duplicates dropped, for columns with more than ``bins`` values."""
    wide = more_than(df, cols, bins)
    probs = [i / bins for i in range(bins + 1)]
    out = {}
    for c, q in quantile_map(df, wide, probs).items() if wide else ():
        # Dropping duplicate edges merges the empty intervals between them.
        kept = sorted(set(q))
        out[c] = kept[1:-1]
    return out


def quantile_discretise(df: DataFrame, cols: Sequence[str], bins: int = 3, train: DataFrame | None = None) -> DataFrame:
    """Quantile bins 0..bins-1; columns with few distinct values keep their value."""
    edges = fit_quantile_edges(train if train is not None else df, cols, bins)
    rest = {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in cols if c not in edges}
    return apply_edges(df, edges).withColumns(rest) if rest else apply_edges(df, edges)


def fit_equal_width_edges(df: DataFrame, cols: Sequence[str], bins: int = 3) -> dict[str, list[float]]:
    s = _per_column(df, cols, a=F.min, b=F.max)
    return {
        c: [v["a"] + (v["b"] - v["a"]) * i / bins for i in range(1, bins)] if v["a"] is not None else []
        for c, v in s.items()
    }


def equal_width_discretise(df: DataFrame, cols: Sequence[str], bins: int = 3, train: DataFrame | None = None) -> DataFrame:
    return apply_edges(df, fit_equal_width_edges(train if train is not None else df, cols, bins))
