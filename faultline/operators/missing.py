"""Missing-value flags, imputation with fitted constants, and missingness modules."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.pairs import pearson_matrix
from faultline.operators.prefix import quantile_map

FLAG = "_is_missing"


def flag_columns(df: DataFrame, cols: Sequence[str], min_share: float = 0.0) -> list[str]:
    """Columns whose NA share exceeds ``min_share`` (default: any missing value)."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if (row[i] or 0.0) > min_share]


def missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<c>_is_missing`` 0/1 columns; apply before imputing."""
    return df.withColumns({c + FLAG: F.col(c).isNull().cast("int") for c in cols})


def fit_medians(df: DataFrame, cols: Sequence[str], large: bool | None = None) -> dict[str, float]:
    """Exact medians of the given columns; all-NULL columns are left out."""
    return {c: v[0] for c, v in quantile_map(df, cols, [0.5], large).items()} if cols else {}


def fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Replace NULLs by fitted constants."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float(v))) for c, v in values.items()}) if values else df


def median_impute(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Impute with exact medians of ``train`` (or of ``df`` itself)."""
    return fill(df, fit_medians(train if train is not None else df, cols))


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0.0, subset=list(cols))


def missingness_correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(a, b, r, distance)``: |Pearson| of flags, undefined -> 0; distance = 1 - r."""
    flags = df.select(*[F.col(c).isNull().cast("double").alias(c + FLAG) for c in cols])
    m = pearson_matrix(flags, [c + FLAG for c in cols])
    return m.select("a", "b", F.coalesce(F.abs("r"), F.lit(0.0)).alias("r")).withColumn(
        "distance", F.greatest(F.lit(0.0), 1.0 - F.col("r"))
    )


def average_linkage(names: Sequence[str], dist: np.ndarray, cut: float) -> list[list[str]]:
    """Agglomerate a small distance matrix; stop when the closest pair is beyond ``cut``."""
    groups = [[n] for n in names]
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while len(groups) > 1:
        i, j = divmod(int(d.argmin()), len(groups))
        if d[i, j] > cut:
            break
        i, j = min(i, j), max(i, j)
        wi, wj = len(groups[i]), len(groups[j])
        merged = (wi * d[i] + wj * d[j]) / (wi + wj)
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        groups[i] += groups.pop(j)
    return sorted((sorted(g) for g in groups), key=lambda g: g[0])


def missingness_modules(df: DataFrame, cols: Sequence[str], cut: float = 0.5) -> dict[int, list[str]]:
    """Modules of co-missing columns, numbered by their smallest member.

    Spark computes the flag distances; only that p x p summary is clustered here.
    """
    cols = sorted(cols)
    pos = {c + FLAG: i for i, c in enumerate(cols)}
    dist = np.zeros((len(cols), len(cols)))
    for r in missingness_correlation(df, cols).collect():
        dist[pos[r["a"]], pos[r["b"]]] = r["distance"]
    return {i + 1: g for i, g in enumerate(average_linkage(cols, dist, cut))}


def module_connectivity(df: DataFrame, modules: dict[int, list[str]]) -> DataFrame:
    """Add ``Module_<i>_Connectivity`` = 1 if any column of the module is missing."""
    def any_missing(cols):
        flags = [F.col(c).isNull().cast("int") for c in cols]
        return F.greatest(*flags) if len(flags) > 1 else flags[0]

    return df.withColumns({f"Module_{i}_Connectivity": any_missing(cols) for i, cols in modules.items()})


def module_table(df: DataFrame, modules: dict[int, list[str]]) -> DataFrame:
    """``(module, feature, n_missing)`` for fitted modules."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for cs in modules.values() for c in cs]).first()
    return df.sparkSession.createDataFrame(
        [(i, c, int(row[c])) for i, cs in modules.items() for c in cs],
        "module int, feature string, n_missing long",
    )


def hardware_fingerprint(members: DataFrame, modules: Sequence[str] | None = None) -> DataFrame:
    """Feature x module 0/1 matrix from ``(feature, module)`` rows."""
    return (
        members.groupBy("feature")
        .pivot("module", list(modules) if modules else None)
        .agg(F.first(F.lit(1)))
        .na.fill(0)
    )
