"""Contingency tables and conditional chi-square tests, a whole batch per job."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.numeric import chi2_sf

Test = tuple[str, str, tuple[str, ...]]


def code_ranges(df: DataFrame, names: Sequence[str], levels: int) -> tuple[dict[str, int], dict[str, int]]:
    """Lowest code (at most 0) and number of codes (at least ``levels``) of each column."""
    row = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("a", F.min), ("b", F.max))]).first()
    low = {c: min(int(row[f"a{i}"] or 0), 0) for i, c in enumerate(names)}
    return low, {c: max(int(row[f"b{i}"] or 0) - low[c] + 1, levels) for i, c in enumerate(names)}


def code_weights(radices: Sequence[int]) -> np.ndarray:
    weights = [1]
    for r in radices:
        weights.append(weights[-1] * r)
    if weights[-1] > 1 << 62:
        raise ValueError("the columns of a test have too many codes; discretise them first")
    return np.array(weights[:-1], dtype="int64")


def contingency(df: DataFrame, tests: Sequence[Test], levels: int = 3, by: str | None = None) -> DataFrame:
    """``([by,] test, z, x, y, n)``: counts of integer codes for each (x, y | z).

    ``z`` numbers the strata: the codes of the conditioning columns as digits, the first one
    lowest. Codes outside 0..levels-1 widen the radix of their column, so that they keep apart;
    tests whose columns span more than 2^62 cells are refused.

    Tests over the same set of variables share one count. Each task folds its rows into
    the cells that occur and emits only those.
    """
    tests = list(tests)
    names = sorted({c for x, y, z in tests for c in (x, y, *z)})
    at = {c: i for i, c in enumerate(names)}
    sets = sorted({tuple(sorted({x, y, *z})) for x, y, z in tests})
    low, radix = code_ranges(df, names, levels)
    weights = {s: code_weights([radix[c] for c in s]) for s in sets}
    base = np.array([low[c] for c in names], dtype="int64")
    key = [by] if by else []

    def cells(run, counts):
        for t, (x, y, z) in enumerate(tests):
            s = tuple(sorted({x, y, *z}))
            code, size = counts[s]
            digit = {c: code // w % radix[c] for c, w in zip(s, weights[s])}
            strata = sum((digit[c] * w for c, w in zip(z, code_weights([radix[c] for c in z]))), np.zeros(len(code), dtype="int64"))
            out = pd.DataFrame({"test": np.int32(t), "z": strata, "x": (digit[x] + low[x]).astype("int32"),
                                "y": (digit[y] + low[y]).astype("int32"), "n": size})
            if by:
                out.insert(0, by, run)
            yield out

    def fold(batches):
        held: dict = {}
        for pdf in batches:
            for run, part in pdf.groupby(by, sort=False) if by else [(None, pdf)]:
                codes = part[names].to_numpy(dtype="int64") - base
                mine = held.setdefault(run, {})
                for s in sets:
                    code, size = np.unique(codes[:, [at[c] for c in s]] @ weights[s], return_counts=True)
                    if s in mine:
                        both = np.concatenate([mine[s][0], code])
                        code, place = np.unique(both, return_inverse=True)
                        size = np.bincount(place, np.concatenate([mine[s][1], size])).astype("int64")
                    mine[s] = code, size
            # Many runs in one task: hand on what is held instead of keeping it.
            while len(held) > 64:
                yield from cells(*held.popitem())
        for run, counts in held.items():
            yield from cells(run, counts)

    kind = f"{by} {dict(df.dtypes)[by]}, " if by else ""
    return (
        df.select(*key, *names)
        .mapInPandas(fold, kind + "test int, z long, x int, y int, n long")
        .groupBy(*key, "test", "z", "x", "y")
        .agg(F.sum("n").alias("n"))
    )


def chi_square(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., test, stat, dof)`` from contingency cells, summed over strata.

    Per stratum: sum n^2 N / (row col) - N, with (rows - 1)(cols - 1) degrees of freedom
    over the levels that occur. Cells number at most levels**|set| per test.
    """
    key = [*by, "test", "z"]
    w = Window.partitionBy(*key)
    nx = F.sum("n").over(Window.partitionBy(*key, "x"))
    ny = F.sum("n").over(Window.partitionBy(*key, "y"))
    one_x = F.row_number().over(Window.partitionBy(*key, "x").orderBy("y")) == 1
    one_y = F.row_number().over(Window.partitionBy(*key, "y").orderBy("x")) == 1
    n = F.col("n").cast("double")
    strata = (
        cells.select("*", nx.alias("nx"), ny.alias("ny"), F.sum("n").over(w).alias("nz"),
                     one_x.cast("int").alias("fx"), one_y.cast("int").alias("fy"))
        .groupBy(*key)
        .agg(
            (F.sum(n * n * F.col("nz") / (F.col("nx") * F.col("ny").cast("double"))) - F.max("nz")).alias("stat"),
            ((F.sum("fx") - 1) * (F.sum("fy") - 1)).alias("dof"),
        )
    )
    return strata.groupBy(*by, "test").agg(F.sum("stat").alias("stat"), F.sum("dof").alias("dof"))


def chisq_ci(df: DataFrame, tests: Sequence[Test], levels: int = 3, alpha: float = 0.05) -> DataFrame:
    """``(test, x, y, z, stat, dof, p_value, independent)``; the p-value is a per-test summary."""
    rows = []
    for r in chi_square(contingency(df, tests, levels)).collect():
        x, y, z = tests[r["test"]]
        p = chi2_sf(r["stat"], r["dof"])
        rows.append((r["test"], x, y, ",".join(z), float(r["stat"]), int(r["dof"]), p, int(p > alpha)))
    return df.sparkSession.createDataFrame(
        rows, "test int, x string, y string, z string, stat double, dof int, p_value double, independent int"
    )
