"""Iterative chained imputation by ridge regression on distributed Gram sums.

The state of the imputation is never stored: the fitted steps are a few numbers each, and a pass over the
source rows replays them in the task before it adds up the sums of the next step. Only missing cells
are recomputed, so a replay costs what is missing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.numeric import finite_or_null
from faultline.operators.pairs import column_means, moments_to_numpy

Step = tuple[str, float, dict[str, float]]


class _Replay:
    """Rows of one batch with their missing cells at the means, moved on step by step."""

    def __init__(self, x: np.ndarray, cols: Sequence[str], means: dict[str, float]):
        self.at = {c: i for i, c in enumerate(cols)}
        self.gap = ~np.isfinite(x)
        self.x = np.where(self.gap, np.array([means[c] for c in cols]), x)
        self._rows = [np.flatnonzero(g) for g in self.gap.T]

    def apply(self, steps: Sequence[Step]) -> None:
        for target, intercept, coefs in steps:
            t = self.at[target]
            rows = self._rows[t]
            if len(rows):
                known = self.x[np.ix_(rows, [self.at[c] for c in coefs])]
                self.x[rows, t] = np.maximum(0.0, intercept + known @ np.array(list(coefs.values())))


@dataclass
class MiceModel:
    """Initial means and the sequence of fitted linear steps, round by round, in order."""

    means: dict[str, float]
    steps: list[list[Step]] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """The fitted rounds replayed on each batch of rows: no table is written, streams work alike.

        Missing (NULL, NaN, infinite) values of the model's columns are replaced; the rest is unchanged.
        """
        cols, kept = list(self.means), df.columns
        rest = [c for c in kept if c not in cols]
        packed = df.select(*rest, F.array(*[finite_or_null(c) for c in cols]).alias("_x"))
        means, steps = self.means, self.steps

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = np.array(pdf["_x"].tolist(), dtype=float).reshape(len(pdf), len(cols))
                rows = _Replay(x, cols, means)
                for done in steps:
                    rows.apply(done)
                out = pdf.drop(columns="_x")
                out["_x"] = list(rows.x)
                yield out

        filled = packed.mapInPandas(run, packed.schema)
        at = {c: i for i, c in enumerate(cols)}
        return filled.select(*[F.get("_x", F.lit(at[c])).alias(c) if c in at else F.col(c) for c in kept])


def ridge_solve(n: float, s: np.ndarray, ss: np.ndarray, center: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Ridge of the last column on the standardised others, on the original scale, from sums about ``center``."""
    cov = ss - np.outer(s, s) / n
    sd = np.sqrt(np.maximum(cov.diagonal()[:-1] / n, 0.0))
    sd[sd == 0] = 1.0
    zz = cov[:-1, :-1] / np.outer(sd, sd)
    beta = np.linalg.solve(zz + alpha * np.eye(len(sd)), cov[:-1, -1] / sd) / sd
    mean = center + s / n
    return float(mean[-1] - beta @ mean[:-1]), beta


def ridge_step(
    observed: DataFrame, target: str, predictors: Sequence[str], alpha: float, center: dict[str, float] | None = None
) -> tuple[float, dict[str, float]]:
    """Ridge of ``target`` on standardised predictors, returned on the original scale.

    ``center`` (any values near the means) keeps the sums well scaled.
    """
    cols = [*predictors, target]
    center = center or column_means(observed, cols)
    m = moments_to_numpy(observed, cols, center)
    intercept, beta = ridge_solve(m["n"][-1, -1], m["sx"].diagonal(), m["sxy"], np.array([center[c] for c in cols]), alpha)
    return intercept, dict(zip(predictors, beta.tolist()))


def _sums(rows: DataFrame, model: MiceModel, begun: Sequence[Step], target: str | None) -> tuple[float, np.ndarray, float]:
    """One pass: rows with ``target`` observed and their sums after the steps so far, and the last whole round's largest change.

    Sums are of (1, column values about the means); the change of a row is the sum over its columns.
    """
    cols = list(model.means)
    p, means, steps = len(cols), model.means, model.steps
    center, at = np.array([means[c] for c in cols]), cols.index(target) if target else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, change = np.zeros((p + 1, p + 1)), 0.0
        for pdf in batches:
            rows = _Replay(np.array(pdf["_x"].tolist(), dtype=float).reshape(len(pdf), p), cols, means)
            for done in steps[:-1]:
                rows.apply(done)
            before = rows.x.copy()
            for done in steps[-1:]:
                rows.apply(done)
            change = max(change, float(np.abs(rows.x - before).sum(axis=1).max(initial=0.0)))
            if at is not None:
                rows.apply(begun)
                z = np.column_stack([np.ones(len(rows.x)), rows.x - center])[~rows.gap[:, at]]
                total += z.T @ z
        i, j = np.triu_indices(p + 1)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "s": total[i, j], "change": change})

    g, change = np.zeros((p + 1, p + 1)), 0.0
    for r in rows.mapInPandas(run, "i int, j int, s double, change double").groupBy("i", "j").agg(F.sum("s").alias("s"), F.max("change").alias("change")).collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["s"]
        change = max(change, r["change"])
    return g[0, 0], g, change


def mice_fit(
    df: DataFrame, cols: Sequence[str], alpha: float = 10.0, max_rounds: int = 1000, tol: float = 1e-3
) -> tuple[MiceModel, DataFrame]:
    """Fit on ``df``; returns the model and the imputed table, a lazy projection of ``df``.

    Columns are visited from fewest to most missing. A visit is one pass over the source rows, those with the
    target observed add to the sums; the k x k solve is on the driver. The pass of a round's first visit also
    tells how far the round before moved the rows, so stopping costs no pass of its own. Stops when the largest
    row change of a round falls below ``tol`` times the largest observed magnitude. Nothing is written.
    """
    cols = list(cols)
    clean = df.select(*[finite_or_null(c).alias(f"c{i}") for i, c in enumerate(cols)])
    stats = clean.agg(
        *[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(cols))],
        *[F.count_if(F.col(f"c{i}").isNull()).alias(f"g{i}") for i in range(len(cols))],
        F.max(F.greatest(*[F.abs(F.coalesce(f"c{i}", F.lit(0.0))) for i in range(len(cols))], F.lit(0.0))).alias("top"),
    ).first()
    gaps = {c: stats[f"g{i}"] for i, c in enumerate(cols)}
    order = sorted((c for c in cols if gaps[c] > 0), key=lambda c: gaps[c])
    model = MiceModel({c: float(stats[f"m{i}"] or 0.0) for i, c in enumerate(cols)})
    if len(cols) < 2 or not order:
        return model, model.transform(df)
    rows = clean.select(F.array(*[F.col(f"c{i}") for i in range(len(cols))]).alias("_x"))
    center = np.array([model.means[c] for c in cols])
    while len(model.steps) < max_rounds:
        done: list[Step] = []
        for target in order:
            n, g, change = _sums(rows, model, done, target)
            if not done and model.steps and change < tol * stats["top"]:
                return model, model.transform(df)
            if n == 0:  # nothing of the column is observed: its mean, 0, stays
                continue
            predictors = [c for c in cols if c != target]
            at = [cols.index(c) for c in [*predictors, target]]
            sums = [1 + i for i in at]
            intercept, beta = ridge_solve(n, g[0, sums], g[np.ix_(sums, sums)], center[at], alpha)
            done.append((target, intercept, dict(zip(predictors, beta.tolist()))))
        model.steps.append(done)
    return model, model.transform(df)
