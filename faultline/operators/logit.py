"""Batched logistic regressions by Newton steps on distributed sums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.numeric import finite_or_null, normal_sf2
from faultline.operators.pairs import pearson_matrix

Z95 = 1.959963984540054


def _batched(
    df: DataFrame, features: Sequence[str], control: str | None, label: str, prior: np.ndarray | None,
    rounds: int, tol: float,
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Fit y ~ 1 [+ control] + f for all features at once: ``{f: (coef, covariance)}``.

    One job per Newton round: every batch of rows folds into the sums of all features, so a
    task sends out one row per sum, whatever it read. Features without a fit are left out.
    """
    d = 3 if control else 2
    upper = np.triu_indices(d)
    width = d + len(upper[0])
    features = list(features)
    base = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("_y"),
        (finite_or_null(control).cast("double") if control else F.lit(0.0)).alias("_a"),
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
    )
    base = base.where(F.col("_a").isNotNull()).persist()
    beta = np.zeros((d, len(features)))
    out, live = {}, list(range(len(features)))
    precision = np.zeros((d, d)) if prior is None else np.diag(1.0 / prior**2)
    try:
        for _ in range(rounds):
            if not live:
                break
            sums = _feature_sums(base, live, beta[:, live], width)
            still = []
            for j, i in enumerate(live):
                h = np.zeros((d, d))
                h[upper] = sums[d:, j]
                h = h + np.triu(h, 1).T + precision
                # Collinear terms leave a matrix that is singular but for rounding.
                if not np.isfinite(h).all() or np.linalg.cond(h) > 1e12:
                    continue
                cov = np.linalg.inv(h)
                step = cov @ (sums[:d, j] - precision @ beta[:, i])
                beta[:, i] += np.clip(step, -5, 5)
                if np.abs(step).max() < tol:
                    out[features[i]] = (beta[:, i].copy(), cov)
                elif np.abs(beta[:, i]).max() <= 1e6:
                    still.append(i)
            live = still
    finally:
        base.unpersist()
    return out


def _feature_sums(base: DataFrame, live: Sequence[int], beta: np.ndarray, width: int) -> np.ndarray:
    """Gradient and upper triangle of the information, a column for each feature ``x<i>``; its NULL and NaN rows don't count."""
    d, cols = len(beta), [f"x{i}" for i in live]
    shape = (width, len(cols))

    def partial(batches):
        total = np.zeros(shape)
        for pdf in batches:
            y, a = pdf["_y"].to_numpy(dtype=float)[:, None], pdf["_a"].to_numpy(dtype=float)[:, None]
            x = pdf[cols].to_numpy(dtype=float)
            seen = np.isfinite(x)
            x = np.where(seen, x, 0.0)
            terms = [np.ones_like(a), a, x] if d == 3 else [np.ones_like(a), x]
            with np.errstate(over="ignore"):
                p = 1.0 / (1.0 + np.exp(-sum(b * t for b, t in zip(beta, terms))))
            e, w = np.where(seen, y - p, 0.0), np.where(seen, p * (1 - p), 0.0)
            parts = [e * t for t in terms] + [w * terms[i] * terms[j] for i in range(d) for j in range(i, d)]
            total += np.stack([q.sum(axis=0) for q in parts])
        yield pd.DataFrame({"k": np.arange(total.size, dtype="int32"), "v": total.ravel()})

    flat = np.zeros(width * len(cols))
    rows = base.select("_y", "_a", *cols).mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    for r in rows.collect():
        flat[r["k"]] = r["v"]
    return flat.reshape(shape)


def age_adjusted_logit(
    df: DataFrame, features: Sequence[str], control: str = "aa_000", label: str = "label", rounds: int = 30, tol: float = 1e-9
) -> DataFrame:
    """logit(y) ~ 1 + age + feature for each feature, largest |coefficient| first.

    Columns are expected on a standardised scale; a feature that does not converge
    (separation, collinearity) comes last, with ``converged`` false and NULLs.
    """
    wanted = [f for f in features if f != control]
    fits = _batched(df, wanted, control, label, None, rounds, tol)
    return _wald(df.sparkSession, wanted, {f: (b[2], v[2, 2], b[1]) for f, (b, v) in fits.items()})


def univariate_age_logit(df: DataFrame, control: str = "aa_000", label: str = "label", rounds: int = 30, tol: float = 1e-9) -> DataFrame:
    """logit(y) ~ 1 + age, in the same shape; its own control effect is 0."""
    fits = _batched(df, [control], None, label, None, rounds, tol)
    return _wald(df.sparkSession, [control], {f: (b[1], v[1, 1], 0.0) for f, (b, v) in fits.items()})


def _wald(spark, features: Sequence[str], fits: dict[str, tuple[float, float, float]]) -> DataFrame:
    rows = []
    for f, (coef, var, age) in fits.items():
        se = math.sqrt(max(var, 0.0))
        p = normal_sf2(coef / se) if se > 0 else 1.0
        coef = float(coef)
        rows.append((f, coef, math.exp(min(coef, 700)), p, coef - Z95 * se, coef + Z95 * se, float(age), True))
    rows.sort(key=lambda r: (-abs(r[1]), r[0]))
    rows += [(f, *[None] * 6, False) for f in sorted(set(features) - set(fits))]
    return spark.createDataFrame(
        rows, "feature string, coef double, odds_ratio double, p_value double, lower_ci double, upper_ci double, age_coef double, converged boolean"
    )


DRAWS = 4000


@dataclass
class Proposal:
    """Draws of a multivariate t around a posterior mode, to be weighted by the true posterior."""

    columns: list[str]  # the columns that the coefficients after the intercept belong to
    draws: np.ndarray  # draws x coefficients, the intercept first
    log_density: np.ndarray
    log_prior: np.ndarray


def propose(columns: Sequence[str], mode: np.ndarray, cov: np.ndarray, precision: np.ndarray, draws: int, seed: int, freedom: float = 5.0) -> Proposal:
    """Antithetic t draws with the mode's curvature; their tails are heavier than those of a posterior with normal priors."""
    rng = np.random.default_rng(seed)
    d, half = len(mode), -(-draws // 2)
    z = rng.standard_normal((half, d))
    stretch = np.sqrt(freedom / rng.chisquare(freedom, half))
    unit = np.concatenate([z * stretch[:, None], -z * stretch[:, None]])[:draws]
    b = mode + unit @ np.linalg.cholesky(cov).T
    return Proposal(list(columns), b, -(freedom + d) / 2 * np.log1p((unit**2).sum(axis=1) / freedom), -0.5 * ((b @ precision) * b).sum(axis=1))


def log_likelihoods(df: DataFrame, proposals: Sequence[Proposal], label: str, rows: int = 256) -> list[np.ndarray]:
    """The log likelihood of all draws of all proposals in one pass: a task adds its rows up, one sum per draw.

    A proposal counts the rows that have all its columns.
    """
    names = sorted({c for p in proposals for c in p.columns})
    at = {c: i for i, c in enumerate(names)}
    starts = np.cumsum([0, *[len(p.draws) for p in proposals]])

    def partial(batches):
        total = np.zeros(starts[-1])
        for pdf in batches:
            x, y = pdf[names].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float)
            for p, a in zip(proposals, starts):
                own = x[:, [at[c] for c in p.columns]]
                seen = np.isfinite(own).all(axis=1)
                own, truth = np.column_stack([np.ones(int(seen.sum())), own[seen]]), y[seen]
                for k in range(0, len(own), rows):  # bounds the memory: rows x draws
                    eta = own[k : k + rows] @ p.draws.T
                    total[a : a + len(p.draws)] += truth[k : k + rows] @ eta - np.logaddexp(0.0, eta).sum(axis=0)
        yield pd.DataFrame({"k": np.arange(len(total), dtype="int32"), "v": total})

    base = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in names])
    flat = np.zeros(starts[-1])
    for r in base.mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        flat[r["k"]] = r["v"]
    return [flat[a:b] for a, b in zip(starts, starts[1:])]


def smoothed_weights(log_ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Importance weights that add to 1, and the tail's Pareto shape.

    The largest ratios are replaced by the quantiles of a generalised Pareto distribution fitted to them
    (profile over its scale, averaged by likelihood), which takes the noise out of the tail; a shape above 0.7
    says that the proposal misses part of the posterior.
    """
    ratio = np.exp(log_ratio - log_ratio.max())
    s = len(ratio)
    tail = int(min(0.2 * s, 3 * np.sqrt(s)))
    order = np.argsort(ratio, kind="stable")
    shape = 0.0
    if tail >= 5 and ratio[order[-1]] > ratio[order[-tail - 1]]:
        cut = ratio[order[-tail - 1]]
        x = ratio[order[-tail:]] - cut
        m = 30 + int(np.sqrt(tail))
        theta = 1 / x[-1] + (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3 * max(x[int(tail / 4 + 0.5) - 1], 1e-300))
        theta = theta[np.abs(theta) > 1e-12]
        k = np.array([np.log1p(-t * x).mean() for t in theta])
        with np.errstate(divide="ignore", invalid="ignore"):
            profile = tail * (np.log(-theta / k) - k - 1)
        fine = np.isfinite(profile)
        weight = np.exp(profile[fine] - profile[fine].max())
        t = float((theta[fine] * weight).sum() / weight.sum())
        shape = float(np.log1p(-t * x).mean())
        scale = -shape / t
        p = (np.arange(1, tail + 1) - 0.5) / tail
        spread = scale * np.expm1(-shape * np.log1p(-p)) / shape if abs(shape) > 1e-9 else -scale * np.log1p(-p)
        ratio[order[-tail:]] = np.minimum(cut + spread, 1.0)
        shape = (shape * tail + 5) / (tail + 10)  # drawn to a half, as ten further values would do
    return ratio / ratio.sum(), shape


def shortest_interval(x: np.ndarray, weight: np.ndarray, share: float = 0.94) -> tuple[float, float]:
    """The narrowest range of ``x`` that holds ``share`` of the weight."""
    order = np.argsort(x, kind="stable")
    x, upto = x[order], np.cumsum(weight[order])
    before = upto - weight[order]
    stop = np.searchsorted(upto, before + share - 1e-12)
    start = np.flatnonzero(stop < len(x))
    if not len(start):
        return float(x[0]), float(x[-1])
    best = start[np.argmin(x[stop[start]] - x[start])]
    return float(x[best]), float(x[stop[best]])


def bayes_logit_by_feature(
    df: DataFrame, features: Sequence[str], control: str = "aa_000", label: str = "label",
    sd_beta: float = 2.5, sd_alpha: float = 1.0, draws: int = DRAWS, seed: int = 42,
) -> DataFrame:
    """Posterior mean and shortest 94 % interval of each feature's coefficient given age.

    Draws around the mode are weighted by the posterior itself: two kinds of jobs, the Newton
    rounds and one pass for the draws of all features. ``tail`` above 0.7 warns of a proposal too narrow.
    """
    prior = np.array([sd_alpha, sd_beta, sd_beta])
    wanted = [f for f in features if f != control]
    fits = _batched(df, wanted, control, label, prior, 50, 1e-9)
    precision = np.diag(1 / prior**2)
    found = [f for f in wanted if f in fits]
    proposals = [propose([control, f], *fits[f], precision, draws, seed + i) for i, f in enumerate(found)]
    seen = log_likelihoods(df, proposals, label) if proposals else []
    return _posterior(df.sparkSession, wanted, {f: (p, v, 2) for f, p, v in zip(found, proposals, seen)})


def _posterior(spark, features: Sequence[str], fits: dict[str, tuple[Proposal, np.ndarray, int]], converged: bool = True) -> DataFrame:
    rows = []
    for f, (p, likelihood, i) in fits.items():
        weight, shape = smoothed_weights(likelihood + p.log_prior - p.log_density)
        b = p.draws[:, i]
        mean, (low, high) = float(weight @ b), shortest_interval(b, weight)
        rows.append((f, mean, math.exp(min(mean, 700)), low, high, shape, converged))
    rows.sort(key=lambda r: (-abs(r[1]), r[0]))
    rows += [(f, *[None] * 5, False) for f in sorted(set(features) - set(fits))]
    return spark.createDataFrame(rows, "feature string, mean double, odds_ratio double, hdi_3 double, hdi_97 double, tail double, converged boolean")


def newton_sums(df: DataFrame, cols: Sequence[str], beta: np.ndarray, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and information of one joint logistic model, one row per partition summed by Spark."""
    d = len(cols) + 1

    def partial(batches):
        total = np.zeros(d + d * d)
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[list(cols)].to_numpy(dtype=float)])
            p = 1.0 / (1.0 + np.exp(-(x @ beta)))
            total[:d] += x.T @ (pdf[label].to_numpy(dtype=float) - p)
            total[d:] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        yield pd.DataFrame({"k": np.arange(len(total), dtype="int32"), "v": total})

    rows = df.select(label, *cols).mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(d + d * d)
    for r in rows:
        flat[r["k"]] = r["v"]
    return flat[:d], flat[d:].reshape(d, d)


def collinearity_prune(df: DataFrame, features: Sequence[str], label: str = "label", limit: float = 0.8) -> list[str]:
    """Drop, pair by pair in order, the less label-correlated of two features with |r| > limit.

    Correlations come from Spark; ties drop the second.
    """
    r = {(x["a"], x["b"]): abs(x["r"] or 0.0) for x in pearson_matrix(df, [*features, label]).collect()}
    gone: set[str] = set()
    for i, a in enumerate(features):
        for b in features[i + 1 :]:
            if a in gone or b in gone or r[(a, b)] <= limit:
                continue
            # Equal columns may differ in the last bits of their sums.
            gone.add(a if r[(a, label)] < r[(b, label)] - 1e-12 else b)
    return [f for f in features if f not in gone]


def bayes_logit(
    df: DataFrame, features: Sequence[str], label: str = "label", sd_beta: float = 2.5, sd_alpha: float = 1.0,
    rounds: int = 50, tol: float = 1e-9, draws: int = DRAWS, seed: int = 42,
) -> DataFrame:
    """Joint posterior after the collinearity prune: means and shortest 94 % intervals.

    Draws around the mode are weighted by the posterior itself, all in one pass over the rows.
    """
    from faultline.operators.scaling import sample_scale

    kept = collinearity_prune(df, features, label)
    x = sample_scale(df.where(F.col(label).isNotNull()).select(label, *kept), kept).persist()
    beta = np.zeros(len(kept) + 1)
    precision = np.diag([1 / sd_alpha**2] + [1 / sd_beta**2] * len(kept))
    converged = False
    for _ in range(rounds):
        g, h = newton_sums(x, kept, beta, label)
        cov = np.linalg.inv(h + precision)
        step = cov @ (g - precision @ beta)
        beta = beta + step
        converged = bool(np.abs(step).max() < tol)
        if converged:
            break
    proposal = propose(kept, beta, cov, precision, draws, seed)
    seen = log_likelihoods(x, [proposal], label)[0]
    x.unpersist()
    return _posterior(df.sparkSession, kept, {f: (proposal, seen, i + 1) for i, f in enumerate(kept)}, converged)
