"""Parametric marginal distributions of many columns, fitted from sums and chosen by KS distance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import special
from faultline.functions.numeric import finite_or_null
from faultline.operators.prefix import coded_form, running_counts

# In this order: of equally close families the first is taken.
FAMILIES = ("beta", "gamma", "normal", "uniform")


@dataclass(frozen=True)
class Marginal:
    """A fitted distribution on ``low..high`` (the observed bounds) with two shape numbers."""

    family: str
    low: float
    high: float
    a: float = 0.0
    b: float = 0.0

    def cdf(self, x: np.ndarray) -> np.ndarray:
        x, span = np.asarray(x, dtype=float), self.high - self.low
        if self.family == "constant":
            return (x >= self.low).astype(float)
        if self.family == "two values":  # the middle of each value's share, so that scores are centred
            return np.where(x < self.high, (1 - self.a) / 2, 1 - self.a / 2)
        if self.family == "beta":
            return special.beta_cdf((x - self.low) / span, self.a, self.b)
        if self.family == "gamma":
            return special.gamma_cdf((x - self.low) / self.b, self.a)
        if self.family == "normal":
            return special.normal_cdf((x - self.a) / self.b)
        return np.clip((x - self.low) / span, 0.0, 1.0)

    def quantile(self, u: np.ndarray) -> np.ndarray:
        u = np.asarray(u, dtype=float)
        if self.family == "constant":
            return np.full(len(u), self.low)
        if self.family == "two values":
            return np.where(u <= 1 - self.a, self.low, self.high)
        if self.family == "normal":
            return self.a + self.b * special.normal_scores(u)
        if self.family == "uniform":
            return self.low + u * (self.high - self.low)
        top = self.high
        if self.family == "gamma":  # no upper bound: beyond it lies less than the grid of scores resolves
            top = self.low + self.b * (self.a + 40.0 * np.sqrt(self.a) + 60.0)
        return special.quantiles_of(self.cdf, u, self.low, top)


def moment_fits(n: int, mean: float, var: float, low: float, high: float) -> dict[str, Marginal]:
    """Families with the given moments: population variance, beta and uniform on the observed bounds, gamma from the lower one."""
    if not high > low or var <= 0:
        return {"constant": Marginal("constant", low, high)}
    m, v = (mean - low) / (high - low), var / (high - low) ** 2
    if abs(m * (1 - m) - v) < 1e-9:  # the greatest variance possible: only the bounds occur
        return {"two values": Marginal("two values", low, high, m)}
    size = m * (1 - m) / v - 1
    return {
        "beta": Marginal("beta", low, high, m * size, (1 - m) * size),
        "gamma": Marginal("gamma", low, high, (mean - low) ** 2 / var, var / (mean - low)),
        "normal": Marginal("normal", low, high, mean, float(np.sqrt(var))),
        "uniform": Marginal("uniform", low, high),
    }


def column_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, float, float, float, float]]:
    """Rows, mean, population variance, least and greatest value of each column that has values; one aggregation."""
    clean = df.select(*[finite_or_null(c).alias(f"c{i}") for i, c in enumerate(cols)])
    row = clean.agg(*[f(f"c{i}").alias(f"{k}{i}") for i in range(len(cols)) for k, f in
                      (("n", F.count), ("m", F.avg), ("v", F.var_pop), ("a", F.min), ("b", F.max))]).first()
    return {c: tuple(row[f"{k}{i}"] for k in "nmvab") for i, c in enumerate(cols) if row[f"n{i}"]}


def family_distances(df: DataFrame, fits: dict[str, dict[str, Marginal]], large: bool | None = None) -> DataFrame:
    """``(feature, family, distance)``: largest gap between empirical and fitted distribution function.

    The empirical one comes from running counts of distinct values; tasks keep one maximum
    per feature and family.
    """
    cols = list(fits)
    counts = coded_form(df, cols).groupBy("feature", "value").agg(F.count("*").alias("n"))
    run = running_counts(counts, ["feature"], "value", ["n"], large)

    def gaps(batches):
        worst: dict[tuple[int, str], float] = {}
        for pdf in batches:
            for i, part in pdf.groupby("feature", sort=False):
                upto = (part["cum_n"] / part["tot_n"]).to_numpy()
                before = upto - (part["n"] / part["tot_n"]).to_numpy()
                for family, fit in fits[cols[i]].items():
                    f = fit.cdf(part["value"].to_numpy())
                    gap = float(np.maximum(np.abs(upto - f), np.abs(before - f)).max())
                    worst[i, family] = max(worst.get((i, family), 0.0), gap)
        yield pd.DataFrame([(cols[i], k, d) for (i, k), d in worst.items()], columns=["feature", "family", "distance"])

    return run.mapInPandas(gaps, "feature string, family string, distance double").groupBy("feature", "family").agg(F.max("distance").alias("distance"))


def fit_marginals(df: DataFrame, cols: Sequence[str], families: Sequence[str] = FAMILIES, large: bool | None = None) -> dict[str, Marginal]:
    """The closest family of each column; columns of one or two values have a distribution of their own."""
    fits = {c: moment_fits(*m) for c, m in column_moments(df, cols).items()}
    open_ = {c: {k: f for k, f in found.items() if k in families} for c, found in fits.items() if len(found) > 1}
    best: dict[str, tuple[float, int]] = {}
    # One row per column and family.
    for r in family_distances(df, open_, large).collect() if open_ else ():
        best[r["feature"]] = min(best.get(r["feature"], (np.inf, 0)), (r["distance"], FAMILIES.index(r["family"])))
    return {c: found[FAMILIES[best[c][1]]] if c in best else next(iter(found.values())) for c, found in fits.items()}


def marginal_parameters(df: DataFrame, cols: Sequence[str], large: bool | None = None) -> DataFrame:
    """``(feature, family, distance, beta_a, beta_b, gamma_shape, gamma_scale, normal_mean, normal_sd, chosen)``.

    One row per column and family; columns of one or two values have none.
    """
    fits = {c: found for c, m in column_moments(df, cols).items() if len(found := moment_fits(*m)) > 1}
    schema = "feature string, family string, a double, b double, place int"
    rows = [(c, k, float(f.a), float(f.b), FAMILIES.index(k)) for c, found in fits.items() for k, f in found.items()]
    known = df.sparkSession.createDataFrame(rows, schema)
    if not fits:
        return known.selectExpr("feature", "family", "cast(null as double) as distance", "a", "b", "0 as chosen")
    # One row per column and family on both sides.
    both = known.join(family_distances(df, fits, large), ["feature", "family"])
    best = both.groupBy(F.col("feature").alias("_f")).agg(F.min(F.struct("distance", "place")).alias("_best"))
    return both.join(best, F.col("feature") == F.col("_f")).select(
        "feature", "family", "distance", "a", "b", (F.col("place") == F.col("_best.place")).cast("int").alias("chosen"))


def score_correlation(df: DataFrame, marginals: dict[str, Marginal]) -> np.ndarray:
    """Pearson correlation of the normal scores of the fitted distribution functions, in one pass over the rows."""
    cols = list(marginals)
    p = len(cols)
    # A distribution function is the dear part: it is tabulated once per column, with steps at its quantiles.
    u = special.normal_cdf(np.linspace(-6.0, 6.0, 1201))
    knots = [np.unique(np.concatenate([m.quantile(u), np.linspace(m.low, m.high, 257)])) for m in marginals.values()]
    tables = [special.normal_scores(np.clip(m.cdf(k), 1e-9, 1 - 1e-9)) for m, k in zip(marginals.values(), knots)]

    def partial(batches):
        total = np.zeros((p + 1, p + 1))
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), *[
                special.normal_scores(np.clip(m.cdf(v), 1e-9, 1 - 1e-9)) if m.family in ("two values", "constant") else np.interp(v, k, t)
                for m, k, t, v in zip(marginals.values(), knots, tables, pdf[cols].to_numpy(dtype=float).T)]])
            total += z.T @ z
        i, j = np.triu_indices(p + 1)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "s": total[i, j]})

    g = np.zeros((p + 1, p + 1))
    complete = df.select(*[finite_or_null(c).alias(c) for c in cols]).dropna()
    for r in complete.mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["s"]
    mean = g[0, 1:] / max(g[0, 0], 1.0)
    cov = g[1:, 1:] / max(g[0, 0], 1.0) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    corr = np.divide(cov, np.outer(sd, sd), out=np.zeros_like(cov), where=np.outer(sd, sd) > 1e-12)
    np.fill_diagonal(corr, 1.0)
    return corr
