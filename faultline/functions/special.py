"""Distribution functions over numpy arrays, for fitted parameters on executors and driver."""

from __future__ import annotations

import math

import numpy as np

_GRID = np.linspace(-8.0, 8.0, 8193)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(z, dtype=float) / math.sqrt(2.0))


_GRID_CDF = normal_cdf(_GRID)


def normal_scores(u: np.ndarray) -> np.ndarray:
    """Normal quantiles of probabilities, -8 to 8, by interpolation on a fine grid."""
    return np.interp(u, _GRID_CDF, _GRID)


def beta_cdf(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    x = np.clip(np.asarray(x, dtype=float), 0.0, 1.0)
    # The fraction converges fast below this point; above it the other tail does.
    turned = x > (a + 1.0) / (a + b + 2.0)
    y = np.where(turned, 1.0 - x, x)
    p, q = np.where(turned, b, a), np.where(turned, a, b)
    with np.errstate(divide="ignore"):
        lead = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1.0 / _off_zero(1.0 - (p + q) * y / (p + 1.0), tiny)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1.0 / _off_zero(1.0 + top * d, tiny)
            c = _off_zero(1.0 + top / c, tiny)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-14):
            break
    tail = np.where(y > 0, np.clip(lead * h, 0.0, 1.0), 0.0)
    return np.where(turned, 1.0 - tail, tail)


def gamma_cdf(x: np.ndarray, shape: float) -> np.ndarray:
    """Regularised lower incomplete gamma function: the series below the shape, the fraction above."""
    x = np.maximum(np.asarray(x, dtype=float), 0.0)
    out = np.zeros_like(x)
    low = (x > 0) & (x < shape + 1.0)
    high = x >= shape + 1.0
    with np.errstate(divide="ignore"):
        lead = np.exp(-x + shape * np.log(x) - math.lgamma(shape))
    if low.any():
        term = np.full(int(low.sum()), 1.0 / shape)
        total = term.copy()
        for n in range(1, 5000):
            term = term * x[low] / (shape + n)
            total = total + term
            if np.all(term < total * 1e-16):
                break
        out[low] = total * lead[low]
    if high.any():
        v, tiny = x[high], 1e-300
        b = v + 1.0 - shape
        c, d = np.full_like(v, 1.0 / tiny), 1.0 / _off_zero(b, tiny)
        h = d.copy()
        for i in range(1, 5000):
            top = -i * (i - shape)
            b = b + 2.0
            d = 1.0 / _off_zero(top * d + b, tiny)
            c = _off_zero(b + top / c, tiny)
            h = h * d * c
            if np.all(np.abs(d * c - 1.0) < 1e-15):
                break
        out[high] = 1.0 - h * lead[high]
    return np.clip(out, 0.0, 1.0)


def _off_zero(x: np.ndarray, tiny: float) -> np.ndarray:
    return np.where(np.abs(x) < tiny, tiny, x)


def quantiles_of(cdf, u: np.ndarray, low: float, high: float, steps: int = 80) -> np.ndarray:
    """Quantiles of an increasing distribution function between two bounds, by halving."""
    a, b = np.full(len(u), low), np.full(len(u), high)
    for _ in range(steps):
        mid = (a + b) / 2
        right = cdf(mid) < u
        a, b = np.where(right, mid, a), np.where(right, b, mid)
    return (a + b) / 2
