"""Column expressions for NULL hygiene and for the few p-values Spark lacks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_null(c: Column | str) -> Column:
    """NaN and +-inf become NULL, the library's only missing marker."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def safe_div(a: Column, b: Column, default: float | None = None) -> Column:
    """``a / b``, or ``default`` where ``b`` is zero."""
    return F.when(b != 0, a / b).otherwise(F.lit(default).cast("double"))


def kolmogorov_sf(x: Column, terms: int = 50) -> Column:
    """Kolmogorov limit survival function, 2*sum((-1)^(j-1) exp(-2 j^2 x^2))."""
    js = F.sequence(F.lit(1), F.lit(terms))
    series = F.aggregate(
        js,
        F.lit(0.0),
        lambda acc, j: acc
        + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * x * x),
    )
    # The alternating series converges slowly near 0, where the value is 1.
    return F.when(x < 0.2, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series))
    )


def ks_exact_p(n0: int, n1: int, gap: int, ends: Sequence[int] | None = None) -> float:
    """P(D >= d) of the two-sample Kolmogorov-Smirnov distance, every split of the pool equally likely.

    ``gap`` is d times n0 * n1, an integer. A split is a lattice path: after i + j pooled values,
    i of them of the smaller sample, the distance is |i n0 - j n1| / (n0 n1). Going from start to end, a
    place's chance of having reached the gap is that of its two predecessors, weighted i : j, or 1
    at the gap; all terms are positive, so small chances keep their digits. With ties the
    distance exists only after whole groups of equal values: ``ends`` are the pooled counts
    after each group. Without it the pool is taken as free of ties. Costs (n0 + n1) steps over the places
    within the gap.
    """
    if gap <= 0:
        return 1.0
    if n1 > n0:
        n0, n1 = n1, n0
    n, checked = n0 + n1, None if ends is None else set(map(int, ends))
    reached = np.zeros(n1 + 1)
    for s in range(1, n + 1):
        low, high = max(0, s - n0), min(n1, s)
        if checked is None:  # the places within the gap and one on either side
            low, high = max(low, -((gap - 1 - s * n1) // n) - 1), min(high, (s * n1 + gap - 1) // n + 1)
        i = np.arange(low, high + 1, dtype=np.int64)
        now = (i * reached[np.maximum(i - 1, 0)] + (s - i) * reached[i]) / s
        if checked is None or s in checked:
            now[np.abs(i * n - s * n1) >= gap] = 1.0
        reached[low : high + 1] = now
    return float(min(1.0, reached[n1]))


def digamma_count(x: Column) -> Column:
    """Digamma of a positive whole number: the recurrence up to 8 more, then the asymptotic series."""
    z = x.cast("double") + 8.0
    inv = 1.0 / (z * z)
    series = F.log(z) - 0.5 / z - inv * (1.0 / 12 - inv * (1.0 / 120 - inv * (1.0 / 252 - inv * (1.0 / 240 - inv * (1.0 / 132)))))
    for i in range(8):
        series = series - 1.0 / (x.cast("double") + float(i))
    return series


def normal_sf2(z: float) -> float:
    """Two-sided normal tail probability."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_sf(x: float, dof: int) -> float:
    """Chi-square survival function through the regularised upper incomplete gamma."""
    if dof <= 0 or x <= 0:
        return 1.0
    a, x = dof / 2.0, x / 2.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * lead)
    b, c = x + 1 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return min(1.0, lead * h)
