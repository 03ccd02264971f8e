"""Features of one histogram row, as column expressions.

A histogram is a list of bin columns in order. Bins are known at plan time, so every
feature is plain arithmetic that stays inside whole-stage code generation; an array
column is adapted with ``bins_of``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS_TOTAL = 1e-9
EPS_LOG = 1e-12
EPS_SD = 1e-6
EPS_MILEAGE = 1e-3

# Which families weigh high bins, low bins, or have no intensity.
INTENSITY = {
    "ay": "DCI",
    "ag": "LLI",
    "cn": "LLI",
    "cs": "LLI",
    "az": "LLI",
    "ee": None,
    "ba": None,
}
INTENSITY_DEFAULT = "DCI"


def bins_of(array_col: str | Column, n: int) -> list[Column]:
    return [F.get(array_col, F.lit(i)) for i in range(n)]


def _add(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _count(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def hist_sum(bins: Sequence) -> Column:
    return _add([_count(b) for b in bins])


def hist_pmf(bins: Sequence, total: Column | None = None, normalise: str = "smooth") -> list[Column]:
    """Share of each bin; NULL bins count 0. ``normalise="exact"`` omits the epsilon."""
    total = hist_sum(bins) if total is None else total
    if normalise == "exact":
        return [F.when(total > 0, _count(b) / total).otherwise(0.0) for b in bins]
    return [_count(b) / (total + EPS_TOTAL) for b in bins]


def hist_center_mass(p: Sequence[Column]) -> Column:
    return _add([v * float(i) for i, v in enumerate(p)])


def hist_variance(p: Sequence[Column], mu: Column) -> Column:
    return F.greatest(F.lit(0.0), _add([v * float(i * i) for i, v in enumerate(p)]) - mu * mu)


def hist_entropy(p: Sequence[Column]) -> Column:
    if len(p) < 2:
        return F.lit(0.0)
    clip = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(EPS_LOG))
    return -_add([v * F.log(clip(v)) for v in p]) / F.log(F.lit(float(len(p))))


def hist_moment(p: Sequence[Column], mu: Column, order: int) -> Column:
    return _add([v * reduce(lambda a, b: a * b, [(float(i) - mu)] * order) for i, v in enumerate(p)])


def hist_skew(m3: Column, sd: Column) -> Column:
    return F.when(sd > EPS_SD, m3 / (sd * sd * sd)).otherwise(0.0)


def hist_kurt(m4: Column, sd: Column) -> Column:
    return F.when(sd > EPS_SD, m4 / (sd * sd * sd * sd) - 3.0).otherwise(0.0)


def hist_bimodality(skew: Column, kurt: Column) -> Column:
    raw = (skew * skew + 1.0) / (kurt + 3.0 + EPS_TOTAL)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def hist_peaks(p: Sequence[Column]) -> Column:
    """Strict local maxima, the edges compared with -1; constant 1 below three bins."""
    if len(p) < 3:
        return F.lit(1.0)
    pad = [F.lit(-1.0), *p, F.lit(-1.0)]
    hits = [((pad[i] > pad[i - 1]) & (pad[i] > pad[i + 1])).cast("double") for i in range(1, len(p) + 1)]
    return _add(hits)


def intensity_name(family: str, policy: dict[str, str | None] | None = None) -> str | None:
    return (policy or INTENSITY).get(family, INTENSITY_DEFAULT)


def hist_intensity(p: Sequence[Column], kind: str) -> Column:
    n = len(p)
    at = (lambda i: i) if kind == "DCI" else (lambda i: n - 1 - i)
    return _add([v * float(at(i) ** 2) for i, v in enumerate(p)])


def hist_stress_slope(intensity: Column, mileage: Column) -> Column:
    return intensity / (mileage + EPS_MILEAGE)


def wasserstein(bins: Sequence, reference: Sequence[float]) -> Column:
    """W1 on the bin index between the smoothed row and a fixed reference."""
    weights = [_count(b) + EPS_TOTAL for b in bins]
    total = _add(weights)
    ref_total = float(sum(reference))
    cum_q, cum_r, terms = F.lit(0.0), 0.0, []
    for w, r in list(zip(weights, reference))[:-1]:
        cum_q, cum_r = cum_q + w, cum_r + float(r) / ref_total
        terms.append(F.abs(cum_q / total - F.lit(cum_r)))
    return _add(terms) if terms else F.lit(0.0)
