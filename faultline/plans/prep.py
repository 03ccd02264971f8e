"""Fitted preprocessing plan: columns to keep, flags or modules, and imputation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from faultline.operators.mice import MiceModel, mice_fit
from faultline.operators.missing import (
    FLAG, fill, fit_medians, flag_columns, missing_flags, missingness_modules, module_connectivity,
)
from faultline.operators.profile import na_strategy


@dataclass
class Prep:
    """Small fitted state; ``transform`` is a lazy projection (plus replay of MICE rounds)."""

    keep: list[str]
    flagged: list[str]
    medians: dict[str, float]
    fallback: dict[str, float]
    mice: MiceModel | None = None
    modules: dict[int, list[str]] = field(default_factory=dict)

    def output_columns(self) -> list[str]:
        if self.modules:
            return [*self.keep, *[f"Module_{i}_Connectivity" for i in self.modules]]
        return [*self.keep, *[c + FLAG for c in self.flagged]]

    def transform(self, df: DataFrame, ids: Sequence[str] = ("row_id", "label")) -> DataFrame:
        out = df.select(*[i for i in ids if i in df.columns], *self.keep)
        out = module_connectivity(out, self.modules) if self.modules else missing_flags(out, self.flagged)
        out = fill(out, self.medians)
        if self.mice is not None:
            out = self.mice.transform(out)
        return fill(out, self.fallback)


def fit_prep(
    df: DataFrame,
    cols: Sequence[str],
    max_na: float = 0.7,
    low_na: float = 0.15,
    flag_share: float = 0.0,
    modules: bool = False,
    module_cut: float = 0.5,
    mice_rounds: int = 1000,
    large: bool | None = None,
) -> Prep:
    """Fit on training rows: each part is one aggregation over ``df``."""
    strategy = {r["feature"]: r["strategy"] for r in na_strategy(df, cols, max_na, low_na).collect()}
    keep = [c for c in cols if c in strategy]
    low = [c for c in keep if strategy[c] == "median"]
    high = [c for c in keep if strategy[c] == "iterative"]
    flagged = flag_columns(df, low + high, flag_share) if low or high else []
    flagged = [c for c in keep if c in flagged]
    fallback = fit_medians(df, keep, large)
    model = mice_fit(df.select(*high), high, max_rounds=mice_rounds)[0] if high else None
    return Prep(
        keep=keep,
        flagged=flagged,
        medians={c: fallback[c] for c in low},
        fallback=fallback,
        mice=model,
        modules=missingness_modules(df, flagged, module_cut) if modules and flagged else {},
    )
