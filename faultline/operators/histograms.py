"""Histogram families to features: per-row statistics, references and distances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import hist as H
from faultline.operators.profile import split_column_roles

Families = Mapping[str, Sequence[str]]


def engineer_histograms(
    df: DataFrame,
    families: Families,
    mileage: str | None = "aa_000",
    keep: Sequence[str] = ("row_id", "label"),
    normalise: str = "smooth",
    policy: dict[str, str | None] | None = None,
) -> DataFrame:
    """Per family: sum, mean bin, entropy, skew, kurtosis, bimodality, peaks, intensity, slope.

    Four staged projections (totals, shares, centre and spread, the rest), so shared
    terms are evaluated once. No shuffle.
    """
    keep = [k for k in keep if k in df.columns]
    has_mileage = mileage is not None and mileage in df.columns
    carry = list(dict.fromkeys([*keep, *([mileage] if has_mileage else [])]))
    sums = {f: f"{f}_sum" for f in families}
    p = {f: [f"_p_{f}_{i}" for i in range(len(b))] for f, b in families.items()}
    out = df.select(*carry, *[c for b in families.values() for c in b], *[H.hist_sum(b).alias(sums[f]) for f, b in families.items()])
    out = out.select(
        *carry,
        *sums.values(),
        *[
            e.alias(n)
            for f, b in families.items()
            for e, n in zip(H.hist_pmf(b, F.col(sums[f]), normalise), p[f])
        ],
    )
    cols = {f: [F.col(n) for n in names] for f, names in p.items()}
    out = out.select("*", *[H.hist_center_mass(cols[f]).alias(f"{f}_center_mass") for f in families])
    out = out.select("*", *[F.sqrt(H.hist_variance(cols[f], F.col(f"{f}_center_mass"))).alias(f"_sd_{f}") for f in families])
    features = []
    for f in families:
        mu, sd = F.col(f"{f}_center_mass"), F.col(f"_sd_{f}")
        features += [
            H.hist_entropy(cols[f]).alias(f"{f}_entropy"),
            H.hist_skew(H.hist_moment(cols[f], mu, 3), sd).alias(f"{f}_skew"),
            H.hist_kurt(H.hist_moment(cols[f], mu, 4), sd).alias(f"{f}_kurt"),
            H.hist_peaks(cols[f]).alias(f"{f}_peaks"),
        ]
        kind = H.intensity_name(f, policy)
        if kind:
            features.append(H.hist_intensity(cols[f], kind).alias(f"{f}_{kind}"))
    base = [*carry, *sums.values(), *[f"{f}_center_mass" for f in families]]
    out = out.select(*base, *features)
    late = []
    for f in families:
        late.append(H.hist_bimodality(F.col(f"{f}_skew"), F.col(f"{f}_kurt")).alias(f"{f}_bimodality"))
        kind = H.intensity_name(f, policy)
        if kind and has_mileage:
            late.append(H.hist_stress_slope(F.col(f"{f}_{kind}"), F.col(mileage)).alias(f"{f}_stress_slope"))
    engineered = [c for c in out.columns if c not in carry]
    return out.select(*keep, *[c for c in engineered], *late)


def collapse_histograms(df: DataFrame, families: Families) -> DataFrame:
    """Older form: ``<f>_sum``, ``<f>_mean``, ``<f>_var`` replace the bins; empty rows give 0."""
    bins = {c for b in families.values() for c in b}
    out = df.withColumns({f"{f}_sum": H.hist_sum(b) for f, b in families.items()})
    p = {f: H.hist_pmf(b, F.col(f"{f}_sum"), "exact") for f, b in families.items()}
    out = out.withColumns({f"{f}_mean": H.hist_center_mass(p[f]) for f in families})
    out = out.withColumns({f"{f}_var": H.hist_variance(p[f], F.col(f"{f}_mean")) for f in families})
    return out.drop(*bins)


def family_sums(df: DataFrame, families: Families, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    return df.select(*keep, *[H.hist_sum(b).alias(f"{f}_total") for f, b in families.items()])


def healthy_reference(
    df: DataFrame, families: Families, label: str = "label", method: str = "pooled"
) -> DataFrame:
    """``(family, bin, share)`` of class 0: pooled counts, or the mean of row shares.

    A family without events gets the uniform distribution. One aggregation.
    """
    healthy = df.where(F.col(label) == 0)
    if method == "pooled":
        terms = {f: [F.sum(H._count(c)) for c in b] for f, b in families.items()}
    else:
        terms = {f: [F.avg(e) for e in H.hist_pmf(b, None, "exact")] for f, b in families.items()}
    wide = healthy.agg(*[F.array(*[F.coalesce(t, F.lit(0.0)) for t in ts]).alias(f) for f, ts in terms.items()])
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("v")) for f in families])).alias("s"))
    rows = rows.select("s.family", F.posexplode("s.v").alias("bin", "v"))
    # At most one row per bin column.
    w = Window.partitionBy("family")
    total = F.sum("v").over(w)
    return rows.select(
        "family", "bin", F.when(total > 0, F.col("v") / total).otherwise(1.0 / F.count("*").over(w)).alias("share")
    )


def reference_map(reference: DataFrame) -> dict[str, list[float]]:
    """Reference distributions on the driver: one value per bin column."""
    out: dict[str, dict[int, float]] = {}
    for r in reference.collect():
        out.setdefault(r["family"], {})[r["bin"]] = r["share"]
    return {f: [v[i] for i in sorted(v)] for f, v in out.items()}


def wasserstein_to_ref(
    df: DataFrame, families: Families, refs: Mapping[str, Sequence[float]], keep: Sequence[str] = ("row_id",)
) -> DataFrame:
    return df.select(*keep, *[H.wasserstein(b, refs[f]).alias(f"{f}_wasserstein") for f, b in families.items() if f in refs])


def remove_uptime_redundancy(
    df: DataFrame, mileage: str = "aa_000", threshold: float = 0.98, keep: str = "ag_sum"
) -> DataFrame:
    """Keep one ``_sum`` column as ``Total_Operational_Events``, or none if it is mileage again."""
    from faultline.operators.correlation import spearman_with

    sums = [c for c in df.columns if c.endswith("_sum")]
    if len(sums) < 2:
        return df
    kept = keep if keep in sums else sums[0]
    if mileage in df.columns:
        rho = spearman_with(df, [kept], mileage).first()
        if rho is not None and rho["rho"] is not None and rho["rho"] > threshold:
            return df.drop(*sums)
    return df.drop(*[c for c in sums if c != kept]).withColumnRenamed(kept, "Total_Operational_Events")


def replace_bins(
    df: DataFrame,
    refs: Mapping[str, Sequence[float]] | None = None,
    ids: Sequence[str] = ("row_id", "label"),
    mileage: str = "aa_000",
    threshold: float = 0.98,
) -> DataFrame:
    """Numeric columns, flags and engineered features instead of raw bins."""
    ids = [i for i in ids if i in df.columns]
    roles = split_column_roles([c for c in df.columns if c not in ids])
    families = roles["families"]
    extra = {f"{f}_wasserstein": H.wasserstein(b, refs[f]) for f, b in families.items() if refs and f in refs}
    staged = df.withColumns(extra) if extra else df
    wide = engineer_histograms(
        staged, families, mileage, keep=[*ids, *roles["numeric"], *roles["flags"], *extra]
    )
    engineered = [c for c in wide.columns if c not in {*ids, *roles["numeric"], *roles["flags"], *extra}]
    wide = wide.select(*ids, *roles["numeric"], *roles["flags"], *engineered, *extra)
    return remove_uptime_redundancy(wide, mileage, threshold)


def skewed_columns(df: DataFrame, cols: Sequence[str], threshold: float = 2.0) -> dict[str, bool]:
    """Columns with population skew above the threshold; True if clipping is needed."""
    row = df.agg(
        *[F.skewness(c).alias(f"s{i}") for i, c in enumerate(cols)],
        *[F.min(c).alias(f"m{i}") for i, c in enumerate(cols)],
    ).first()
    return {
        c: row[f"m{i}"] < 0
        for i, c in enumerate(cols)
        if row[f"s{i}"] is not None and row[f"s{i}"] > threshold
    }


def log1p_columns(df: DataFrame, clip: Mapping[str, bool]) -> DataFrame:
    return df.withColumns(
        {c: F.log1p(F.greatest(F.col(c), F.lit(0.0)) if neg else F.col(c)) for c, neg in clip.items()}
    ) if clip else df


def log1p_if_skewed(df: DataFrame, cols: Sequence[str], threshold: float = 2.0) -> DataFrame:
    return log1p_columns(df, skewed_columns(df, cols, threshold))


def log1p_sums_vars(df: DataFrame) -> DataFrame:
    """Older form: always for ``_sum`` and ``_var`` columns, negatives clipped to 0."""
    return log1p_columns(df, {c: True for c in df.columns if c.endswith(("_sum", "_var"))})
