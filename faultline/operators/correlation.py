"""Rank correlation between columns, and feature groups built on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.numeric import finite_or_null
from faultline.operators.pairs import pearson_matrix
from faultline.operators.prefix import slice_rows, carried_ranks, fitted_cuts, long_form, small_sorted


def rank_transform(
    df: DataFrame, cols: Sequence[str], id_col: str = "row_id", large: bool | None = None
) -> DataFrame:
    """Each column replaced by its average rank; NULL stays NULL."""
    tall = long_form(df, cols, [id_col]).withColumn("_one", F.lit(1))
    per_slice = slice_rows(large)
    cuts = None if per_slice is None else fitted_cuts(tall, ["feature"], [F.col("value")], per_slice)[0]
    ranked = carried_ranks(tall, ["feature"], "value", "_one", "rank", cuts)
    return ranked.groupBy(id_col).pivot("feature", list(cols)).agg(F.first("rank"))


def spearman_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], large: bool | None = None) -> DataFrame:
    """``(a, b, rho)`` for given column pairs, each on the rows complete for it; all pairs in one plan.

    Works on distinct ``(pair, x, y)`` triples with counts, so ties collapse first; the ranks of x
    and of y within the pair are carried on the triples. Without spread rho is NULL.
    """
    pairs = list(pairs)
    names = sorted({c for p in pairs for c in p})
    at = {c: i for i, c in enumerate(names)}
    # Positions as one constant, however many pairs there are.
    place = lambda side: F.split(F.lit(",".join(str(at[p[side]]) for p in pairs)), ",").cast("array<int>")
    cells = df.select(F.array(*[finite_or_null(c) + F.lit(0.0) for c in names]).alias("_v"))
    tall = cells.select(F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("pair"), "_v")
    value = lambda side: F.get("_v", F.get(place(side), F.col("pair")))
    triples = (
        tall.select("pair", value(0).alias("x"), value(1).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("pair", "x", "y").agg(F.count("*").alias("n"))
    )
    per_slice = slice_rows(large)
    cuts = [None, None] if per_slice is None else fitted_cuts(triples, ["pair"], [F.col("x"), F.col("y")], per_slice)
    ranked = carried_ranks(carried_ranks(triples, ["pair"], "x", "n", "rx", cuts[0]), ["pair"], "y", "n", "ry", cuts[1], "total")
    mid = (F.col("total") + 1) / 2.0
    n, x, y = F.col("n"), F.col("rx") - mid, F.col("ry") - mid
    out = ranked.groupBy("pair").agg(F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    label = F.array(*[F.lit(c) for c in names])
    name = lambda side: F.get(label, F.get(place(side), F.col("pair")))
    ok = (F.col("xx") > 0) & (F.col("yy") > 0)
    return out.select(name(0).alias("a"), name(1).alias("b"), F.when(ok, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))


def spearman_matrix(
    df: DataFrame, cols: Sequence[str], id_col: str = "row_id", large: bool | None = None
) -> DataFrame:
    """``(a, b, rho)`` for all ordered column pairs, each on the rows complete for the pair.

    Columns without NULLs share one rank per value; the pairs with a gappy column are one
    further plan, whatever their number.
    """
    cols = list(cols)
    gaps = df.agg(*[F.max(finite_or_null(c).isNull().cast("int")).alias(f"g{i}") for i, c in enumerate(cols)]).first()
    gappy = [c for i, c in enumerate(cols) if gaps[f"g{i}"]]
    complete = [c for c in cols if c not in gappy]
    parts = []
    if complete:
        # Ranks are spread evenly over 1..n, so their sums need no centring pass.
        parts.append(pearson_matrix(rank_transform(df, complete, id_col, large), complete, center={}).withColumnRenamed("r", "rho"))
    if gappy:
        # Each pair once: a gappy column with the complete ones, itself and the gappy ones after it.
        half = spearman_pairs(df, [(c, g) for k, g in enumerate(gappy) for c in [*complete, *gappy[k:]]], large)
        sides = F.array(F.struct("a", "b", "rho"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "rho"))
        both = F.when(F.col("a") == F.col("b"), F.slice(sides, 1, 1)).otherwise(sides)
        parts.append(half.select(F.inline(both)))
    return reduce(DataFrame.unionByName, parts)


def spearman_with(df: DataFrame, cols: Sequence[str], ref: str, large: bool | None = None) -> DataFrame:
    """``(feature, rho)`` of every column with ``ref`` on pairwise-complete rows."""
    return spearman_pairs(df, [(c, ref) for c in cols], large).select(F.col("a").alias("feature"), "rho")


def spearman_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return spearman_with(df, [x], y)


def corr_with_reference(df: DataFrame, cols: Sequence[str], ref: str, top_n: int = 11) -> DataFrame:
    """Columns by descending |Spearman| with the reference column."""
    return (
        spearman_with(df, cols, ref)
        .select("feature", F.abs("rho").alias("abs_rho"))
        .orderBy(F.desc_nulls_last("abs_rho"), "feature")
        .limit(top_n)
    )


def mean_family_correlation(
    df: DataFrame, features: Sequence[str], families: Mapping[str, Sequence[str]], id_col: str = "row_id"
) -> DataFrame:
    """``(feature, avg_corr)``: mean |Spearman| of each feature with the family sums."""
    totals = {f: f"_fam_{f}" for f in families}
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    wide = df.select(
        id_col, *features, *[sum((zero(c) for c in b), F.lit(0.0)).alias(totals[f]) for f, b in families.items()]
    )
    # All features with all families in one plan, each pair on its complete rows.
    rho = spearman_pairs(wide, [(c, t) for t in totals.values() for c in features])
    return (
        rho.groupBy(F.col("a").alias("feature"))
        .agg(F.coalesce(F.avg(F.abs("rho")), F.lit(0.0)).alias("avg_corr"))
    )


def feature_group_correlation(
    df: DataFrame, features: Sequence[str], families: Mapping[str, Sequence[str]], id_col: str = "row_id"
) -> DataFrame:
    """Global (> .75), Secondary (> .25) or Diagnostic; all Secondary without families."""
    if not families:
        return df.sparkSession.createDataFrame(
            [(f, None, "Secondary") for f in features], "feature string, avg_corr double, feature_group string"
        )
    c = F.col("avg_corr")
    group = F.when(c > 0.75, "Global").when(c > 0.25, "Secondary").otherwise("Diagnostic")
    return mean_family_correlation(df, features, families, id_col).withColumn("feature_group", group)


def feature_group_usage(
    df: DataFrame,
    features: Sequence[str],
    families: Mapping[str, Sequence[str]],
    id_col: str = "row_id",
    cuts: tuple[float, float] = (0.85, 0.50),
) -> DataFrame:
    """The same with cuts .85 / .50 (the lower one inclusive) and usage names."""
    c = F.col("avg_corr")
    group = (
        F.when(c > cuts[0], "Global Usage (Proxy for Age)")
        .when(c >= cuts[1], "Secondary Usage (Duty Cycle)")
        .otherwise("Diagnostic / Specific Signal")
    )
    out = mean_family_correlation(df, features, families, id_col).withColumn("classification", group)
    return small_sorted(out, F.desc("avg_corr"), "feature")
