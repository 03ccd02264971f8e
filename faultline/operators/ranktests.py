"""Two-class distribution tests and rankings, one row per feature.

Everything starts from ``(feature, value, n0, n1)``: hundreds of features share one
shuffle, and a value that fills a third of the table is a single row of it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.numeric import digamma_count, kolmogorov_sf, ks_exact_p
from faultline.operators.prefix import (
    class_counts_by_value, class_running_counts, name_features, running_counts, small_sorted,
)
from faultline.session import cut_lineage


# Fixed value: up to this sample size the p-value is exact, beyond it that of the limit.
EXACT_ROWS = 10_000


def ks_statistics(
    df: DataFrame, cols: Sequence[str], label: str = "label", large: bool | None = None, exact: int = EXACT_ROWS, ties: bool = False,
) -> DataFrame:
    """``(feature, stat, p_value, n0, n1)``; features with an empty side get stat NULL, p 1.

    If no side has more than ``exact`` rows, p is the exact chance over all splits of the pooled
    values, else that of the Kolmogorov limit. ``ties=False`` takes the pool as free of ties,
    which is conservative; ``ties=True`` conditions on its groups of equal values. Exact
    chances are computed on the summary, one row per feature, dealt over the tasks.
    """
    run = class_running_counts(df, cols, label, large)
    both = (F.col("t0") > 0) & (F.col("t1") > 0)
    gap = F.abs(F.col("cum_n1") / F.col("t1") - F.col("cum_n0") / F.col("t0"))
    small = both & (F.greatest("t0", "t1") <= exact)
    # At most 2 * ``exact`` places of a feature are listed: NULL for the others is left out.
    place = F.when(small, F.col("cum_n0") + F.col("cum_n1")) if ties else F.lit(None).cast("long")
    out = run.groupBy("feature").agg(
        F.max(F.when(both, gap)).alias("stat"), F.first("t0").alias("n0"), F.first("t1").alias("n1"),
        F.max(F.when(small, F.abs(F.col("cum_n1") * F.col("t0") - F.col("cum_n0") * F.col("t1")))).alias("_gap"),
        F.collect_list(place).alias("_ends"),
    )
    scale = F.sqrt(F.col("n1").cast("double") * F.col("n0") / (F.col("n1") + F.col("n0")))
    limit = F.when(F.col("stat").isNull(), 1.0).otherwise(kolmogorov_sf(F.col("stat") * scale))

    @F.pandas_udf("double")
    def chance(n0: pd.Series, n1: pd.Series, gap: pd.Series, ends: pd.Series) -> pd.Series:
        rows = zip(n0, n1, gap, ends)
        return pd.Series([None if pd.isna(g) else ks_exact_p(int(a), int(b), int(g), e if ties else None) for a, b, g, e in rows], dtype="float64")

    tasks = max(1, min(len(cols), df.sparkSession.sparkContext.defaultParallelism))
    dealt = out.withColumn("_limit", limit).repartition(tasks, "feature").withColumn("_exact", chance("n0", "n1", "_gap", "_ends"))
    return dealt.select("feature", "stat", F.coalesce("_exact", "_limit").alias("p_value"), "n0", "n1")


def ks_two_sample(
    df: DataFrame,
    cols: Sequence[str],
    label: str = "label",
    alpha: float = 0.05,
    top_n: int | None = None,
    large: bool | None = None,
) -> DataFrame:
    """Features with p <= alpha by descending KS distance."""
    out = ks_statistics(df, cols, label, large).where(
        F.col("stat").isNotNull() & (F.col("p_value") <= alpha)
    ).select("feature", "stat", "p_value")
    order = (F.desc("stat"), "feature")
    return out.orderBy(*order).limit(top_n) if top_n else small_sorted(out, *order)


def ks_pvalues(df: DataFrame, cols: Sequence[str], label: str = "label") -> DataFrame:
    return small_sorted(ks_statistics(df, cols, label).select("feature", "p_value"), "p_value", "feature")


def ks_drift(train: DataFrame, test: DataFrame, cols: Sequence[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """KS of train against test per shared column, p <= alpha, by descending distance."""
    shared = [c for c in (cols or train.columns) if c in test.columns and c in train.columns]
    both = train.select(F.lit(0).alias("_split"), *shared).unionByName(
        test.select(F.lit(1).alias("_split"), *shared)
    )
    return ks_two_sample(both, shared, "_split", alpha)


def rank_sums(df: DataFrame, cols: Sequence[str], label: str = "label", large: bool | None = None) -> DataFrame:
    """``(feature, n0, n1, r0, r1, ties)``: rank sums per class and the tie term."""
    run = class_running_counts(df, cols, label, large)
    t = (F.col("n0") + F.col("n1")).cast("double")
    rank = F.col("cum_n0") + F.col("cum_n1") - (t - 1) / 2.0
    return (
        run.select("feature", "n0", "n1", "t0", "t1", t.alias("t"), rank.alias("rank"))
        .groupBy("feature")
        .agg(
            F.first("t0").alias("t0"),
            F.first("t1").alias("t1"),
            F.sum(F.col("n0") * F.col("rank")).alias("r0"),
            F.sum(F.col("n1") * F.col("rank")).alias("r1"),
            F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"),
        )
        .withColumnsRenamed({"t0": "n0", "t1": "n1"})
    )


def kruskal_statistics(df: DataFrame, cols: Sequence[str], label: str = "label", large: bool | None = None) -> DataFrame:
    """``(feature, stat)``: tie-corrected H of two groups, NULLs omitted; constants NULL."""
    n = (F.col("n0") + F.col("n1")).cast("double")
    h = (
        12.0 / (n * (n + 1)) * (F.col("r0") * F.col("r0") / F.col("n0") + F.col("r1") * F.col("r1") / F.col("n1"))
        - 3.0 * (n + 1)
    )
    corr = 1.0 - F.col("ties") / F.nullif(n * n * n - n, F.lit(0.0))
    ok = (F.col("n0") > 0) & (F.col("n1") > 0) & (corr > 0)
    return rank_sums(df, cols, label, large).select("feature", F.when(ok, h / corr).alias("stat"))


def kruskal_wallis(
    df: DataFrame, cols: Sequence[str], label: str = "label", top_n: int | None = None, large: bool | None = None
) -> DataFrame:
    """``(feature, stat, p_value, rank)`` by ascending p; constants get p = 1.

    p = erfc(sqrt(H/2)), computed for the per-feature summary.
    """
    rows = [
        (r["feature"], r["stat"], 1.0 if r["stat"] is None else math.erfc(math.sqrt(max(r["stat"], 0.0) / 2)))
        for r in kruskal_statistics(df, cols, label, large).collect()
    ]
    rows.sort(key=lambda r: (r[2], -(r[1] or 0.0), r[0]))
    ranked = [(*r, i + 1) for i, r in enumerate(rows)]
    return df.sparkSession.createDataFrame(
        ranked[:top_n], "feature string, stat double, p_value double, rank int"
    )


def mutual_info_binned(
    df: DataFrame, cols: Sequence[str], label: str = "label", bins: int = 10, large: bool | None = None
) -> DataFrame:
    """Plug-in mutual information (nats) of each feature with the class.

    Quantile bins over the rank of distinct values. Equal values share a bin, and the cost is
    one more small aggregation; ``mutual_info`` is the estimate without bins.
    """
    counts = class_counts_by_value(df, cols, label).withColumn("one", F.lit(1))
    run = running_counts(counts, ["feature"], "value", ["one", "n0", "n1"], large)
    run = run.withColumnsRenamed({"tot_one": "d", "tot_n0": "t0", "tot_n1": "t1"})
    q, rem = F.floor(F.col("d") / bins), F.col("d") % bins
    r = F.col("cum_one")
    # Bucket sizes as in ntile: the first ``rem`` buckets hold one value more.
    bucket = F.when(r <= rem * (q + 1), F.floor((r - 1) / (q + 1))).otherwise(
        rem + F.floor((r - 1 - rem * (q + 1)) / F.greatest(q, F.lit(1)))
    )
    cells = (
        run.groupBy("feature", bucket.alias("bucket"))
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.first("t0").alias("t0"), F.first("t1").alias("t1"))
    )
    n = (F.col("t0") + F.col("t1")).cast("double")
    size = F.col("n0") + F.col("n1")

    def term(k: str):
        joint = F.col(f"n{k}") / n
        return F.when(F.col(f"n{k}") > 0, joint * F.log(joint / ((size / n) * (F.col(f"t{k}") / n)))).otherwise(0.0)

    return name_features(cells.groupBy("feature").agg(F.sum(term("0") + term("1")).alias("mi")), cols)


BLOCK = 4096  # distinct values of a feature and class whose neighbours are sought in one window
UNROLLED = 8  # neighbours up to which they are counted without a lambda, which would leave the generated code


def _radii(counts: DataFrame, neighbours: int, block: int, large: bool | None) -> DataFrame:
    """``(feature, cls, value, n, total, low, high)`` for each distinct value of each class.

    ``low`` and ``high`` bound the interval of the distance to the nearest ``neighbours`` other
    rows of the class. Values are numbered by running counts and cut into blocks of numbers; the values
    next to a block are copied into it, so a window never holds more than a block and its rim,
    whatever the feature.
    """
    sides = F.inline(F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"n{c}").alias("n")) for c in (0, 1)]))
    rows = counts.select("feature", "value", sides).where("n > 0").withColumn("one", F.lit(1))
    placed = running_counts(rows, ["feature", "cls"], "value", ["one", "n"], large)
    at, own = F.col("cum_one") - 1, F.floor((F.col("cum_one") - 1) / block)
    blocks = F.array_distinct(F.array(own, F.greatest(F.floor((at - neighbours) / block), F.lit(0)), F.floor((at + neighbours) / block)))
    copied = placed.select("feature", "cls", "value", "n", F.col("tot_n").alias("total"), own.alias("own"), F.explode(blocks).alias("block"))
    w = Window.partitionBy("feature", "cls", "block").orderBy("value")
    # A neighbour that isn't there is infinitely far and counts nothing.
    near = [F.struct(F.coalesce(F.abs(v - F.col("value")), F.lit(float("inf"))).alias("d"), F.coalesce(n, F.lit(0)).alias("n"), v.alias("v"))
            for k in range(1, neighbours + 1) for f in (F.lag, F.lead) for v, n in ((f("value", k).over(w), f("n", k).over(w)),)]
    self_ = F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("n"), F.col("value").alias("v"))
    need = F.least(F.lit(neighbours).cast("long"), F.col("total") - 1)
    found = copied.withColumn("around", F.sort_array(F.array(self_, *near))).where("own = block")
    if neighbours <= UNROLLED:
        reach, upto = F.when(need <= 0, F.struct(F.lit(0.0).alias("d"), F.col("value").alias("v"))), F.lit(0).cast("long")
        for e in (F.get("around", F.lit(i)) for i in range(2 * neighbours + 1)):
            upto = upto + e["n"]
            reach = reach.when(upto >= need, F.struct(e["d"].alias("d"), e["v"].alias("v")))
    else:
        start = F.struct(need.alias("left"), F.lit(0.0).alias("d"), F.col("value").alias("v"))
        reach = F.aggregate("around", start, lambda acc, e: F.when(acc["left"] > 0, F.struct((acc["left"] - e["n"]).alias("left"), e["d"].alias("d"), e["v"].alias("v"))).otherwise(acc))
    found = found.withColumn("reach", reach)
    d, v = F.col("reach.d"), F.col("reach.v")
    # The neighbour at the rim belongs to the interval whatever the rounding of value +- distance.
    return found.select("feature", "cls", "value", "n", "total", F.least(F.col("value") - d, v).alias("low"), F.greatest(F.col("value") + d, v).alias("high"))


def mutual_info(
    df: DataFrame, cols: Sequence[str], label: str = "label", neighbours: int = 3, block: int = BLOCK, large: bool | None = None
) -> DataFrame:
    """``(feature, mi)``: nearest-neighbour mutual information (nats) of each feature with the class.

    For a row, the interval reaches to the ``neighbours``-th nearest other row of its class (all others, if
    there are fewer); k rows of the class and m of all lie in it besides the row. The estimate is
    psi(N) + mean(psi(k) - psi(m)) - mean(psi(rows of the class)), at least 0. Without
    ties k is ``neighbours``; with ties both count all equal values, so no noise has to break
    them. Rows that are alone in their class are left out, as are missing values; a feature with no rows left has 0.

    Rows collapse to distinct values first. Radii come from windows over blocks with copied
    rims, the counts inside from one running count in which the ends of the intervals are
    rows of count 0.
    """
    if neighbours < 1 or block < neighbours:
        raise ValueError("a block has to hold the neighbours of a value")
    counts = class_counts_by_value(df, cols, label)
    radii = cut_lineage(_radii(counts, neighbours, block, large).where("total > 1"))
    alone = counts.groupBy("feature").agg(*[F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)])
    kept = [F.when(F.col(f"t{c}") > 1, F.col(f"n{c}")).otherwise(0).alias(f"n{c}") for c in (0, 1)]
    # One row per feature: rows that are alone in their class do not count for the others either.
    sized = counts.join(alone, "feature").select("feature", "value", *kept)
    nothing = F.lit(None)
    points = sized.select("feature", F.struct("value", F.lit(1).alias("side")).alias("at"), "n0", "n1", nothing.cast("int").alias("cls"),
                          nothing.cast("double").alias("of"), nothing.cast("long").alias("n"), nothing.cast("long").alias("total"))
    ends = [radii.select("feature", F.struct(F.col(c).alias("value"), F.lit(side).alias("side")).alias("at"), F.lit(0).cast("long").alias("n0"),
                         F.lit(0).cast("long").alias("n1"), "cls", F.col("value").alias("of"), "n", "total") for c, side in (("low", 0), ("high", 2))]
    run = running_counts(points.unionByName(ends[0]).unionByName(ends[1]), ["feature"], "at", ["n0", "n1"], large, F.col("at.value"))
    sign = F.when(F.col("at.side") == 2, 1).otherwise(-1)
    inside = run.where(F.col("of").isNotNull()).groupBy("feature", "cls", "of", "n", "total").agg(
        F.sum(sign * F.when(F.col("cls") == 1, F.col("cum_n1")).otherwise(F.col("cum_n0"))).alias("k"), F.sum(sign * (F.col("cum_n0") + F.col("cum_n1"))).alias("m"))
    term = F.col("n") * (digamma_count(F.col("k") - 1) - digamma_count(F.col("m") - 1) - digamma_count(F.col("total")))
    rows = F.sum("n").cast("double")
    found = inside.groupBy("feature").agg((digamma_count(rows) + F.sum(term) / rows).alias("mi"))
    all_ = counts.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("feature"))
    return name_features(all_.join(found, "feature", "left").select("feature", F.greatest(F.coalesce("mi", F.lit(0.0)), F.lit(0.0)).alias("mi")), cols)


def mutual_info_rank(
    df: DataFrame, cols: Sequence[str], label: str = "label", top_n: int | None = None, neighbours: int = 3, large: bool | None = None
) -> DataFrame:
    """``mutual_info``, largest first."""
    out, order = mutual_info(df, cols, label, neighbours, large=large), (F.desc("mi"), "feature")
    return out.orderBy(*order).limit(top_n) if top_n else small_sorted(out, *order)


def spearman_with_label(df: DataFrame, cols: Sequence[str], label: str = "label", large: bool | None = None) -> DataFrame:
    """``(feature, rho)`` of each column with the 0/1 label, from rank sums alone."""
    run = class_running_counts(df, cols, label, large)
    t = (F.col("n0") + F.col("n1")).cast("double")
    rank = F.col("cum_n0") + F.col("cum_n1") - (t - 1) / 2.0
    n = (F.col("t0") + F.col("t1")).cast("double")
    dev = rank - (n + 1) / 2.0
    out = (
        run.select("feature", "t0", "t1", n.alias("n"), t.alias("t"), "n1", dev.alias("dev"))
        .groupBy("feature")
        .agg(
            F.first("t0").alias("t0"),
            F.first("t1").alias("t1"),
            F.first("n").alias("n"),
            F.sum(F.col("t") * F.col("dev") * F.col("dev")).alias("vx"),
            F.sum(F.col("n1") * F.col("dev")).alias("cov"),
        )
    )
    vy = F.col("t0").cast("double") * F.col("t1") / F.col("n")
    return out.select(
        "feature", F.when((F.col("vx") > 0) & (vy > 0), F.col("cov") / F.sqrt(F.col("vx") * vy)).alias("rho")
    )


def killer_bins(df: DataFrame, families: dict[str, Sequence[str]], label: str = "label") -> DataFrame:
    """``(family, bin, rho, is_top)``: Spearman of each bin with the label, NULL counted 0."""
    cols = [c for b in families.values() for c in b]
    zero = df.select(label, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    rho = spearman_with_label(zero, cols, label)
    fam = F.coalesce(*[F.when(F.col("feature").isin(list(b)), F.lit(f)) for f, b in families.items()])
    # One row per bin column.
    top = F.max("rho").over(Window.partitionBy("family"))
    return (
        rho.select(fam.alias("family"), F.col("feature").alias("bin"), "rho")
        .withColumn("is_top", F.coalesce(F.col("rho") == top, F.lit(False)).cast("int"))
    )
