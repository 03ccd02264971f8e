"""Descriptive and forensic statistics by class."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.numeric import finite_or_null
from faultline.operators.prefix import long_form, quantiles

_QUARTILES = {0.25: "q25", 0.5: "q50", 0.75: "q75"}


def quartiles_by(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``(by..., feature, q25, q50, q75)``, exact."""
    q = quantiles(df, cols, list(_QUARTILES), by)
    return q.groupBy(*by, "feature").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in _QUARTILES.items()]
    )


def describe_by_class(df: DataFrame, cols: Sequence[str], label: str = "label") -> DataFrame:
    """count, mean, sample std, min, quartiles, max per feature and class."""
    tall = long_form(df, cols, [label])
    base = tall.groupBy("feature", label).agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    # Both sides hold one row per class and column name.
    quart = quartiles_by(df, cols, [label]).withColumnsRenamed({"feature": "_f", label: "_l"})
    return base.join(
        quart, (F.col("feature") == F.col("_f")) & F.col(label).eqNullSafe(F.col("_l"))
    ).drop("_f", "_l")


def melt_by_class(df: DataFrame, cols: Sequence[str], label: str = "label") -> DataFrame:
    """Quartiles and range per family feature and class, the data of a box plot."""
    return describe_by_class(df, cols, label).select("feature", label, "n", "min", "q25", "q50", "q75", "max")


def gaussianity_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population skew and excess kurtosis; gaussian if |kurt| < 1 and |skew| < .5. One aggregation of columns."""
    clean = df.select(*[finite_or_null(c).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("feature"), F.count(f"c{i}").alias("_n"), F.skewness(f"c{i}").alias("skew"), F.kurtosis(f"c{i}").alias("kurt"))
            for i, c in enumerate(cols)]
    return (
        clean.agg(F.array(*rows).alias("r"))
        .select(F.inline("r"))
        .where("_n > 0")
        .select("feature", "skew", "kurt", F.coalesce((F.abs("kurt") < 1) & (F.abs("skew") < 0.5), F.lit(False)).cast("int").alias("gaussian"))
    )


def entropy_delta(df: DataFrame, entropy_cols: Sequence[str], label: str = "label") -> DataFrame:
    """Mean system entropy of both classes and their ratio (failing / healthy)."""
    present = sum((F.col(c).isNotNull().cast("int") for c in entropy_cols), F.lit(0))
    system = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in entropy_cols), F.lit(0.0)) / F.nullif(present, F.lit(0))
    return df.agg(
        F.avg(F.when(F.col(label) == 0, system)).alias("healthy"),
        F.avg(F.when(F.col(label) == 1, system)).alias("failing"),
    ).withColumn("ratio", F.col("failing") / F.nullif(F.col("healthy"), F.lit(0.0)))


def peak_mode_by_class(df: DataFrame, col: str, label: str = "label") -> DataFrame:
    """Most common value per class; ties go to the smallest."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(label, F.col(col).alias("peaks"))
        .agg(F.count("*").alias("n"))
        .groupBy(label)
        .agg(F.min_by("peaks", F.struct(-F.col("n"), "peaks")).alias("peaks"), F.max("n").alias("n"))
    )


def most_varied(df: DataFrame, cols: Sequence[str], k: int = 3) -> list[str]:
    row = df.agg(*[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return [c for c, _ in sorted(((c, row[i] or 0.0) for i, c in enumerate(cols)), key=lambda t: (-t[1], t[0]))[:k]]


def peak_regimes(df: DataFrame, peak_cols: Sequence[str], label: str = "label", k: int = 3) -> DataFrame:
    """Class-normalised percentage per peak count, for the families with the largest sd."""
    counts = (
        long_form(df, most_varied(df, peak_cols, k), [label])
        .groupBy("feature", label, F.col("value").alias("peaks"))
        .agg(F.count("*").alias("n"))
    )
    # Few distinct peak counts per feature and class.
    total = F.sum("n").over(Window.partitionBy("feature", label))
    return counts.withColumn("pct", F.col("n") / total * 100)


def mileage_skew_corr(df: DataFrame, mileage: str, skew: str) -> DataFrame:
    r = F.corr(mileage, skew)
    return df.agg(r.alias("r")).withColumn("aging_shift", (F.abs("r") > 0.3).cast("int"))


def fan_points(df: DataFrame, x: str, y: str, label: str = "label") -> DataFrame:
    """Scatter points with the class, a lazy projection."""
    return df.select("row_id", F.col(x).alias("x"), F.col(y).alias("y"), label)


def zone_means(df: DataFrame, x: str, y: str, label: str = "label") -> DataFrame:
    """Average line per class and overall, with the least-squares line of y on x."""
    stats = [
        F.count("*").alias("n"),
        F.avg(y).alias("mean_y"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    ]
    return (
        df.rollup(label).agg(*stats, F.grouping(label).alias("_all"))
        .select(F.when(F.col("_all") == 1, "all").otherwise(F.col(label).cast("string")).alias("zone"),
                "n", "mean_y", "slope", "intercept")
    )


def histogram_by_class(df: DataFrame, cols: Sequence[str], bins: int = 20, label: str = "label") -> DataFrame:
    """Class-normalised density in fixed-width bins over the observed range, and running share, per feature."""
    row = df.agg(*[e for i, c in enumerate(cols) for e in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"))]).first()
    cells = []
    for i, c in enumerate(cols):
        a, b = row[f"a{i}"], row[f"b{i}"]
        if a is None:
            continue
        width = float(b - a) / bins if b > a else 1.0
        bin_no = F.least(F.floor((finite_or_null(c) - F.lit(float(a))) / F.lit(width)), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("feature"), F.lit(width).alias("_w"), bin_no.alias("bin")))
    counts = df.select(label, F.inline(F.array(*cells))).where("bin is not null").groupBy("feature", label, "bin").agg(
        F.count("*").alias("n"), F.first("_w").alias("_w"))
    # At most ``bins`` rows per feature and class.
    w = Window.partitionBy("feature", label)
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(
        "feature", label, "bin", "n",
        (F.col("n") / F.sum("n").over(w) / F.col("_w")).alias("density"),
        (F.sum("n").over(run) / F.sum("n").over(w)).alias("cdf"),
    )


def _normal_cdf(z: Column) -> Column:
    """Normal distribution function by the rational approximation of the error function (error below 2e-7)."""
    # Its published coefficients.
    p, coefficients = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + p * x)
    series = F.lit(0.0)
    for c in reversed(coefficients):
        series = (series + c) * t
    tail = 0.5 * series * F.exp(-x * x)
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def density_by_class(
    df: DataFrame, cols: Sequence[str], label: str = "label", points: int = 200, cut: float = 3.0, refine: int = 16, reach: float = 6.0,
) -> DataFrame:
    """``(feature, label, point, x, density, cdf)``: Gaussian kernel density of each feature in each class.

    The width is the class's own, n^(-1/5) times the sample standard deviation; ``points`` equal steps
    run from ``cut`` widths below the least to as many above the largest value. Values are
    binned linearly on a grid of at most 1/``refine`` widths, one combined sum, and a bin adds to the
    points within ``reach`` widths. A bin reaches fewer points the finer the grid is, so a feature and class make
    some 2 * ``reach`` * ``refine`` * ``points`` terms, whatever the rows and outliers.
    Missing values and NULL classes are left out; a class without spread has no density.
    """
    clean = df.where(F.col(label).isNotNull()).select(label, *[finite_or_null(c).alias(f"c{i}") for i, c in enumerate(cols)])
    stats = [F.struct(F.lit(c).alias("feature"), F.count(f"c{i}").alias("n"), F.stddev_samp(f"c{i}").alias("sd"), F.min(f"c{i}").alias("least"),
                      F.max(f"c{i}").alias("most")) for i, c in enumerate(cols)]
    width = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    wide = clean.groupBy(label).agg(F.array(*stats).alias("s")).select(label, F.inline("s")).where("sd > 0").select(label, "feature", "n", "least", "most", width.alias("w"))
    first, last = F.col("least") - cut * F.col("w"), F.col("most") + cut * F.col("w")
    step = (last - first) / float(points - 1)
    # One row per class and column name.
    grid = F.broadcast(wide.select(F.col(label).alias("_label"), F.col("feature").alias("_feature"), "n", "w", first.alias("first"), step.alias("step"),
                                   F.least(step, F.col("w") / float(refine)).alias("fine")))
    on = (F.col("feature") == F.col("_feature")) & (F.col(label) == F.col("_label"))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("value")) for i, c in enumerate(cols)])
    tall = clean.select(label, F.inline(cells)).where("value is not null").join(grid, on)
    place = (F.col("value") - F.col("first")) / F.col("fine")
    part = place - F.floor(place)
    binned = tall.groupBy("feature", label, F.floor(place).alias("cell")).agg(F.sum(1.0 - part).alias("here"), F.sum(part).alias("next"))
    weights = binned.select("feature", label, F.inline(F.array(
        F.struct(F.col("cell"), F.col("here").alias("weight")), F.struct((F.col("cell") + 1).alias("cell"), F.col("next").alias("weight")))))
    at = F.col("first") + F.col("cell") * F.col("fine")
    near = weights.groupBy("feature", label, "cell").agg(F.sum("weight").alias("weight")).join(grid, on).withColumn("at", at)
    low = F.greatest(F.ceil((F.col("at") - reach * F.col("w") - F.col("first")) / F.col("step")), F.lit(0))
    high = F.least(F.floor((F.col("at") + reach * F.col("w") - F.col("first")) / F.col("step")), F.lit(points - 1))
    # A bin counts in full for every point beyond its reach: once, from the first of them.
    reached = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    terms = near.select("feature", label, "at", "weight", "n", "w", "first", "step", high.alias("high"), F.explode(F.concat(reached, F.array(high + 1))).alias("point"))
    z = (F.col("first") + F.col("point") * F.col("step") - F.col("at")) / F.col("w")
    beyond = F.col("point") > F.col("high")
    kernel = F.when(beyond, 0.0).otherwise(F.exp(-z * z / 2.0) / (math.sqrt(2.0 * math.pi) * F.col("w")))
    summed = terms.groupBy("feature", label, "point").agg(
        F.sum(F.col("weight") * kernel).alias("density"), F.sum(F.when(~beyond, F.col("weight") * _normal_cdf(z))).alias("inner"),
        F.sum(F.when(beyond, F.col("weight"))).alias("outer"))
    axis = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("_point"))
    whole = axis.join(summed, on & (F.col("point") == F.col("_point")), "left")
    # ``points`` rows per class and column name.
    run = Window.partitionBy("_feature", "_label").orderBy("_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nil = lambda c: F.coalesce(c, F.lit(0.0))
    return whole.select(
        F.col("_feature").alias("feature"), F.col("_label").alias(label), F.col("_point").cast("int").alias("point"),
        (F.col("first") + F.col("_point") * F.col("step")).alias("x"), (nil(F.col("density")) / F.col("n")).alias("density"),
        F.least((nil(F.col("inner")) + nil(F.sum("outer").over(run))) / F.col("n"), F.lit(1.0)).alias("cdf"))
