"""Business-cost curves, thresholds and exact ranking metrics.

A score table collapses to ``(prob, n0, n1)``. Grid points are rows of the same table
with zero counts, so the whole curve is one running count; the grid never meets the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.prefix import few_rows, running_counts
from faultline.operators.ranktests import rank_sums

# The business costs of a false positive and a false negative.
COST_FP, COST_FN = 10.0, 500.0


def tuning_grid(spark, max_threshold: float = 0.4, points: int = 4002) -> DataFrame:
    """Equally spaced thresholds on [0, max_threshold]."""
    step = max_threshold / (points - 1)
    return spark.range(0, points, 1, 1).select((F.col("id") * F.lit(step)).alias("threshold"))


def dense_grid(spark) -> DataFrame:
    """101 + 70 + 19 thresholds: steps of .001 to .10, then of .01 to .99."""
    i = F.col("id")
    value = F.when(i <= 100, i / 1000.0).otherwise((i - 90) / 100.0)
    return spark.range(0, 190, 1, 1).select(value.alias("threshold"))


def normalised_scores(df: DataFrame, raw: str, kind: str = "decision") -> DataFrame:
    """``prob`` in [0, 1]: probabilities as they are, decision values min-max scaled.

    A flat decision value gives 0.5; ``kind="predict"`` passes class predictions.
    """
    if kind != "decision":
        return df.withColumn("prob", F.col(raw).cast("double"))
    lo, hi = df.agg(F.min(raw), F.max(raw)).first()
    if lo is None or hi == lo:
        return df.withColumn("prob", F.lit(0.5))
    return df.withColumn("prob", (F.col(raw) - F.lit(float(lo))) / F.lit(float(hi) - float(lo)))


def score_rows(scores: DataFrame, label: str, prob: str) -> DataFrame:
    """``(prob, n0, n1)`` of each labelled row."""
    known = scores.where(F.col(label).isin(0, 1) & F.col(prob).isNotNull())
    return known.select(F.col(prob).alias("prob"), *[(F.col(label) == i).cast("long").alias(f"n{i}") for i in (0, 1)])


def _curve(counts: DataFrame, grid: DataFrame | None, large: bool | None) -> DataFrame:
    """``(threshold, fp, tp, t0, t1)`` for grid points, or for every score if grid is None.

    Scores may repeat in ``counts``: they collapse where they meet the grid.
    """
    rows = counts.select(F.col("prob").alias("threshold"), "n0", "n1", F.lit(0 if grid is not None else 1).alias("point"))
    if grid is not None:
        zero = F.lit(0).cast("long")
        rows = rows.unionByName(grid.select("threshold", zero.alias("n0"), zero.alias("n1"), F.lit(1).alias("point")))
    rows = rows.groupBy("threshold").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("point").alias("point"))
    run = running_counts(rows, [], "threshold", ["n0", "n1"], large)
    t0, t1 = F.col("tot_n0"), F.col("tot_n1")
    # Predicted positive means prob >= threshold: everything not strictly below it.
    return run.where("point = 1").select(
        "threshold",
        (t0 - F.col("cum_n0") + F.col("n0")).alias("fp"),
        (t1 - F.col("cum_n1") + F.col("n1")).alias("tp"),
        t0.alias("t0"),
        t1.alias("t1"),
    )


def cost_curve(
    scores: DataFrame,
    grid: DataFrame | None = None,
    label: str = "label",
    prob: str = "prob",
    cost_fp: float = COST_FP,
    cost_fn: float = COST_FN,
    large: bool | None = None,
) -> DataFrame:
    """``(threshold, fp, fn, cost)`` at each grid threshold, or at each observed score."""
    c = _curve(score_rows(scores, label, prob), grid, large).withColumn("fn", F.col("t1") - F.col("tp"))
    return c.select("threshold", "fp", "fn", (cost_fp * F.col("fp") + cost_fn * F.col("fn")).alias("cost"))


def _cheapest(curve: DataFrame, lowest: bool) -> DataFrame:
    order = F.struct(F.col("cost"), F.col("threshold") if lowest else -F.col("threshold"))
    return curve.agg(F.min_by(F.struct("threshold", "fp", "fn", "cost"), order).alias("r")).select("r.*")


def best_threshold_grid(scores: DataFrame, max_threshold: float = 0.4, points: int = 4002, rows: int | None = None, **kw) -> DataFrame:
    """Cheapest of the equally spaced thresholds; ties go to the lowest. ``rows`` is the number of scores, if known."""
    if rows is not None:
        kw = {"large": few_rows(rows + points), **kw}
    return _cheapest(cost_curve(scores, tuning_grid(scores.sparkSession, max_threshold, points), **kw), True)


def best_threshold_dense(scores: DataFrame, **kw) -> DataFrame:
    """Cheapest of the 190 thresholds, dense near zero; ties go to the lowest."""
    return _cheapest(cost_curve(scores, dense_grid(scores.sparkSession), **kw), True)


def best_threshold_roc(scores: DataFrame, with_infinity: bool = True, label: str = "label", prob: str = "prob",
                       cost_fp: float = COST_FP, cost_fn: float = COST_FN, large: bool | None = None) -> DataFrame:
    """Cheapest of the observed scores (and +infinity); ties go to the highest."""
    curve = cost_curve(scores, None, label, prob, cost_fp, cost_fn, large)
    if with_infinity:
        none_flagged = score_rows(scores, label, prob).agg(F.sum("n1").alias("fn")).select(
            F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("fp"), "fn",
            (cost_fn * F.col("fn")).alias("cost"),
        )
        curve = curve.unionByName(none_flagged)
    return _cheapest(curve, False)


def roc_curve(scores: DataFrame, label: str = "label", prob: str = "prob", large: bool | None = None) -> DataFrame:
    """``(threshold, fpr, tpr)`` at every observed score."""
    return _curve(score_rows(scores, label, prob), None, large).select(
        "threshold",
        (F.col("fp") / F.nullif(F.col("t0"), F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("t1"), F.lit(0))).alias("tpr"),
    )


def confusion_at(scores: DataFrame, threshold: float | Column, label: str = "label", prob: str = "prob",
                 normalise: bool = False) -> DataFrame:
    """``(tn, fp, fn, tp)``, or shares of each true class."""
    thr = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    hit = F.col(prob) >= thr
    known = scores.where(F.col(label).isin(0, 1) & F.col(prob).isNotNull())
    out = known.agg(
        F.count_if((F.col(label) == 0) & ~hit).alias("tn"),
        F.count_if((F.col(label) == 0) & hit).alias("fp"),
        F.count_if((F.col(label) == 1) & ~hit).alias("fn"),
        F.count_if((F.col(label) == 1) & hit).alias("tp"),
    )
    if not normalise:
        return out
    n0, n1 = F.nullif(F.col("tn") + F.col("fp"), F.lit(0)), F.nullif(F.col("fn") + F.col("tp"), F.lit(0))
    return out.select((F.col("tn") / n0).alias("tn"), (F.col("fp") / n0).alias("fp"),
                      (F.col("fn") / n1).alias("fn"), (F.col("tp") / n1).alias("tp"))


def auc(scores: DataFrame, label: str = "label", prob: str = "prob", large: bool | None = None) -> DataFrame:
    """Mann-Whitney AUC on average ranks: exact with ties."""
    r = rank_sums(scores.select(label, prob), [prob], label, large)
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    return r.select(F.when(n0 * n1 > 0, (F.col("r1") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def metrics_at(scores: DataFrame, threshold: float, label: str = "label", prob: str = "prob",
               cost_fp: float = COST_FP, cost_fn: float = COST_FN, large: bool | None = None) -> DataFrame:
    """AUC, macro-F1, recall, precision, FP, FN and cost at a threshold; 0 when undefined."""
    c = confusion_at(scores, threshold, label, prob)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    f1_pos, f1_neg = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    return c.select(
        auc(scores, label, prob, large).scalar().alias("auc"),
        ((f1_pos + f1_neg) / 2).alias("macro_f1"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp, tp + fp).alias("precision"),
        "fp",
        "fn",
        (cost_fp * fp + cost_fn * fn).alias("cost"),
        F.lit(float(threshold)).alias("threshold"),
    )
