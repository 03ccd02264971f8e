"""Model-based feature rankings, consensus of rankings, and stability across folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.missing import fill, fit_medians
from faultline.operators.models import assemble
from faultline.operators.ranktests import ks_two_sample, kruskal_wallis, mutual_info_rank
from faultline.operators.scaling import standard_scale


def _labelled(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    return assemble(df.where(F.col(label).isNotNull()), cols).select(
        "features", F.col(label).cast("double").alias("label")
    )


def _rank_frame(spark, scored: Sequence[tuple[str, float]], top_n: int | None) -> DataFrame:
    rows = sorted(scored, key=lambda t: (-t[1], t[0]))
    rows = [(f, float(s), i + 1) for i, (f, s) in enumerate(rows)]
    return spark.createDataFrame(rows[:top_n], "feature string, stat double, rank int")


def rank_rfe_forest(
    df: DataFrame, cols: Sequence[str], n: int, label: str = "label", trees: int = 200, step: float = 0.1, seed: int = 42
) -> DataFrame:
    """Recursive elimination: refit a forest, drop the weakest 10 % of the original columns per step."""
    left = list(cols)
    drop = max(1, int(len(left) * step))
    while True:
        model = RandomForestClassifier(numTrees=trees, seed=seed).fit(_labelled(df, left, label))
        scores = sorted(zip(left, model.featureImportances.toArray()), key=lambda t: (-t[1], t[0]))
        if len(left) <= n:
            return _rank_frame(df.sparkSession, scores, None)
        left = [c for c, _ in scores[: max(n, len(left) - drop)]]


def rank_forest(
    df: DataFrame, cols: Sequence[str], n: int | None = None, label: str = "label", trees: int = 100, seed: int = 42
) -> DataFrame:
    """Forest importances, top n."""
    model = RandomForestClassifier(numTrees=trees, seed=seed).fit(_labelled(df, cols, label))
    return _rank_frame(df.sparkSession, list(zip(cols, model.featureImportances.toArray())), n)


def rank_from_model(df: DataFrame, cols: Sequence[str], label: str = "label", trees: int = 100, seed: int = 42) -> DataFrame:
    """Forest importances at or above their mean."""
    model = RandomForestClassifier(numTrees=trees, seed=seed).fit(_labelled(df, cols, label))
    imp = model.featureImportances.toArray()
    return _rank_frame(df.sparkSession, [(c, v) for c, v in zip(cols, imp) if v >= imp.mean()], None)


def rank_gbt(
    df: DataFrame, cols: Sequence[str], n: int | None = None, label: str = "label", iterations: int = 20, seed: int = 42
) -> DataFrame:
    """Boosted-tree importance (gain, not split counts), top n."""
    model = GBTClassifier(maxIter=iterations, seed=seed).fit(_labelled(df, cols, label))
    return _rank_frame(df.sparkSession, list(zip(cols, model.featureImportances.toArray())), n)


def rank_lasso(df: DataFrame, cols: Sequence[str], n: int | None = None, label: str = "label", alpha: float = 0.01) -> DataFrame:
    """|coefficient| of an L1 linear fit on median-imputed, standardised columns."""
    filled = fill(df, fit_medians(df, cols))
    ready = _labelled(standard_scale(filled, cols), cols, label)
    model = LinearRegression(
        elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=1000, solver="normal" if len(cols) <= 4096 else "auto"
    ).fit(ready)
    return _rank_frame(df.sparkSession, [(c, abs(v)) for c, v in zip(cols, model.coefficients.toArray())], n)


def top_features(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.where(F.col("rank") <= n).select("feature")


def consensus_union(rankings: Sequence[DataFrame], n: int) -> DataFrame:
    """Features in the top n of at least one ranking ``(feature, rank)``."""
    return reduce(DataFrame.unionByName, [top_features(r, n) for r in rankings]).distinct()


def consensus_vote(rankings: Mapping[str, DataFrame], n: int, needed: int = 2, importance: DataFrame | None = None) -> DataFrame:
    """``(feature, votes, selected)``: votes for being in a ranking's top n.

    Selected are features with ``needed`` votes; if none reaches it, the top n by votes
    plus importance (``(feature, stat)``) scaled by its maximum.
    """
    ballots = reduce(DataFrame.unionByName, [top_features(r, n) for r in rankings.values()])
    votes = ballots.groupBy("feature").agg(F.count("*").alias("votes"))
    if importance is not None:
        top = importance.agg(F.max("stat").alias("m")).select("m").scalar()
        scaled = importance.select("feature", (F.col("stat") / (top + 1e-9)).alias("_imp"))
        votes = votes.join(scaled, "feature", "full").na.fill({"votes": 0, "_imp": 0.0})
    else:
        votes = votes.withColumn("_imp", F.lit(0.0))
    # One row per column name from here on.
    best = F.max("votes").over(Window.partitionBy())
    order = Window.partitionBy().orderBy(F.desc(F.col("votes") + F.col("_imp")), "feature")
    chosen = F.when(best >= needed, F.col("votes") >= needed).otherwise(F.row_number().over(order) <= n)
    return votes.select("feature", "votes", chosen.cast("int").alias("selected"))


def select_union_fast(df: DataFrame, cols: Sequence[str], n: int, label: str = "label") -> DataFrame:
    """Union of the top n by KS (p at most 0.05), boosted trees and lasso (alpha 0.005)."""
    ks = _ranked(ks_two_sample(df, cols, label, 0.05))
    return consensus_union([ks, rank_gbt(df, cols, n, label), rank_lasso(df, cols, n, label, alpha=0.005)], n)


def select_union(df: DataFrame, cols: Sequence[str], n: int, label: str = "label", trees: int = 100) -> DataFrame:
    """Union of the top n by KS (p at most 0.05), mutual information and forest importance."""
    ks = _ranked(ks_two_sample(df, cols, label, 0.05))
    mi = _ranked(mutual_info_rank(df, cols, label), "mi")
    return consensus_union([ks, mi, rank_forest(df, cols, n, label, trees)], n)


def select_vote(df: DataFrame, cols: Sequence[str], n: int, label: str = "label", needed: int = 2) -> DataFrame:
    """Vote of Kruskal, mutual information (NULL counted 0) and boosted trees."""
    zero = df.fillna(0.0, subset=list(cols))
    gbt = rank_gbt(zero, cols, None, label)
    return consensus_vote(
        {
            "kruskal": kruskal_wallis(df, cols, label).select("feature", "rank"),
            "mi": _ranked(mutual_info_rank(zero, cols, label), "mi"),
            "gbt": gbt,
        },
        n, needed, gbt,
    )


def _ranked(df: DataFrame, stat: str = "stat") -> DataFrame:
    """Add ``rank`` to a per-feature frame: one row per column name."""
    w = Window.partitionBy().orderBy(F.desc(stat), "feature")
    return df.withColumn("rank", F.row_number().over(w))


def chosen_names(picked: DataFrame, cols: Sequence[str]) -> list[str]:
    """The features of a selection (one row per column name) in the order of ``cols``."""
    names = {r["feature"] for r in picked.select("feature").collect()}
    return [c for c in cols if c in names]


# Selectors inside a fold, by name: (df, cols, n) -> column names; ``large`` is that of running_counts, where one takes it.
SELECTORS = {
    "kruskal": lambda df, cols, n, large=None: chosen_names(top_features(kruskal_wallis(df, cols, large=large).select("feature", "rank"), n), cols),
    "vote": lambda df, cols, n, large=None: chosen_names(select_vote(df, cols, n).where("selected = 1"), cols),
    "union": lambda df, cols, n, large=None: chosen_names(select_union(df, cols, n), cols),
    "union_fast": lambda df, cols, n, large=None: chosen_names(select_union_fast(df, cols, n), cols),
    "rfe": lambda df, cols, n, large=None: chosen_names(rank_rfe_forest(df, cols, n), cols),
    "lasso": lambda df, cols, n, large=None: chosen_names(rank_lasso(df, cols, n), cols),
}


def selection_stability(fold_features: DataFrame, folds: int | None = None, top_n: int = 20) -> DataFrame:
    """``(feature, n_folds, pct)`` from ``(fold, features ARRAY)`` rows, one per fold; ``folds`` is their number."""
    if folds is None:
        folds = fold_features.count()
    return (
        fold_features.select(F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.count("*").alias("n_folds"))
        .withColumn("pct", F.col("n_folds") / F.lit(float(folds)) * 100)
        .orderBy(F.desc("n_folds"), "feature")
        .limit(top_n)
    )
