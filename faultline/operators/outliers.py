"""Isolation forest with failure rescue.

Trees are grown on fixed-size seeded samples, one small group per tree; the node table
has a constant size, so it can travel to every executor. Rows are scored where they are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.seeded import seeded_hash
from faultline.operators.order import seeded_take
from faultline.operators.pca import pca_fit, pca_transform
from faultline.operators.prefix import quantiles
from faultline.operators.scaling import apply_affine, fit_robust, standard_scale

_NODES = "tree int, node int, feature int, split double, left int, right int, depth double"


def _expected_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(seed: int, limit: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        tree = int(pdf["tree"].iat[0])
        x = np.array(pdf["vec"].tolist(), dtype=float)
        rng = np.random.default_rng([seed, tree])
        rows, stack, last = [], [(0, np.arange(len(x)), 0)], 0
        while stack:
            node, members, depth = stack.pop()
            part = x[members]
            lo, hi = part.min(axis=0), part.max(axis=0)
            open_cols = np.flatnonzero(hi > lo)
            if depth >= limit or len(members) <= 1 or not len(open_cols):
                rows.append((tree, node, -1, 0.0, -1, -1, depth + _expected_depth(len(members))))
                continue
            f = int(rng.choice(open_cols))
            split = float(rng.uniform(lo[f], hi[f]))
            left = part[:, f] <= split
            rows.append((tree, node, f, split, last + 1, last + 2, 0.0))
            stack += [(last + 1, members[left], depth + 1), (last + 2, members[~left], depth + 1)]
            last += 2
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "split", "left", "right", "depth"])

    return grow


def tree_samples(df: DataFrame, trees: int, psi: int, seed: int, id_col: str) -> DataFrame:
    """``(tree, id, vec)``: psi rows per tree without replacement, seeded.

    Every tree orders one seeded pool of at most ``trees * psi`` rows by its own hash, the
    same way for tables of every size; trees may share rows.
    """
    pool = seeded_take(df, trees * psi, (), seed, id_col)
    ids = pool.select(F.col(id_col).alias("id"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    w = Window.partitionBy("tree").orderBy(seeded_hash(seed, "tree", "id"), "id")
    chosen = ids.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi)
    return chosen.join(pool.select(F.col(id_col).alias("id"), "vec"), "id").select("tree", "id", "vec")


def isolation_scores(
    df: DataFrame, cols: Sequence[str], trees: int = 100, psi: int = 256, seed: int = 42, id_col: str = "row_id"
) -> DataFrame:
    """Anomaly score in (0, 1] for each row after robust scaling."""
    scaled = apply_affine(df.select(id_col, *cols), fit_robust(df, cols))
    vec = scaled.select(id_col, F.array(*[F.col(c).cast("double") for c in cols]).alias("vec"))
    samples = tree_samples(vec, trees, psi, seed, id_col)
    limit = math.ceil(math.log2(max(psi, 2)))
    # At most trees * (2 * psi - 1) nodes, whatever the size of the data.
    nodes = samples.groupBy("tree").applyInPandas(_grow(seed, limit), _NODES).toPandas()
    size = min(psi, vec.count())
    forest = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append(tuple(t[c].to_numpy() for c in ("feature", "split", "left", "right", "depth")))
    scale = _expected_depth(size) or 1.0

    def score(batches):
        for pdf in batches:
            x = np.array(pdf["vec"].tolist(), dtype=float)
            total, rows = np.zeros(len(x)), np.arange(len(x))
            for feature, split, left, right, depth in forest:
                at = np.zeros(len(x), dtype=int)
                for _ in range(limit):
                    f = feature[at]
                    go = x[rows, np.maximum(f, 0)] <= split[at]
                    at = np.where(f < 0, at, np.where(go, left[at], right[at]))
                total += depth[at]
            yield pd.DataFrame({id_col: pdf[id_col], "score": 2.0 ** (-total / len(forest) / scale)})

    scores = vec.mapInPandas(score, f"{id_col} long, score double")
    return scores


def flag_outliers(scores: DataFrame, contamination: float = 0.01) -> DataFrame:
    """``is_outlier`` where the score exceeds its exact (1 - contamination) quantile."""
    cut = quantiles(scores, ["score"], [1.0 - contamination]).first()
    return scores.withColumn("is_outlier", (F.col("score") > F.lit(cut["value"])).cast("int"))


def failure_rescue(flagged: DataFrame, label: str = "label") -> DataFrame:
    """``keep`` = not an outlier, or a failure: class 1 is never dropped."""
    return flagged.withColumn(
        "keep", ((F.col("is_outlier") == 0) | F.coalesce(F.col(label) == 1, F.lit(False))).cast("int")
    )


def isolation_forest(
    df: DataFrame, cols: Sequence[str], contamination: float = 0.01, label: str = "label", seed: int = 42,
    id_col: str = "row_id", trees: int = 100, psi: int = 256,
) -> DataFrame:
    """``(id, label, score, is_outlier, keep)`` for every row."""
    flagged = flag_outliers(isolation_scores(df, cols, trees, psi, seed, id_col).persist(), contamination)
    return failure_rescue(df.select(id_col, label).join(flagged, id_col), label)


def outlier_audit(flagged: DataFrame, label: str = "label", factor: float = 5.0) -> DataFrame:
    """Dropped rows, failures among them, base rate, and a warning flag above ``factor`` x base."""
    gone = F.col("keep") == 0
    out = flagged.agg(
        F.count_if(gone).alias("n_dropped"),
        F.count_if(gone & (F.col(label) == 1)).alias("n_failures"),
        F.avg(F.col(label).cast("double")).alias("base_rate"),
    )
    rate = F.when(F.col("n_dropped") > 0, F.col("n_failures") / F.col("n_dropped"))
    return out.withColumn("drop_rate", rate).withColumn(
        "warn", F.coalesce(F.col("drop_rate") > factor * F.col("base_rate"), F.lit(False)).cast("int")
    )


def rescue_groups(
    df: DataFrame, flagged: DataFrame, cols: Sequence[str], id_col: str = "row_id", label: str = "label"
) -> DataFrame:
    """``(id, grp, pc1, pc2)``: inlier, true_noise or rescued, in two standardised components."""
    scaled = standard_scale(df.select(id_col, *cols), cols)
    model = pca_fit(scaled, cols, 2)
    xy = pca_transform(model, scaled, cols, [id_col])
    grp = (
        F.when(F.col("is_outlier") == 0, "inlier")
        .when(F.col(label) == 1, "rescued")
        .otherwise("true_noise")
    )
    return flagged.select(id_col, grp.alias("grp")).join(xy, id_col)
