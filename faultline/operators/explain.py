"""Attributions, permutation importance, partial dependence and surrogate trees.

A fitted tree ensemble is a few thousand numbers: it goes to the executors, rows stay
there. Spark partitions, joins and aggregates; numpy evaluates trees on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.seeded import seeded_bijection
from faultline.operators.cost import COST_FN, COST_FP
from faultline.operators.models import assemble, predict
from faultline.operators.order import dense_positions, seeded_take
from faultline.operators.prefix import quantile_map, small_sorted


@dataclass
class Tree:
    weight: float
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), dtype=int), np.arange(len(x))
        while True:
            f = self.feature[at]
            if (f < 0).all():
                return at
            go = x[rows, np.maximum(f, 0)] <= self.split[at]
            at = np.where(f < 0, at, np.where(go, self.left[at], self.right[at]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.weight * self.value[self.leaf_of(x)]


def _read_tree(model, weight: float) -> Tree:
    nodes, stack = [], [(model._java_obj.rootNode(), None, None)]
    while stack:
        node, parent, side = stack.pop()
        i = len(nodes)
        leaf = node.numDescendants() == 0 if hasattr(node, "numDescendants") else False
        cover = float(node.impurityStats().count())
        if leaf:
            nodes.append([-1, 0.0, -1, -1, float(node.prediction()), cover])
        else:
            s = node.split()
            nodes.append([s.featureIndex(), float(s.threshold()), -1, -1, 0.0, cover])
            stack += [(node.rightChild(), i, 3), (node.leftChild(), i, 2)]
        if parent is not None:
            nodes[parent][side] = i
    a = np.array(nodes, dtype=float)
    return Tree(weight, a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], a[:, 5])


def read_trees(model) -> list[Tree]:
    """Node tables of a fitted boosted-tree model; margin = sum of tree scores."""
    return [_read_tree(t, float(w)) for t, w in zip(model.trees, model.treeWeights)]


def to_prob(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-2.0 * margin))


@dataclass
class LeafPath:
    """A leaf: the distinct features above it, their intervals and cover shares, and its value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def leaf_paths(tree: Tree) -> list[LeafPath]:
    """The leaves of a tree; each costs as many numbers as its path has features."""
    out, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        f = tree.feature[node]
        if f < 0:
            ends = np.array(list(path.values()), dtype=float).reshape(len(path), 3)
            out.append(LeafPath(np.array(list(path), dtype=int), ends[:, 0], ends[:, 1], ends[:, 2], tree.weight * tree.value[node]))
            continue
        for child, right in ((tree.left[node], False), (tree.right[node], True)):
            lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
            share *= tree.cover[child] / tree.cover[node]
            cut = tree.split[node]
            stack.append((child, {**path, f: (max(lo, cut), hi, share) if right else (lo, min(hi, cut), share)}))
    return out


def path_contributions(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1, for rows of flags: which features of its path a row satisfies.

    A coalition keeps the leaf with the flags of its members and the shares of the others, so the
    sums over coalitions of each size are the coefficients of the product of (share + flag t) over
    the features. A factor is extended into the product for every feature and unwound again for the
    feature in question: d squared steps in place of 2^d coalitions.
    """
    rows, d = inside.shape
    flag = inside.astype(float)
    product = np.zeros((rows, d + 1))
    product[:, 0] = 1.0
    for b in range(d):
        grown = product * share[b]
        grown[:, 1:] += product[:, :-1] * flag[:, b : b + 1]
        product = grown
    weight = np.array([1.0 / (d * comb(d - 1, k)) for k in range(d)])
    out = np.zeros((rows, d))
    for b in range(d):
        total = np.zeros(rows)
        above = np.zeros(rows)  # for flag 1: the quotient by (share + t), from the highest power down
        for k in range(d - 1, -1, -1):
            above = product[:, k + 1] - share[b] * above
            total += weight[k] * above
        if share[b] > 0:
            absent = (product[:, :-1] / share[b]) @ weight
        else:  # without cover the factor is 0 and so are the row's terms
            absent = np.zeros(rows)
        out[:, b] = np.where(inside[:, b], (1.0 - share[b]) * total, -share[b] * absent)
    return out


def attributions(paths: Sequence[LeafPath], x: np.ndarray) -> np.ndarray:
    """Shapley values of the sum of leaves for each row; rows with the same flags share the work."""
    phi = np.zeros_like(x, dtype=float)
    for leaf in paths:
        d = len(leaf.features)
        if not d:
            continue
        part = x[:, leaf.features]
        inside = (part > leaf.low) & (part <= leaf.high)
        key, first, back = np.unique(inside @ (1 << np.arange(d, dtype=np.int64)), return_index=True, return_inverse=True)
        phi[:, leaf.features] += leaf.value * path_contributions(inside[first], leaf.share)[back]
    return phi


def shap_values(model, df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """``(keep..., margin, base, phi ARRAY)``: path-dependent tree attributions of class 1.

    ``sum(phi) + base = margin`` for every row; prob = 1 / (1 + exp(-2 margin)).
    """
    trees = read_trees(model)
    paths = [leaf for t in trees for leaf in leaf_paths(t)]
    base = float(sum(leaf.value * np.prod(leaf.share) for leaf in paths))
    keep = list(keep)

    def explain(batches):
        for pdf in batches:
            x = np.array(pdf["_x"].tolist(), dtype=float)
            out = pdf[keep].copy()
            out["margin"] = sum(t.score(x) for t in trees)
            out["base"] = base
            out["phi"] = list(attributions(paths, x))
            yield out

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + ", margin double, base double, phi array<double>"
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")).mapInPandas(explain, schema)


def shap_global(shap: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, mean_abs_shap)`` in one aggregation, largest first."""
    wide = shap.agg(*[F.avg(F.abs(F.get("phi", F.lit(i)))).alias(f"p{i}") for i in range(len(cols))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"p{i}").alias("mean_abs_shap")) for i, c in enumerate(cols)])
    return small_sorted(wide.select(F.inline(rows)), F.desc("mean_abs_shap"), "feature")


def shap_local(shap: DataFrame, data: DataFrame, cols: Sequence[str], threshold: float, top_k: int = 5, top_features: int = 8,
               id_col: str = "row_id") -> DataFrame:
    """``(id, proba, feature, value, shap)`` of the riskiest rows at or above the threshold."""
    proba = 1.0 / (1.0 + F.exp(-2.0 * F.col("margin")))
    risky = (
        shap.select(id_col, proba.alias("proba"), "phi")
        .where(F.col("proba") >= threshold)
        .orderBy(F.desc("proba"), id_col)
        .limit(top_k)
    )
    names = F.array(*[F.lit(c) for c in cols])
    values = data.select(id_col, F.array(*[F.col(c).cast("double") for c in cols]).alias("_v"))
    # ``risky`` holds top_k rows by construction.
    rows = values.join(F.broadcast(risky), id_col).select(
        id_col, "proba", F.explode(F.arrays_zip(names.alias("feature"), F.col("_v").alias("value"), F.col("phi").alias("shap"))).alias("e")
    ).select(id_col, "proba", "e.feature", "e.value", "e.shap")
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("shap")), "feature")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_features).drop("_r")


def permutation_importance_cost(
    model, df: DataFrame, cols: Sequence[str], threshold: float, repeats: int = 10, seed: int = 42,
    label: str = "label", id_col: str = "row_id", cost_fp: float = COST_FP, cost_fn: float = COST_FN,
) -> DataFrame:
    """``(feature, pi_mean, pi_std)``: rise of the cost when one column is permuted.

    A repeat is one seeded permutation of rows, shared by its features: the row at position p takes
    each column in turn from the row whose position the repeat's bijection turns into p. Positions
    follow the stored rows. The table goes through one exchange, once as takers and once per repeat as
    givers, keyed by position, so no key repeats more often than that; a task walks its positions in order. Only trees
    that use the column are evaluated again.
    """
    trees = read_trees(model)
    users = [[t for t in trees if (t.feature == i).any()] for i in range(len(cols))]
    vec, n = dense_positions(df.select(F.col(label).alias("_y"), F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")), "_at")
    reps = F.array(*[F.lit(i) for i in range(-1, repeats)])
    to = F.when(F.col("rep") < 0, F.col("_at")).otherwise(seeded_bijection(F.col("_at"), n, seed, F.col("rep")))
    rows = vec.withColumn("rep", F.explode(reps)).select(to.alias("_at"), "rep", F.when(F.col("rep") < 0, F.col("_y")).alias("_y"), "_x")
    dealt = rows.repartition("_at").sortWithinPartitions("_at", "rep")
    names = list(cols)

    def count(batches):
        fp, fn = np.zeros((len(names) + 1, repeats)), np.zeros((len(names) + 1, repeats))
        held_x = held_y = None
        for pdf in batches:
            given, rep = np.array(pdf["_x"].tolist(), dtype=float), pdf["rep"].to_numpy()
            y = pdf["_y"].to_numpy(dtype=float, na_value=0) == 1
            if held_x is not None:  # givers may follow their taker in the next batch
                given, rep, y = np.vstack([held_x, given]), np.append(-1, rep), np.append(held_y, y)
            taker = np.maximum.accumulate(np.where(rep < 0, np.arange(len(rep)), 0))
            held_x, held_y = given[taker[-1]], y[taker[-1]]
            pick = np.flatnonzero(rep >= 0)
            if not len(pick):
                continue
            x, d, truth, rep = given[taker[pick]], given[pick], y[taker[pick]], rep[pick]
            margin = sum(t.score(x) for t in trees)
            for i in range(len(names) + 1):
                m = margin
                if i and users[i - 1]:
                    mixed = x.copy()
                    mixed[:, i - 1] = d[:, i - 1]
                    m = margin + sum(t.score(mixed) - t.score(x) for t in users[i - 1])
                hit = to_prob(m) >= threshold
                fp[i] += np.bincount(rep, hit & ~truth, repeats)
                fn[i] += np.bincount(rep, ~hit & truth, repeats)
        if held_x is not None:
            yield pd.DataFrame({
                "rep": np.tile(np.arange(repeats, dtype="int32"), len(names) + 1), "feature": np.repeat([None, *names], repeats),
                "fp": fp.ravel().astype("int64"), "fn": fn.ravel().astype("int64")})

    counts = dealt.mapInPandas(count, "rep int, feature string, fp long, fn long").groupBy("rep", "feature").agg(
        (cost_fp * F.sum("fp") + cost_fn * F.sum("fn")).alias("cost"))
    # Small from here on: one row per feature and repeat.
    base = counts.where("feature is null").select("rep", F.col("cost").alias("base_cost"))
    rise = counts.where("feature is not null").join(base, "rep")
    delta = F.col("cost") - F.col("base_cost")
    out = rise.groupBy("feature").agg(F.avg(delta).alias("pi_mean"), F.stddev_pop(delta).alias("pi_std"))
    return small_sorted(out, F.desc("pi_mean"), "feature")


def compare_ranks(shap: DataFrame, pi: DataFrame) -> DataFrame:
    """Inner join of both importances with dense ranks and their average.

    Both inputs hold one row per column name.
    """
    rank = lambda c: F.dense_rank().over(Window.partitionBy().orderBy(F.desc(c)))
    a = shap.select("feature", "mean_abs_shap", rank("mean_abs_shap").alias("shap_rank"))
    b = pi.select("feature", "pi_mean", rank("pi_mean").alias("pi_rank"))
    out = a.join(b, "feature").withColumn("avg_rank", (F.col("shap_rank") + F.col("pi_rank")) / 2.0)
    return small_sorted(out, "avg_rank", "feature")


def rank_agreement(compared: DataFrame) -> DataFrame:
    """Spearman correlation of the two rank columns."""
    from faultline.operators.correlation import spearman_with

    return spearman_with(compared, ["shap_rank"], "pi_rank", large=False).select("rho")


def pdp_ice(
    model, df: DataFrame, cols: Sequence[str], features: Sequence[str] | None = None, points: int = 20,
    max_rows: int | None = None, seed: int = 42, id_col: str = "row_id",
) -> DataFrame:
    """``(feature, grid, value, id, ice)``: probability of each row with a feature set to a grid value.

    The grid spans the exact 5th-95th percentiles. Every row has a curve
    unless ``max_rows`` bounds them.
    """
    trees = read_trees(model)
    features = list(features or cols)
    limits = quantile_map(df, features, [0.05, 0.95])
    grids = {f: np.linspace(lo, hi, points) for f, (lo, hi) in limits.items()}
    pos = {c: i for i, c in enumerate(cols)}
    rows = df if max_rows is None else seeded_take(df, max_rows, (), seed, id_col)

    def curves(batches):
        for pdf in batches:
            x = np.array(pdf["_x"].tolist(), dtype=float)
            for f, grid in grids.items():
                for g, v in enumerate(grid):
                    mixed = x.copy()
                    mixed[:, pos[f]] = v
                    yield pd.DataFrame({
                        "feature": f, "grid": np.int32(g), "value": float(v), id_col: pdf[id_col],
                        "ice": to_prob(sum(t.score(mixed) for t in trees)),
                    })

    return rows.select(id_col, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")).mapInPandas(
        curves, f"feature string, grid int, value double, {id_col} long, ice double"
    )


def pdp(ice: DataFrame) -> DataFrame:
    return ice.groupBy("feature", "grid", "value").agg(F.avg("ice").alias("pdp"))


def surrogate_tree(model, df: DataFrame, cols: Sequence[str], threshold: float = 0.5, depth: int = 5, seed: int = 42):
    """Shallow tree on the model's predicted class; returns the tree and its fidelity."""
    target = predict(model, df, cols, ["row_id", "label", *cols]).withColumn(
        "label", (F.col("prob") >= threshold).cast("double")
    )
    ready = assemble(target, cols).select("features", "label")
    tree = DecisionTreeClassifier(maxDepth=depth, seed=seed).fit(ready)
    fidelity = tree.transform(ready).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return tree, float(fidelity)


def surrogate_rules(tree, cols: Sequence[str], df: DataFrame) -> DataFrame:
    """``(leaf, rule, prediction, n, n_failures)``: leaf conditions, counted over ``df``."""
    t = _read_tree(tree, 1.0)
    rules, stack = [], [(0, [])]
    while stack:
        node, conds = stack.pop()
        if t.feature[node] < 0:
            rules.append((len(rules), conds, float(t.value[node])))
            continue
        c, s = cols[t.feature[node]], float(t.split[node])
        stack += [(t.right[node], [*conds, (c, ">", s)]), (t.left[node], [*conds, (c, "<=", s)])]
    leaf = F.lit(None).cast("int")
    for i, conds, _ in rules:
        hit = F.lit(True)
        for c, op, s in conds:
            hit = hit & (F.col(c) <= s if op == "<=" else F.col(c) > s)
        leaf = F.when(hit, i).otherwise(leaf)
    counts = df.groupBy(leaf.alias("leaf")).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_failures")
    )
    text = df.sparkSession.createDataFrame(
        [(i, " AND ".join(f"{c} {op} {s:.6g}" for c, op, s in conds) or "TRUE", p) for i, conds, p in rules],
        "leaf int, rule string, prediction double",
    )
    # One row per leaf on both sides.
    return text.join(counts, "leaf", "left").na.fill({"n": 0, "n_failures": 0})


def reference_model(df: DataFrame, cols: Sequence[str], seed: int = 42, registry=None, name: str = "gbt"):
    """Stratified 80/20 split and a fitted model: ``(model, train, valid)``."""
    from faultline.operators.models import fit_model
    from faultline.operators.sampling import split_frames

    train, valid = split_frames(df, 0.8, seed=seed)
    return fit_model(name, train, cols, registry), train, valid
