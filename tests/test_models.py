import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.functions import special
from faultline.operators import balancing, explain, knn, marginals, models, outliers, selection
from faultline.plans import experiment, rca

COLS = [f"f{i}" for i in range(5)]
QUICK = models.model_registry(42, 4, 3)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, 5))
    pdf = pd.DataFrame(x, columns=COLS)
    pdf.insert(0, "row_id", np.arange(300))
    pdf.insert(1, "label", (x[:, 0] > 0.7).astype(int))
    return spark.createDataFrame(pdf).persist()


@pytest.fixture(scope="module")
def fitted(planted):
    return explain.reference_model(planted, COLS, registry=QUICK)


def points(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "row_id long, vec array<double>")


def brute(x, ids, k):
    out = set()
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d.round(12))) if j != i][:k]
        out |= {(int(ids[i]), n + 1, int(ids[j])) for n, j in enumerate(order)}
    return out


@pytest.mark.parametrize("chunk,pivots", [(16, 8), (4096, 1)])
def test_knn_equals_brute_force_with_a_hot_group(spark, chunk, pivots):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, (120, 3)).astype(float)
    x = np.concatenate([x, np.repeat(x[:1], 60, axis=0)])
    ids = rng.permutation(len(x))
    got = {(r["id"], r["nn"], r["nbr"]) for r in knn.knn_self(points(spark, x, ids), 4, chunk=chunk, pivots=pivots).collect()}
    assert got == brute(x, ids, 4)


@pytest.mark.parametrize("large", [False, True])
def test_knn_on_rings_and_lattices(spark, large):
    """Many points at one distance of a pivot, single points, and a dense part beside a wide one."""
    rng = np.random.default_rng(3)
    angle = rng.uniform(0, 2 * np.pi, 300)
    parts = [np.column_stack([np.cos(angle), np.sin(angle)]), np.stack(np.meshgrid(range(12), range(12)), -1).reshape(-1, 2) + 5.0,
             rng.normal(0, 0.01, (150, 2)), rng.normal(0, 100, (40, 2)), [[1e6, 1e6]]]
    x = np.unique(np.concatenate(parts), axis=0)
    got = {(r["id"], r["nn"], r["nbr"]) for r in knn.knn_self(points(spark, x), 3, chunk=8 if large else 512, pivots=None if large else 3).collect()}
    assert got == brute(x, np.arange(len(x)), 3)


def test_knn_comparisons_grow_slowly(spark):
    counts = []
    for n in (2_000, 16_000):
        counted = []
        assert knn.knn_self(points(spark, np.random.default_rng(n).random((n, 3))), 5, counted=counted).count() == 5 * n
        counts.append(sum(counted))
    assert np.log(counts[1] / counts[0]) / np.log(8) < 1.6 and counts[1] < 16_000**2 / 8


def test_knn_with_fewer_rows_than_neighbours(spark):
    rows = knn.knn_self(points(spark, [[0.0], [1.0]]), 5).collect()
    assert {(r["id"], r["nbr"]) for r in rows} == {(0, 1), (1, 0)}


def test_smote_counts_and_hull(spark, planted):
    before = planted.toPandas()
    out = balancing.smote(planted, COLS, 0.8).toPandas()
    n1, n0 = int(before.label.sum()), int((before.label == 0).sum())
    made = out[out.row_id < 0]
    assert len(made) == int(n0 * 0.8 - n1) and made.row_id.is_unique and (made.label == 1).all()
    low, high = before[before.label == 1][COLS].min(), before[before.label == 1][COLS].max()
    assert (made[COLS] >= low - 1e-9).all().all() and (made[COLS] <= high + 1e-9).all().all()


def test_edited_neighbours_and_tomek_against_brute_force(spark, planted):
    pdf = planted.toPandas()
    x, y, ids = pdf[COLS].to_numpy(), pdf.label.to_numpy(), pdf.row_id.to_numpy()
    near = brute(x, ids, 3)
    agree = {i for i in ids if all(y[n] == y[i] for a, _, n in near if a == i)}
    kept = {r["row_id"] for r in balancing.edited_neighbours(planted, COLS).collect()}
    assert kept == agree
    first = {a: n for a, k, n in near if k == 1}
    links = {(a, n) for a, n in first.items() if a < n and first[n] == a and y[a] != y[n]}
    assert {(r["id"], r["nbr"]) for r in balancing.tomek_links(planted, COLS).collect()} == links


def test_distribution_functions():
    x = np.linspace(0.001, 0.999, 97)
    for a, b in ((0.5, 0.5), (2.0, 5.0), (30.0, 4.0), (0.7, 8.0)):  # against sums over a fine substitution
        t = (np.arange(400_000) + 0.5) / 400_000
        s = t**2 * (3 - 2 * t)  # smooth at both ends, so integrable singularities are harmless
        mass = np.exp((a - 1) * np.log(s) + (b - 1) * np.log1p(-s)) * 6 * t * (1 - t)
        want = np.interp(x, s, np.cumsum(mass) / mass.sum())
        assert np.abs(special.beta_cdf(x, a, b) - want).max() < 2e-4
        assert np.allclose(special.beta_cdf(special.quantiles_of(lambda v: special.beta_cdf(v, a, b), x, 0.0, 1.0), a, b), x, atol=1e-9)
    assert np.allclose(special.beta_cdf(x, 0.05, 1.0), x**0.05, atol=1e-12) and np.allclose(special.beta_cdf(x, 1.0, 80.0), 1 - (1 - x) ** 80, atol=1e-12)
    v = np.linspace(0.01, 30, 50)
    assert np.allclose(special.gamma_cdf(v, 1.0), 1 - np.exp(-v), atol=1e-12)
    assert np.allclose(special.gamma_cdf(v, 3.0), 1 - np.exp(-v) * (1 + v + v * v / 2), atol=1e-12)
    assert np.allclose(special.normal_scores(special.normal_cdf(np.linspace(-5, 5, 50))), np.linspace(-5, 5, 50), atol=1e-5)


def test_planted_families_are_recovered(spark):
    rng = np.random.default_rng(11)
    n = 6000
    z = rng.normal(size=(n, 2))
    planted = {
        "beta": rng.beta(0.6, 2.0, n) * 8 + 1, "gamma": rng.gamma(1.5, 4.0, n), "normal": rng.normal(5, 2, n), "uniform": rng.uniform(2, 3, n),
        "constant": np.full(n, 4.0), "two": (rng.random(n) < 0.2).astype(float), "gappy": np.where(rng.random(n) < 0.3, np.nan, rng.uniform(0, 1, n)),
    }
    df = spark.createDataFrame(pd.DataFrame(planted)).repartition(4)
    got = marginals.fit_marginals(df, list(planted))
    family = {c: m.family for c, m in got.items()}
    assert [family[c] for c in ("beta", "gamma", "normal", "constant", "two")] == ["beta", "gamma", "normal", "constant", "two values"]
    for c in ("uniform", "gappy"):  # a beta of shapes 1 and 1 is uniform
        assert family[c] == "uniform" or family[c] == "beta" and (got[c].a, got[c].b) == (pytest.approx(1, abs=0.1), pytest.approx(1, abs=0.1))
    assert (got["beta"].a, got["beta"].b) == (pytest.approx(0.6, abs=0.08), pytest.approx(2.0, abs=0.25))
    assert (got["gamma"].a, got["gamma"].b) == (pytest.approx(1.5, abs=0.15), pytest.approx(4.0, abs=0.4))
    fits = {c: marginals.moment_fits(*m) for c, m in marginals.column_moments(df, ["normal", "gamma"]).items()}
    for r in marginals.family_distances(df, fits, large=True).collect():
        v = np.sort(planted[r["feature"]])
        f = fits[r["feature"]][r["family"]].cdf(v)
        assert r["distance"] == pytest.approx(np.maximum(np.abs(np.arange(1, n + 1) / n - f), np.abs(np.arange(n) / n - f)).max(), abs=1e-12)
    both = spark.createDataFrame(pd.DataFrame({"a": np.exp(z[:, 0]), "b": 0.8 * z[:, 0] + 0.6 * z[:, 1]}))
    corr = marginals.score_correlation(both, marginals.fit_marginals(both, ["a", "b"]))
    assert corr[0, 1] == pytest.approx(0.8, abs=0.08)
    assert marginals.fit_marginals(df.where("false"), ["beta"]) == {}


def test_copula_keeps_shapes_and_dependence(spark):
    rng = np.random.default_rng(12)
    n = 4000
    z = rng.normal(size=(n, 2))
    pdf = pd.DataFrame({"row_id": range(n), "label": (np.arange(n) % 4 == 0).astype(int), "x": np.exp(z[:, 0]) + 1, "y": 10 + 0.9 * z[:, 0] + 0.4 * z[:, 1]})
    made = balancing.copula_balance(spark.createDataFrame(pdf), ["x", "y"], 0.9).where("row_id < 0").toPandas()
    small = pdf[pdf.label == 1]
    assert made.y.mean() == pytest.approx(small.y.mean(), abs=0.1) and made.y.std() == pytest.approx(small.y.std(), abs=0.1)
    assert made.x.median() == pytest.approx(small.x.median(), rel=0.25)
    assert made[["x", "y"]].corr("spearman").iloc[0, 1] == pytest.approx(small[["x", "y"]].corr("spearman").iloc[0, 1], abs=0.08)


def test_copula_counts_and_domains(spark, planted):
    df = planted.withColumn("x_is_missing", (F.col("f1") > 0.5).cast("double")).withColumn("ag_000", F.round(F.col("f2") * 9))
    cols = ["f0", "x_is_missing", "ag_000"]
    n1 = planted.where("label = 1").count()
    out = balancing.copula_balance(df, cols, 0.75).toPandas()
    made = out[out.row_id < 0]
    assert len(made) == int((300 - n1) * 0.75) - n1
    assert set(made.x_is_missing) <= {0.0, 1.0} and (made[cols] >= 0).all().all()
    assert (made.ag_000 == made.ag_000.round()).all() and made.f0.min() > 0.6
    assert balancing.copula_balance(df, cols, 0.01).count() == 300
    with pytest.raises(ValueError):
        balancing.copula_balance(df.withColumn("f0", F.when(F.col("row_id") > 5, F.col("f0"))), cols, 0.75)


def test_isolation_forest_finds_planted_rows_and_rescues_failures(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3))
    x[:5] += 12
    df = spark.createDataFrame(
        [(i, int(i < 2), *map(float, v)) for i, v in enumerate(x)], "row_id long, label int, a double, b double, c double"
    )
    out = outliers.isolation_forest(df, ["a", "b", "c"], 0.01, trees=50).toPandas()
    assert set(out[out.is_outlier == 1].row_id) == set(range(5))
    assert set(out[out.keep == 0].row_id) == {2, 3, 4}
    audit = outliers.outlier_audit(spark.createDataFrame(out)).first()
    assert audit["n_dropped"] == 3 and audit["n_failures"] == 0


def test_consensus_finds_the_planted_feature(spark, planted):
    votes = selection.select_vote(planted, COLS, 2).toPandas().set_index("feature")
    assert votes.loc["f0", "votes"] == 3 and votes.loc["f0", "selected"] == 1
    assert selection.rank_lasso(planted, COLS, 1, alpha=0.01).first()["feature"] == "f0"
    assert selection.rank_rfe_forest(planted, COLS, 1, trees=5, step=0.4).first()["feature"] == "f0"
    union = {r["feature"] for r in selection.select_union_fast(planted, COLS, 1).collect()}
    assert "f0" in union


def test_vote_fallback(spark):
    mk = lambda names: spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "feature string, rank int")
    imp = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.5)], "feature string, stat double")
    out = selection.consensus_vote({"x": mk(["a"]), "y": mk(["b"])}, 1, 2, imp).toPandas()
    assert out[out.selected == 1].feature.tolist() == ["b"]


def expectation(tree, x, known, node=0):
    """Path-dependent conditional expectation of one tree."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node] * tree.weight
    left, right = tree.left[node], tree.right[node]
    if f in known:
        return expectation(tree, x, known, left if x[f] <= tree.split[node] else right)
    w = tree.cover[left] / tree.cover[node]
    return w * expectation(tree, x, known, left) + (1 - w) * expectation(tree, x, known, right)


def test_attributions_equal_brute_force_shapley(spark, fitted):
    model, _, valid = fitted
    trees = explain.read_trees(model)
    rows = explain.shap_values(model, valid, COLS).join(valid.select("row_id", *COLS), "row_id").orderBy("row_id").limit(5).collect()
    n = len(COLS)
    for r in rows:
        x = np.array([r[c] for c in COLS])
        v = {s: sum(expectation(t, x, set(s)) for t in trees) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
        for i in range(n):
            want = sum(
                math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (v[tuple(sorted((*s, i)))] - v[s])
                for s in v if i not in s
            )
            assert r["phi"][i] == pytest.approx(want, abs=1e-9)
        assert sum(r["phi"]) + r["base"] == pytest.approx(r["margin"])


def test_margin_gives_the_model_probability(spark, fitted):
    model, _, valid = fitted
    both = explain.shap_values(model, valid, COLS).join(models.predict(model, valid, COLS, ["row_id"]), "row_id")
    gap = both.agg(F.max(F.abs(F.col("prob") - 1 / (1 + F.exp(-2 * F.col("margin")))))).first()[0]
    assert gap < 1e-12


def test_permutation_pdp_and_rules(spark, fitted):
    model, _, valid = fitted
    pi = explain.permutation_importance_cost(model, valid, COLS, 0.5, repeats=3).toPandas()
    assert pi.feature[0] == "f0" and pi.pi_mean[0] > 0
    ice = explain.pdp_ice(model, valid, COLS, ["f0"], points=5)
    assert ice.count() == 5 * valid.count()
    curve = explain.pdp(ice).orderBy("grid").toPandas().pdp
    assert curve.iloc[-1] > curve.iloc[0]
    tree, fidelity = explain.surrogate_tree(model, valid, COLS, 0.5, 3)
    rules = explain.surrogate_rules(tree, COLS, valid).toPandas()
    assert rules.n.sum() == valid.count() and fidelity > 0.9


def test_explain_run(spark, planted):
    out = rca.explain_run(planted, COLS, registry=QUICK, repeats=1, pdp_top=1)
    assert out["shap_global"].first()["feature"] == "f0"
    assert out["ranks"].first()["feature"] == "f0"
    assert out["shap_local"].count() > 0


def test_cv_and_grid(spark, planted):
    out = experiment.experiment_grid(
        {"Raw": (planted, COLS)}, ["tree", "missing-model"], folds=2, preprocess=False, registry=QUICK,
        tunings={"Tuned": True}, selectors={"Kruskal": lambda df, cols: ["f0", "f1"]},
    )
    done, failed = out.collect()
    assert done["status"] == "ok" and done["auc_mean"] > 0.9
    assert done["run_name"] == "tree | Raw + Kruskal | No Sampling | Tuned"
    assert failed["model"] == "missing-model" and failed["status"] == "failed" and failed["cost_mean"] is None
    assert "missing-model" in failed["message"]
    assert experiment.best_per_feature_set(out).first()["model"] == "tree"


def test_best_runs_are_scored_on_test_rows(spark, planted):
    train, test = planted.where("row_id % 4 <> 0"), planted.where("row_id % 4 = 0")
    options = {"tunings": {"Tuned": True, "Default": False}, "selectors": {"None": None, "First": lambda df, cols: ["f0"]}}
    runs = experiment.experiment_grid({"Raw": (train, COLS)}, ["tree", "missing-model"], folds=2, preprocess=False, registry=QUICK, **options)
    out = experiment.leaderboard_on_test(runs, {"Raw": (train, test, COLS)}, top_n=3, preprocess=False, registry=QUICK, **options).collect()
    best = runs.where("status = 'ok'").orderBy("cost_mean", "run_name").limit(3).collect()
    assert [(r["rank"], r["run_name"], r["cost_mean"]) for r in out] == [(i + 1, b["run_name"], b["cost_mean"]) for i, b in enumerate(best)]
    for r, b in zip(out, best):
        want = experiment.evaluate_holdout(train, test, COLS, b["model"], selector=options["selectors"][b["selector"]], tune=options["tunings"][b["tuning"]],
                                           preprocess=False, registry=QUICK).first()
        assert r["status"] == "ok" and (r["auc"], r["cost"], r["threshold"]) == (want["auc"], want["cost"], want["threshold"])
    lost = experiment.leaderboard_on_test(runs, {}, top_n=1, **options).first()
    assert lost["status"] == "failed" and "KeyError" in lost["message"] and lost["cost"] is None


def test_modules_and_named_selectors_in_folds(spark, planted):
    gaps = planted.withColumns({c: F.when(F.pmod("row_id", F.lit(m)) != 0, F.col(c)) for c, m in (("f3", 4), ("f4", 4))})
    out = experiment.cv_cost(gaps, COLS, "tree", 2, registry=QUICK, modules=True, selector="kruskal", n_features=1).collect()
    assert len(out) == 2 and all(r["features"] == ["f0"] for r in out)
    every = experiment.cv_cost(gaps, COLS, "tree", 2, registry=QUICK, modules=True).collect()
    assert all("Module_1_Connectivity" in r["features"] for r in every)
    union = {r["feature"] for r in selection.select_union(planted, COLS, 1, trees=5).collect()}
    assert "f0" in union


def test_trees_share_one_scheme_at_every_size(spark):
    for n in (20, 400):
        vec = spark.range(n).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("vec"))
        rows = outliers.tree_samples(vec, 3, 16, 42, "row_id").toPandas()
        assert (rows.groupby("tree").id.nunique() == 16).all() and len(rows) == 48


def test_run_plan_uses_percentages_only_with_a_sampler():
    plan = experiment.run_plan(["m"], ["s"], {"None": None}, {"No": None, "C": "copula"}, {"T": True}, [0.25, 0.5])
    assert [p["pct"] for p in plan] == [None, 0.25, 0.5]
    assert plan[1]["run_name"] == "m | s | C | T | Sampling Percentage: 0.25"
