import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators import discovery, graphs, independence, logit
from faultline.plans import causal


def edges(spark, rows):
    return spark.createDataFrame([("r", a, b, float(w)) for a, b, w in rows], "run_id string, src string, dst string, weight double")


def pairs(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


def test_cleanup_rules(spark):
    e = edges(spark, [("class", "f1", 1), ("class", "aa_000", 1), ("f2", "aa_000", 1), ("aa_000", "class", 1), ("f1", "f2", 0.001), ("f1", "f2", -0.5)])
    assert pairs(graphs.edge_cleanup(e)) == {("f1", "class"), ("aa_000", "f2"), ("f1", "f2")}
    off = graphs.edge_cleanup(e, False, False, False)
    assert ("class", "f1") in pairs(off) and ("aa_000", "class") in pairs(off)
    assert ("aa_000", "class") in pairs(graphs.edge_cleanup(e, True, False, False))


def test_roles_layers_depth(spark):
    e = edges(spark, [("aa_000", "f1", 1), ("f1", "f2", 1), ("f2", "class", 1), ("f3", "class", 1), ("class", "f4", 1), ("f2", "f1", 1)])
    roles = {r["node"]: r["role"] for r in graphs.node_roles(e).collect()}
    assert roles == {"f1": "Mediator", "f2": "Mediator", "f3": "Physical Root", "f4": "Unconnected"}
    layers = {(r["node"], r["layer"]) for r in graphs.hybrid_layers(e).collect()}
    assert layers == {("aa_000", 1), ("f1", 2), ("f2", 3), ("class", 4)}
    depth = {r["node"]: r["layer"] for r in graphs.path_depth(e).collect()}
    assert depth == {"class": 10, "f2": 8, "f3": 8, "f1": 7, "aa_000": 6, "f4": 0}


def test_hybrid_first_edge_of_a_pair_wins(spark):
    lin = edges(spark, [("a", "b", 1)])
    pc = edges(spark, [("b", "a", 1), ("class", "c", 1), ("d", "aa_000", 1), ("c", "d", 1), ("d", "c", 1)])
    got = {(r["src"], r["dst"], r["type"]) for r in graphs.hybrid_graph(lin, pc).collect()}
    assert got == {("a", "b", "LiNGAM"), ("c", "class", "PC_Rescue"), ("aa_000", "d", "PC_Rescue"), ("c", "d", "PC_Rescue")}


def test_prior_table_equals_driver_rules(spark):
    groups = {"aa_000": "Global", "f1": "Secondary", "f2": "Diagnostic", "class": "x"}
    df = spark.createDataFrame([("r", f, g) for f, g in groups.items()], "run_id string, feature string, feature_group string")
    table = {(r["cause"], r["effect"]) for r in graphs.prior_matrix(df).collect() if r["forbidden"] == -1 and r["cause"] != r["effect"]}
    assert table == discovery.forbidden_pairs(list(groups), groups)


def test_chi_square_against_dense_tables(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({c: rng.integers(0, 3, 400) for c in "xyz"})
    out = independence.chisq_ci(spark.createDataFrame(pdf).repartition(5), [("x", "y", ()), ("x", "y", ("z",))]).collect()
    want = []
    for strata in ([pdf], [g for _, g in pdf.groupby("z")]):
        stat = dof = 0
        for g in strata:
            t = pd.crosstab(g.x, g.y).to_numpy()
            e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
            stat, dof = stat + ((t - e) ** 2 / e).sum(), dof + (t.shape[0] - 1) * (t.shape[1] - 1)
        want.append((stat, dof))
    for r in out:
        assert (r["stat"], r["dof"]) == (pytest.approx(want[r["test"]][0]), want[r["test"]][1])


def test_pc_finds_a_collider(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    c = np.where(rng.random(4000) < 0.9, a + b, rng.integers(0, 3, 4000))
    d = np.where(rng.random(4000) < 0.9, c, rng.integers(0, 3, 4000))
    codes = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "d": d}))
    assert pairs(discovery.pc_skeleton_orient(codes, list("abcd"))) == {("a", "c"), ("b", "c"), ("c", "d")}


def test_lingam_recovers_a_chain(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(-1, 1, 4000)
    b = 0.8 * a + rng.uniform(-1, 1, 4000)
    c = 0.7 * b + rng.uniform(-1, 1, 4000)
    df = spark.createDataFrame(pd.DataFrame({"c": c, "a": a, "b": b})).repartition(4)
    got = {(r["src"], r["dst"]): r["weight"] for r in discovery.direct_lingam(df, ["c", "a", "b"]).collect()}
    strong = {k: v for k, v in got.items() if abs(v) > 0.1}
    assert set(strong) == {("a", "b"), ("b", "c")}
    assert strong[("a", "b")] == pytest.approx(0.8, abs=0.1)


def newton(x, y, precision=0.0):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (p * (1 - p))[:, None]).T @ x + precision
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - precision @ beta if np.ndim(precision) else x.T @ (y - p))
    return beta, np.linalg.inv(h)


@pytest.fixture(scope="module")
def logit_data(spark):
    rng = np.random.default_rng(4)
    age, f = rng.normal(size=600), rng.normal(size=600)
    y = (rng.random(600) < 1 / (1 + np.exp(1 - 0.5 * age - 0.9 * f))).astype(int)
    g = 0.95 * f + 0.1 * rng.normal(size=600)
    pdf = pd.DataFrame({"row_id": range(600), "label": y, "aa_000": age, "f": f, "g": g, "flat": 1.0})
    return pdf, spark.createDataFrame(pdf).repartition(3)


def test_logit_equals_newton(logit_data):
    pdf, df = logit_data
    rows = {r["feature"]: r for r in logit.age_adjusted_logit(df, ["f", "g", "flat", "aa_000"]).collect()}
    assert {f: r["converged"] for f, r in rows.items()} == {"f": True, "g": True, "flat": False}
    assert rows["flat"]["coef"] is None
    x = np.column_stack([np.ones(600), pdf.aa_000, pdf.f])
    beta, cov = newton(x, pdf.label.to_numpy())
    assert rows["f"]["coef"] == pytest.approx(beta[2], abs=1e-7) and rows["f"]["age_coef"] == pytest.approx(beta[1], abs=1e-7)
    assert rows["f"]["upper_ci"] - rows["f"]["coef"] == pytest.approx(1.959964 * np.sqrt(cov[2, 2]), abs=1e-5)
    uni = logit.univariate_age_logit(df).first()
    assert uni["coef"] == pytest.approx(newton(x[:, :2], pdf.label.to_numpy())[0][1], abs=1e-7)


def posterior_on_a_grid(x, y, sd, points=81, reach=7.0):
    """Mean and shortest 94 % interval of the last coefficient, by summing the posterior over a grid."""
    design, precision = np.column_stack([np.ones(len(x)), x]), np.diag(1 / np.square(sd))
    mode, cov = newton(design, y, precision)
    # Long reach on every side: skewed posteriors have one long tail.
    axes = [m + np.linspace(-reach, reach, points) * np.sqrt(v) for m, v in zip(mode, np.diag(cov))]
    grid = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, len(axes))
    logp = -0.5 * ((grid @ precision) * grid).sum(axis=1)
    for row, truth in zip(design, y):
        eta = grid @ row
        logp += truth * eta - np.logaddexp(0, eta)
    p = np.exp(logp - logp.max()).reshape([points] * len(axes)).sum(axis=tuple(range(len(axes) - 1)))
    p /= p.sum()
    fine = np.linspace(axes[-1][0], axes[-1][-1], 20_001)
    w = np.interp(fine, axes[-1], p)
    return float(axes[-1] @ p), logit.shortest_interval(fine, w / w.sum())


def test_bayes_joint_posterior_and_prune(logit_data):
    pdf, df = logit_data
    assert logit.collinearity_prune(df, ["f", "g"]) in (["f"], ["g"])
    kept = logit.collinearity_prune(df, ["f", "g"])[0]
    out = logit.bayes_logit(df, ["f", "g", "aa_000"]).toPandas().set_index("feature")
    z = pdf[["aa_000", kept]]
    z = (z - z.mean()) / (z.std() + 1e-6)
    mean, (low, high) = posterior_on_a_grid(z.to_numpy(), pdf.label.to_numpy(), [1, 2.5, 2.5], 41, 5.0)
    got = out.loc[kept]
    assert got["mean"] == pytest.approx(mean, abs=0.01) and (got.hdi_3, got.hdi_97) == (pytest.approx(low, abs=0.03), pytest.approx(high, abs=0.03))
    assert got["tail"] < 0.7 and got.converged and got.odds_ratio == pytest.approx(np.exp(got["mean"]))


def test_bayes_intervals_of_a_skewed_posterior(spark):
    """Few rows, one positive: the posterior is far from the Gaussian at its mode."""
    x = np.array([-1.0, -0.7, -0.4, -0.1, 0.1, 0.3, 0.6, 0.9, 1.5, 2.6])
    y = (x > 2).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "f": x, "aa_000": np.roll(x, 3)}))
    scaled = (x - x.mean()) / (x.std(ddof=1) + 1e-6)
    mean, (low, high) = posterior_on_a_grid(scaled[:, None], y, [1, 2.5], 401, 9.0)
    got = logit.bayes_logit(df, ["f"], draws=20_000).first()
    assert got["mean"] == pytest.approx(mean, abs=0.05) and (got["hdi_3"], got["hdi_97"]) == (pytest.approx(low, abs=0.12), pytest.approx(high, abs=0.12))
    mode, cov = newton(np.column_stack([np.ones(10), scaled]), y, np.diag([1, 1 / 6.25]))
    assert abs(mode[1] - mean) > 0.2  # what an approximation at the mode would miss
    mean, (low, high) = posterior_on_a_grid(np.column_stack([df.toPandas().aa_000, x]), y, [1, 2.5, 2.5], 101, 9.0)
    rows = {r["feature"]: r for r in logit.bayes_logit_by_feature(df, ["f", "aa_000"], draws=20_000).collect()}
    assert set(rows) == {"f"} and rows["f"]["mean"] == pytest.approx(mean, abs=0.06)
    assert (rows["f"]["hdi_3"], rows["f"]["hdi_97"]) == (pytest.approx(low, abs=0.15), pytest.approx(high, abs=0.15))


def test_smoothed_weights_and_intervals():
    rng = np.random.default_rng(5)
    weight, shape = logit.smoothed_weights(np.zeros(500))
    assert np.allclose(weight, 1 / 500) and shape == 0
    for k in (0.3, 0.9):  # ratios with a Pareto tail of known shape
        weight, shape = logit.smoothed_weights(np.log(rng.pareto(1 / k, 20_000) + 1))
        assert shape == pytest.approx(k, abs=0.15) and weight.sum() == pytest.approx(1) and (weight >= 0).all()
    assert logit.shortest_interval(np.array([0.0, 1.0, 1.1, 1.2, 9.0]), np.full(5, 0.2), 0.6) == (1.0, 1.2)
    assert logit.shortest_interval(np.array([3.0]), np.array([1.0])) == (3.0, 3.0)


def test_rules_grid_respects_rules(spark, cust):
    names = ["aa_000", "ag_000", "ag_003"]
    groups = {"aa_000": "Global", "ag_000": "Secondary", "ag_003": "Diagnostic"}
    out = causal.experiment_rules_grid(cust, names, groups, experiments=[(True, True, True)])
    e = pairs(out["edges"])
    assert not any(s == "class" or d == "aa_000" for s, d in e) and ("aa_000", "class") not in e
    assert {r["experiment"] for r in out["nodes"].collect()} == {"EXP_TTT"}


def test_rules_grid_validates_its_candidates(spark, cust):
    """Screened coefficients where time is a source (time alone if it may act directly), posteriors for candidates."""
    names = ["aa_000", "ag_000", "ag_003", "ba_000"]
    groups = {"aa_000": "Global", "ag_000": "Secondary", "ag_003": "Diagnostic", "ba_000": "Secondary"}
    rules = [(False, False, False), (True, True, False), (True, True, True)]
    out = causal.experiment_rules_grid(cust, names, groups, experiments=rules)["nodes"].collect()
    assert {(r["experiment"], r["algo"]) for r in out} == {(f"EXP_{e}", a) for e in ("FFF", "TTF", "TTT") for a in ("PC", "LiNGAM")}
    from faultline.operators import scaling

    whole = scaling.standard_scale(cust.select("row_id", "label", *names), names)
    screened = {r["feature"]: r["coef"] for r in logit.age_adjusted_logit(whole, names).collect()}
    alone = logit.univariate_age_logit(whole).first()["coef"]
    assert set(causal._screen(whole, names, "aa_000", "label", (True, False))) == set(names)
    assert causal._screen(whole, names, "aa_000", "label", (True, False))["aa_000"][0] == pytest.approx(alone)
    for r in out:
        if r["experiment"] == "EXP_FFF":
            assert r["coef"] is None
        else:
            assert r["coef"] == pytest.approx(screened[r["node"]])
    both = {(r["experiment"], r["node"]): r["role"] for r in out if r["algo"] == "LiNGAM"}
    for r in out:
        if r["posterior_mean"] is not None:
            assert both[r["experiment"], r["node"]] in ("Physical Root", "Mediator") and r["posterior_odds"] == pytest.approx(np.exp(r["posterior_mean"]))
    rows = causal.validated(whole, ["ag_000", "ba_000"], None, "aa_000", "label", "x").collect()
    assert {r["node"] for r in rows} <= {"ag_000", "ba_000"} and all(r["coef"] is None for r in rows) and rows


def test_one_global():
    groups = {"a": "Global", "aa_000": "Global", "b": "Secondary"}
    assert causal.one_global(["a", "b", "aa_000"], groups) == ["b", "aa_000"]


def _runs(spark, runs, rows=600):
    rng = np.random.default_rng(7)
    parts = []
    for r in range(runs):
        a, b = rng.integers(0, 2 + r % 2, rows), rng.integers(0, 3, rows)
        c = np.where(rng.random(rows) < 0.5 + 0.1 * (r % 5), (a + b) % 3, rng.integers(0, 3, rows))
        d = np.where(rng.random(rows) < 0.8, c, rng.integers(0, 3, rows))
        e = np.where(rng.random(rows) < 0.4, a, rng.integers(-2, 2, rows))
        parts.append(pd.DataFrame({"run_id": r, "a": a, "b": b, "c": c, "d": d, "e": e}))
    return pd.concat(parts)


def plain_skeleton(pdf, names, alpha):
    """Every test of every level, one at a time, from dense tables."""
    from itertools import combinations

    from faultline.functions.numeric import chi2_sf

    def p_value(x, y, z):
        stat = dof = 0
        for _, g in pdf.groupby(list(z)) if z else [(0, pdf)]:
            t = pd.crosstab(g[x], g[y]).to_numpy()
            e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
            stat, dof = stat + ((t - e) ** 2 / e).sum(), dof + (t.shape[0] - 1) * (t.shape[1] - 1)
        return chi2_sf(stat, dof)

    adj, sep, level = {a: set(names) - {a} for a in names}, {}, 0
    while any(len(v) > level for v in adj.values()):
        before = {a: set(v) for a, v in adj.items()}
        for a, b in combinations(sorted(names), 2):
            if b in before[a]:
                sets = sorted({z for p, q in ((a, b), (b, a)) for z in combinations(sorted(before[p] - {q}), level)})
                z = next((z for z in sets if p_value(a, b, z) > alpha), None)
                if z is not None:
                    sep[a, b] = set(z)
                    adj[a].discard(b)
                    adj[b].discard(a)
        level += 1
    return adj, sep, level


def test_pc_of_many_runs_in_as_many_jobs_as_levels(spark, monkeypatch):
    pdf, names = _runs(spark, 40), list("abcde")
    df = spark.createDataFrame(pdf).repartition(6)
    asked, answer = [], discovery._p_values
    monkeypatch.setattr(discovery, "_p_values", lambda *a: asked.append({r: list(t) for r, t in a[3].items()}) or answer(*a))
    found = discovery.pc_skeletons(df, names, "run_id")
    plain = {r: plain_skeleton(g, names, 0.05) for r, g in pdf.groupby("run_id")}
    assert {r: (s.adj, s.sepset) for r, s in found.items()} == {r: (adj, sep) for r, (adj, sep, _) in plain.items()}
    assert len(asked) == max(levels for _, _, levels in plain.values())
    asked.clear()
    parts = discovery.pc_skeletons(df, names, "run_id", batch=90)
    assert {r: (s.adj, s.sepset) for r, s in parts.items()} == {r: (s.adj, s.sepset) for r, s in found.items()}
    assert len(asked) > 5 and max(sum(map(len, a.values())) for a in asked) <= 100
    known = {("c", "a"), ("c", "b"), ("d", "c")}
    edges = {(r["run_id"], r["src"], r["dst"]) for r in discovery.pc_by_run(df.where("run_id < 3"), names, forbidden=known).collect()}
    alone = {(k, r["src"], r["dst"]) for k in range(3) for r in discovery.pc_skeleton_orient(df.where(f"run_id = {k}"), names, known).collect()}
    assert edges == alone and edges


def test_conditioning_sets_come_from_generators():
    """A dense graph's level is drawn in parts without listing it."""
    names = [f"v{i:02d}" for i in range(40)]
    search = discovery.SkeletonSearch(names, 0.05)
    assert search.start(15)  # 39 over 15 sets a side
    first = search.draw(2)
    assert len(first) == 2 * 780 and first[0] == ("v00", "v01", tuple(names[2:17]))
    assert search.draw(1)[0] == ("v00", "v01", (*names[2:16], names[18]))
    search.learn(first, [1.0] * len(first))
    assert not search.open and search.sepset["v00", "v01"] == set(names[2:17])


def test_lingam_of_many_runs_equals_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    parts = []
    for r in range(30):
        a = rng.uniform(-1, 1, 300 if r else 5000)
        b = (0.5 + r / 60) * a + rng.uniform(-1, 1, len(a))
        parts.append(pd.DataFrame({"run_id": f"r{r}", "c": 0.7 * b + rng.uniform(-1, 1, len(a)) + r, "a": a, "b": b}))
    pdf = pd.concat(parts)
    pdf.loc[pdf.index[:3], "a"] = np.nan
    df = spark.createDataFrame(pdf).repartition(5)
    jobs, terms = [], discovery.entropy_terms
    monkeypatch.setattr(discovery, "entropy_terms", lambda *a: jobs.append(sum(len(w) for w, _ in a[3].values())) or terms(*a))
    rules = {"free": set(), "no_ab": {("a", "b")}}
    got = {(r["run_id"], r["rule"], r["src"], r["dst"]): r["weight"] for r in discovery.lingam_by_run(df, ["c", "a", "b"], rules=rules).collect()}
    assert len(jobs) == 2
    jobs.clear()
    parts = {(r["run_id"], r["rule"], r["src"], r["dst"]): r["weight"] for r in discovery.lingam_by_run(df, ["c", "a", "b"], rules=rules, batch=50).collect()}
    assert parts == pytest.approx(got) and max(jobs) <= 50
    for r in ("r0", "r7", "r29"):
        for k, rule in rules.items():
            one = {(r, k, e["src"], e["dst"]): e["weight"] for e in discovery.direct_lingam(df.where(F.col("run_id") == r), ["c", "a", "b"], rule).collect()}
            assert one == pytest.approx({key: w for key, w in got.items() if key[:2] == (r, k)})
    assert ("r0", "no_ab", "a", "b") not in got and got["r0", "free", "a", "b"] == pytest.approx(0.5, abs=0.05)


def test_discovery_of_empty_and_null_runs(spark):
    df = spark.createDataFrame(_runs(spark, 2)).selectExpr("nullif(run_id, 1) as run_id", "a", "b", "c", "d", "e")
    assert discovery.pc_by_run(df.where("false"), list("abc")).count() == 0
    assert discovery.lingam_by_run(df.where("false"), list("abc")).count() == 0
    assert set(discovery.pc_skeletons(df, list("abcd"), "run_id")) == {0, None}
    assert {r["run_id"] for r in discovery.lingam_by_run(df, list("abcd")).collect()} == {0, None}


def test_lingam_of_degenerate_runs(spark):
    """Constant, doubled and nearly empty columns give finite weights and no warnings."""
    import warnings

    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, 200)
    pdf = pd.concat([
        pd.DataFrame({"run_id": 0, "a": x, "b": 2 * x, "c": 0.0, "d": x + rng.uniform(-1, 1, 200)}),
        pd.DataFrame({"run_id": 1, "a": x[:2], "b": x[2:4], "c": x[4:6], "d": x[6:8]}), pd.DataFrame({"run_id": 2, "a": [1.0], "b": 2.0, "c": 3.0, "d": 4.0})])
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        got = discovery.lingam_by_run(spark.createDataFrame(pdf), list("abcd")).collect()
    assert all(np.isfinite(r["weight"]) for r in got) and {r["run_id"] for r in got} <= {0, 1}
    assert all("c" not in (r["src"], r["dst"]) for r in got if r["run_id"] == 0)
