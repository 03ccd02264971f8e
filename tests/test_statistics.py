import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.functions.numeric import chi2_sf
from faultline.operators import correlation, cost, describe, prefix, ranktests, sampling
from faultline.operators.order import seeded_rank, seeded_take


def frame(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "row_id": np.arange(n), "label": (rng.random(n) < 0.3).astype(int),
        "a": rng.normal(size=n), "b": rng.integers(0, 6, n).astype(float), "c": rng.random(n),
    })
    pdf.loc[rng.random(n) < 0.2, "c"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def avg_rank(x):
    return pd.Series(x).rank().to_numpy()


def test_running_counts_two_forms_agree(spark):
    _, df = frame(spark)
    counts = prefix.class_counts_by_value(df, ["a", "b", "c"], "label")
    both = [
        sorted(map(tuple, prefix.running_counts(counts, ["feature"], "value", ["n0", "n1"], large).collect()))
        for large in (False, True)
    ]
    assert both[0] == both[1]


@pytest.mark.parametrize("large", [False, True])
def test_quantiles_interpolate(spark, large):
    pdf, df = frame(spark)
    got = prefix.quantile_map(df, ["a", "c"], [0.1, 0.5, 0.9], large)
    for c in ("a", "c"):
        assert got[c] == pytest.approx(np.quantile(pdf[c].dropna(), [0.1, 0.5, 0.9]).tolist())


def test_many_quantiles_at_once(spark):
    pdf, df = frame(spark)
    probs = [i / 20 for i in range(21)]
    got = prefix.quantile_map(df, ["a", "b", "c"], probs)
    for c in ("a", "b", "c"):
        assert got[c] == pytest.approx(np.quantile(pdf[c].dropna(), probs).tolist())


def test_quantiles_known_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert prefix.quantile_map(df, ["x"], [0.25, 0.5, 0.75])["x"] == [1.75, 2.5, 4.75]


def test_kruskal_toy(spark):
    df = spark.createDataFrame(
        [(v, 1.0, y) for v, y in zip([1.0, 2.0, 3.0, 10.0, 11.0, 12.0], [0, 0, 0, 1, 1, 1])],
        "good_feat double, bad_feat double, label int",
    )
    rows = {r["feature"]: r for r in ranktests.kruskal_wallis(df, ["good_feat", "bad_feat"]).collect()}
    assert rows["good_feat"]["stat"] == pytest.approx(27 / 7)
    assert rows["good_feat"]["p_value"] == pytest.approx(math.erfc(math.sqrt(27 / 14)))
    assert rows["good_feat"]["rank"] == 1 and rows["bad_feat"]["p_value"] == 1.0


def test_one_row_features_do_not_divide_by_zero(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, 2.0)], "label int, x double, y double")
    assert {r["p_value"] for r in ranktests.kruskal_wallis(df, ["x", "y"]).collect()} == {1.0}
    scores = spark.createDataFrame([(0.1, 0), (0.2, 0)], "prob double, label int")
    assert {r["tpr"] for r in cost.roc_curve(scores).collect()} == {None}
    assert cost.metrics_at(scores, 0.15).first()["auc"] is None


def test_ks_against_scan(spark):
    pdf, df = frame(spark)
    got = {r["feature"]: r["stat"] for r in ranktests.ks_two_sample(df, ["a", "b", "c"], alpha=1.0).collect()}
    for c in "abc":
        x0, x1 = (pdf.loc[(pdf.label == k) & pdf[c].notna(), c].to_numpy() for k in (0, 1))
        grid = np.unique(np.concatenate([x0, x1]))
        want = max(abs((x0 <= g).mean() - (x1 <= g).mean()) for g in grid)
        assert got[c] == pytest.approx(want)


def test_ks_one_sided_class_is_not_significant(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0)], "label int, x double")
    assert ranktests.ks_pvalues(df, ["x"]).first()["p_value"] == 1.0


def test_spearman_against_pandas(spark):
    pdf, df = frame(spark)
    got = {r["feature"]: r["rho"] for r in correlation.spearman_with(df, ["a", "c"], "b").collect()}
    for c in ("a", "c"):
        ok = pdf[c].notna()
        want = np.corrcoef(avg_rank(pdf.loc[ok, c]), avg_rank(pdf.loc[ok, "b"]))[0, 1]
        assert got[c] == pytest.approx(want)
    large = {r["feature"]: r["rho"] for r in correlation.spearman_with(df, ["a", "c"], "b", large=True).collect()}
    assert large == pytest.approx(got)
    lab = {r["feature"]: r["rho"] for r in ranktests.spearman_with_label(df, ["a", "b"]).collect()}
    assert lab["a"] == pytest.approx(np.corrcoef(avg_rank(pdf.a), avg_rank(pdf.label))[0, 1])


def test_cost_curve_against_full_scan(spark):
    rng = np.random.default_rng(1)
    prob, y = np.round(rng.random(500), 3), (rng.random(500) < 0.1).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"prob": prob, "label": y}))
    for large in (False, True):
        rows = cost.cost_curve(df, cost.tuning_grid(spark), large=large).collect()
        assert len(rows) == 4002
        for r in rows[::37]:
            hit = prob >= r["threshold"]
            assert (r["fp"], r["fn"]) == ((hit & (y == 0)).sum(), (~hit & (y == 1)).sum())
    thr = np.array([i * (0.4 / 4001) for i in range(4002)])
    costs = [10 * ((prob >= t) & (y == 0)).sum() + 500 * ((prob < t) & (y == 1)).sum() for t in thr]
    best = cost.best_threshold_grid(df).first()
    assert best["cost"] == min(costs) and best["threshold"] == pytest.approx(thr[int(np.argmin(costs))])


def test_dense_grid_has_190_points(spark):
    g = sorted(r[0] for r in cost.dense_grid(spark).collect())
    assert len(set(g)) == 190 and g[0] == 0 and g[-1] == 0.99 and g[100] == 0.1 and g[101] == 0.11


def test_roc_threshold_ties_go_high(spark):
    df = spark.createDataFrame([(0.2, 0), (0.5, 0), (0.9, 0)], "prob double, label int")
    assert cost.best_threshold_roc(df).first()["threshold"] == math.inf
    assert cost.best_threshold_roc(df, with_infinity=False).first()["threshold"] == 0.9


def test_metrics_with_ties_and_zero_division(spark):
    df = spark.createDataFrame([(0.5, 0), (0.5, 1), (0.1, 0), (0.9, 1)], "prob double, label int")
    m = cost.metrics_at(df, 0.95).first()
    assert m["auc"] == pytest.approx(0.875) and m["precision"] == 0 and m["recall"] == 0 and m["cost"] == 1000


def test_normalised_scores_flat(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "d double")
    assert [r["prob"] for r in cost.normalised_scores(df, "d").collect()] == [0.5, 0.5]


def test_folds_partition_rows_and_keep_shares(spark):
    pdf, df = frame(spark)
    out = sampling.stratified_kfold(df, 4).toPandas()
    assert sorted(out.row_id) == sorted(pdf.row_id)
    for _, g in out.groupby("label"):
        sizes = g.fold.value_counts()
        assert sizes.max() - sizes.min() <= 1


def test_seeded_order_does_not_depend_on_partitions(spark):
    _, df = frame(spark)
    results = []
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        ranks = sorted(map(tuple, seeded_rank(df.repartition(n), ["label"]).select("row_id", "rank").collect()))
        taken = sorted(r["row_id"] for r in seeded_take(df.repartition(n + 2), 57).collect())
        results.append((ranks, taken))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] and len(results[0][1]) == 57


def test_undersample_is_exact(spark):
    pdf, df = frame(spark)
    out = sampling.undersample_majority(df, 1.5).toPandas()
    n_pos = int(pdf.label.sum())
    assert (out.label == 1).sum() == n_pos and (out.label == 0).sum() == int(n_pos * 1.5)
    assert out.row_id.is_unique


def test_class_weights_balance(spark):
    _, df = frame(spark)
    rows = sampling.class_weights(df).collect()
    assert rows[0]["n"] * rows[0]["weight"] == pytest.approx(rows[1]["n"] * rows[1]["weight"])


def test_chi2_tail():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert chi2_sf(0.0, 3) == 1.0


def test_density_sums_to_one(spark):
    _, df = frame(spark)
    out = describe.histogram_by_class(df, ["a"], 10).toPandas()
    assert out.groupby("label").cdf.max().tolist() == pytest.approx([1.0, 1.0])


def test_slices_and_plain_windows_agree(spark):
    """Hot values, hot keys, NULL keys, few and many rows: sums and ranks don't depend on the cuts."""
    rng = np.random.default_rng(6)
    n = 4000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.6, 1, rng.integers(0, 5, n)), "v": np.where(rng.random(n) < 0.4, 7.0, np.round(rng.exponential(5, n), 2)), "w": rng.integers(1, 4, n)})
    df = spark.createDataFrame(pdf).selectExpr("nullif(k, 4) as k", "v", "w", "cast(rand(3) * 1e6 as long) as other").repartition(5)
    agg = df.groupBy("k", "v").agg(F.sum("w").alias("w"))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for keys in (["k"], []):
        rows = agg if keys else agg.groupBy("v").agg(F.sum("w").alias("w"))
        plain, cut = (sorted(map(tuple, prefix.running_counts(rows, keys, "v", ["w"], large).collect()), key=key) for large in (False, True))
        assert plain == cut
        fitted = prefix.fitted_cuts(df, keys, [F.col("v")], 64)[0]
        assert fitted is not None
        cols = [*keys, "v", "w", "other", "rank", "total"]
        plain, cut = (sorted((tuple(r) for r in prefix.carried_ranks(df, keys, "v", "w", "rank", c, "total").select(*cols).collect()), key=key) for c in (None, fitted))
        assert plain == cut
    explained = cost.cost_curve(spark.createDataFrame(pd.DataFrame({"prob": rng.random(3000), "label": rng.integers(0, 2, 3000)})), large=True)._jdf.queryExecution().toString()
    assert "Window" in explained


def test_one_plan_for_many_gappy_columns(spark):
    """60 gappy columns: one plan of two carried ranks, the same values as pandas."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 60))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 7] = np.where(np.isnan(x[:, 7]), np.nan, 1.0)
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(60)])
    df = spark.createDataFrame(pdf.assign(row_id=range(150)).reset_index(drop=True))
    got = correlation.spearman_matrix(df, list(pdf.columns))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window ") <= 8
    want = pdf.corr("spearman", min_periods=2)
    rows = got.collect()
    assert len(rows) == 60 * 60
    for r in rows:
        expected = want.loc[r["a"], r["b"]]
        assert (r["rho"] is None) if np.isnan(expected) else r["rho"] == pytest.approx(expected)


def test_slices_are_found_in_generated_code(spark):
    cuts = {"a": [0.0], "b": [float(v) for v in range(0, 130, 2)]}
    table = spark.createDataFrame(list(cuts.items()), "k string, _cuts array<double>")
    values = [None, -1.0, 0.0, 0.5, *[float(v) for v in range(1, 135, 3)]]
    rows = spark.createDataFrame([(k, v) for k in ("a", "b", "none", None) for v in values], "k string, v double")
    for most in (None, 65):  # unknown, and as fitted cuts tell it
        known = table if most is None else table.select("k", F.col("_cuts").alias("_cuts", metadata={"most": most}))
        found = prefix.with_slice(rows, ["k"], F.col("v"), known)
        assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()
        for r in found.collect():
            own = np.array(cuts.get(r["k"], []))
            at = 0 if r["v"] is None else int(np.searchsorted(own, r["v"]))
            assert r["_slice"] == 2 * at + int(at < len(own) and r["v"] is not None and own[at] == r["v"])
    fitted = prefix.fitted_cuts(spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("v")), ["k"], [F.col("v")], 100)[0]
    assert fitted.schema["_cuts"].metadata["most"] == len(fitted.first()["_cuts"])
