"""Kept tables are read by as many tasks as their rows need, whatever the number of shuffle partitions."""

import time

import pytest
from conftest import SF

from pyspark.sql import functions as F

from faultline.operators import models, prefix, sampling
from faultline.plans import experiment, rca
from faultline.sources import fixtures as X


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_feature_table_follows_its_rows(spark, many_partitions, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    small = X.build_cust_features(spark, SF).persist()
    assert _tasks(small) <= cores
    monkeypatch.setattr(X, "LINES_TASK", 100)
    monkeypatch.setattr(X, "CUSTOMERS_TASK", 5)
    large = X.build_cust_features(spark, SF).persist()
    assert _tasks(large) > cores
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()
    small.unpersist()
    large.unpersist()


def test_folds_follow_their_rows(spark, many_partitions, monkeypatch):
    seen = []

    def stop(train, *rest):
        seen.append(_tasks(train))
        raise InterruptedError

    monkeypatch.setattr(experiment, "_train", stop)
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 5 == 0).cast("int").alias("label"), F.col("id").cast("double").alias("x"))
    for run in (experiment.cv_cost, lambda d, c: experiment.evaluate_holdout(d, d, c)):
        with pytest.raises(InterruptedError):
            run(df, ["x"])
    assert len(seen) == 2 and max(seen) <= spark.sparkContext.defaultParallelism


def test_cut_shares_are_one_literal(spark, monkeypatch):
    given = []
    plain = F.percentile_approx
    monkeypatch.setattr(prefix.F, "percentile_approx", lambda c, q, n: (given.append(q), plain(c, q, n))[1])
    rows = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    cuts = prefix.fitted_cuts(rows, ["k"], [F.col("v")], 100)[0].first()["_cuts"]
    assert not isinstance(given[0], list) and 9 <= len(cuts) <= 11 and cuts == sorted(cuts)


def test_runs_of_a_grid_share_their_folds(spark, monkeypatch):
    fitted, plain, registry = [], experiment.fit_prep, models.model_registry(42, 3, 2)
    monkeypatch.setattr(experiment, "fit_prep", lambda df, *a, **k: (fitted.append(df), plain(df, *a, **k))[1])
    df = spark.range(400).select(
        F.col("id").alias("row_id"), (F.col("id") % 5 == 0).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") % 9 > 0, F.col("id") % 5).cast("double").alias("y"),
    )
    chosen = {"None": None, "Kruskal": "kruskal"}
    runs = experiment.experiment_grid({"A": (df, ["x", "y"])}, ["tree", "absent"], chosen, folds=2, registry=registry, n_features=1).collect()
    assert len(fitted) == 2  # one for each fold, not one for each run and fold
    assert all("Range" not in t._jdf.queryExecution().analyzed().toString() for t in fitted)  # a fold's plan reads kept rows
    assert [(r["model"], r["selector"], r["status"]) for r in runs] == [(m, c, s) for m, s in (("tree", "ok"), ("absent", "failed")) for c in chosen]
    for r in runs[:2]:
        alone = experiment.fold_summary(experiment.cv_cost(df, ["x", "y"], "tree", 2, selector=chosen[r["selector"]], registry=registry, n_features=1)).first()
        assert (r["cost_mean"], r["auc_mean"], r["f1_mean"]) == (alone["cost_mean"], alone["auc_mean"], alone["f1_mean"])
    steps = experiment._Shared()
    first, second = experiment._Shared(), experiment._Shared()
    assert [steps.once("a", lambda: time.sleep(0.2), r) for r in (first, second)] == [None, None]
    assert first.saved == 0 and second.saved > 0.15


def test_best_runs_share_their_training_rows(spark, monkeypatch):
    dealt, plain = [], experiment._dealt
    monkeypatch.setattr(experiment, "_dealt", lambda df, *a: (dealt.append(df), plain(df, *a))[1])
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 5 == 0).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("x"))
    best = spark.createDataFrame([(m, "A", "None", "No Sampling", "Tuned Threshold", m, float(i), None, "ok") for i, m in enumerate(("tree", "logistic"))],
                                 "model string, feature_set string, selector string, sampler string, tuning string, run_name string, cost_mean double, sampling_percentage double, status string")
    out = experiment.leaderboard_on_test(best, {"A": (df.where("row_id % 3 > 0"), df.where("row_id % 3 = 0"), ["x"])}, registry=models.model_registry(42, 3, 2))
    assert [(r["run_name"], r["status"]) for r in out.collect()] == [("tree", "ok"), ("logistic", "ok")]
    assert len(dealt) == 4  # test rows, training rows and their two parts, whatever the number of runs


def test_few_rows_fit_no_cuts(spark, monkeypatch):
    asked, plain = [], prefix.fitted_cuts
    monkeypatch.setattr(prefix, "fitted_cuts", lambda *a: (asked.append(a), plain(*a))[1])
    df = spark.range(300).select(
        F.col("id").alias("row_id"), (F.col("id") % 5 == 0).cast("int").alias("label"), (F.col("id") * 37 % 101).cast("double").alias("x"),
        F.when(F.col("id") % 9 > 0, F.col("id") * 13 % 89).cast("double").alias("y"))
    chosen, registry, cols = {"Kruskal": "kruskal"}, models.model_registry(42, 3, 2), ["x", "y"]

    def run():
        grid = experiment.experiment_grid({"A": (df, cols)}, ["tree"], chosen, folds=2, registry=registry, n_features=1)
        best = experiment.leaderboard_on_test(grid, {"A": (df.where("row_id % 3 > 0"), df.where("row_id % 3 = 0"), cols)}, chosen, registry=registry, n_features=1)
        return [r for d in (grid.drop("fit_time_mean"), best) for r in d.collect()]

    few = run()
    assert not asked and [r["status"] for r in few] == ["ok", "ok"]
    monkeypatch.setattr(prefix, "SLICE_ROWS", 20)  # the same rows, now too many for a slice
    assert run() == few and asked


def test_weights_of_a_fit_take_one_job(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "label int")
    for scheme in ("balanced", "positive"):
        table = {r["label"]: r["weight"] for r in sampling.class_weights(df, scheme=scheme).collect()}
        assert sampling.fitted_weights(df, scheme=scheme) == table


def test_rankings_of_an_explanation_are_made_once(spark):
    df = spark.range(400).select(
        F.col("id").alias("row_id"), (F.col("id") % 5 == 0).cast("int").alias("label"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    run = rca.explain_run(df, ["x", "y"], registry=models.model_registry(42, 2, 2), repeats=2)
    for part in ("shap_global", "importance", "ranks"):  # they read kept rows, rather than evaluate trees again
        assert "MapInPandas" not in run[part]._jdf.queryExecution().analyzed().toString()
    ranks = {r["feature"]: r for r in run["ranks"].collect()}
    assert {r["feature"]: r["mean_abs_shap"] for r in run["shap_global"].collect()} == {f: r["mean_abs_shap"] for f, r in ranks.items()}
    assert {r["feature"]: r["pi_mean"] for r in run["importance"].collect()} == {f: r["pi_mean"] for f, r in ranks.items()} and len(ranks) == 2
