import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.functions import hist as H
from faultline.operators import histograms, mice, missing, profile, scaling
from faultline.plans import prep
from faultline.sources import csv as csv_source
from faultline.sources import fixtures, results


def toy(spark, rows, name="ag"):
    cols = [f"{name}_{i:03d}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "row_id long, " + ", ".join(f"{c} double" for c in cols))
    return df, {name: cols}


def test_toy_histogram(spark):
    df, fam = toy(spark, [(10, 1, 0), (0, 1, 10)])
    a, b = histograms.engineer_histograms(df, fam, mileage=None).orderBy("row_id").collect()
    assert a["ag_sum"] == 11 and a["ag_center_mass"] == pytest.approx(1 / 11, abs=1e-6)
    assert a["ag_skew"] == pytest.approx(-b["ag_skew"], rel=1e-6) and a["ag_skew"] > 0
    p = np.array([10, 1]) / 11
    assert a["ag_entropy"] == pytest.approx(-(p * np.log(p)).sum() / math.log(3), abs=1e-6)
    assert a["ag_peaks"] == b["ag_peaks"] == 1
    assert a["ag_LLI"] == pytest.approx((10 * 4 + 1) / 11, abs=1e-6)


def test_empty_row_is_zero_except_bimodality(spark):
    df, fam = toy(spark, [(0, 0, 0)])
    r = histograms.engineer_histograms(df, fam, mileage=None).first().asDict()
    assert r.pop("ag_bimodality") == pytest.approx(1 / 3)
    r.pop("row_id")
    assert all(v == 0 for v in r.values())


def test_single_spike_depends_on_normalisation(spark):
    df, fam = toy(spark, [(0, 0, 0, 0, 0, 5)], "ay")
    smooth = histograms.engineer_histograms(df, fam, mileage=None).first()
    exact = histograms.engineer_histograms(df, fam, mileage=None, normalise="exact").first()
    assert smooth["ay_kurt"] == pytest.approx(-3, abs=1e-3) and smooth["ay_bimodality"] == 1
    assert exact["ay_kurt"] == 0 and exact["ay_bimodality"] == pytest.approx(1 / 3)


def test_array_column_gives_the_same_features(spark):
    df, fam = toy(spark, [(4, 0, 3, 9), (1, 2, 3, 4)])
    arr = df.select("*", F.array(*fam["ag"]).alias("h"))
    row = arr.select(H.hist_sum(H.bins_of("h", 4)).alias("a"), H.hist_sum(fam["ag"]).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in row)


def test_wasserstein_toy(spark):
    df, fam = toy(spark, [(10, 0), (0, 10)])
    got = [r["ag_wasserstein"] for r in histograms.wasserstein_to_ref(df, fam, {"ag": [0.5, 0.5]}).collect()]
    assert got == pytest.approx([0.5, 0.5])


def test_healthy_reference_uniform_when_empty(spark):
    df, fam = toy(spark, [(0, 0, 0, 0)])
    ref = histograms.reference_map(histograms.healthy_reference(df.withColumn("label", F.lit(0)), fam))
    assert ref["ag"] == [0.25] * 4


def test_redundant_sums_are_dropped_or_renamed(spark):
    rows = [(i, float(i), float(i), float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id long, aa_000 double, ag_sum double, ba_sum double")
    assert histograms.remove_uptime_redundancy(df).columns == ["row_id", "aa_000"]
    other = df.withColumn("ag_sum", F.pmod(F.col("row_id") * 17, F.lit(50)).cast("double"))
    assert histograms.remove_uptime_redundancy(other).columns == ["row_id", "aa_000", "Total_Operational_Events"]


def test_roles():
    roles = profile.split_column_roles(["ag_001", "ag_000", "aa_000", "ag_000_is_missing", "na_low"])
    assert roles["families"] == {"ag": ["ag_000", "ag_001"]}
    assert roles["numeric"] == ["aa_000", "na_low"] and roles["flags"] == ["ag_000_is_missing"]


def test_project_selected_rejects_absent(spark):
    df, _ = toy(spark, [(1, 2)])
    with pytest.raises(ValueError):
        profile.project_selected(df, ["nope"])


def co_missing(spark, n=200):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(n, 10)), columns=[f"col_{i}" for i in range(10)])
    pdf.loc[rng.random(n) < 0.2, ["col_0", "col_1", "col_2"]] = np.nan
    pdf.loc[rng.random(n) < 0.3, ["col_3", "col_4"]] = np.nan
    for i in range(5, 9):
        pdf.loc[rng.random(n) < 0.1, f"col_{i}"] = np.nan
    pdf.insert(0, "row_id", np.arange(n))
    return profile.clean_numbers(spark.createDataFrame(pdf), list(pdf.columns[1:])), list(pdf.columns[1:])


def test_planted_groups_share_a_module(spark):
    df, cols = co_missing(spark)
    fitted = prep.fit_prep(df, cols, modules=True, module_cut=0.15, mice_rounds=3)
    assert sorted(fitted.modules.values()) == [["col_0", "col_1", "col_2"], ["col_3", "col_4"], ["col_5"], ["col_6"], ["col_7"], ["col_8"]]
    out = fitted.transform(df)
    assert out.columns == ["row_id", *fitted.output_columns()]
    assert out.dropna().count() == out.count()
    again = fitted.transform(df.limit(20))
    assert again.columns == out.columns


def numpy_mice(x, rounds, alpha=10.0):
    gap = np.isnan(x)
    x = np.where(gap, np.nanmean(x, axis=0), x)
    order = [i for i in np.argsort(gap.sum(axis=0), kind="stable") if gap[:, i].any()]
    for _ in range(rounds):
        for t in order:
            rest = [i for i in range(x.shape[1]) if i != t]
            seen = ~gap[:, t]
            z = x[seen][:, rest]
            mu, sd = z.mean(axis=0), z.std(axis=0)
            z = (z - mu) / sd
            y = x[seen, t]
            beta = np.linalg.solve(z.T @ z + alpha * np.eye(len(rest)), z.T @ (y - y.mean()))
            pred = y.mean() + ((x[:, rest] - mu) / sd) @ beta
            x[gap[:, t], t] = np.maximum(0, pred[gap[:, t]])
    return x


def test_mice_equals_direct_computation(spark):
    rng = np.random.default_rng(3)
    base = rng.gamma(2, 1, size=(300, 3))
    base[:, 2] += 2 * base[:, 0]
    x = base.copy()
    x[rng.random(300) < 0.2, 0] = np.nan
    x[rng.random(300) < 0.35, 2] = np.nan
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf.insert(0, "row_id", np.arange(300))
    df = profile.clean_numbers(spark.createDataFrame(pdf), list("abc"))
    model, done = mice.mice_fit(df, list("abc"), max_rounds=3, tol=0.0)
    want = numpy_mice(x.copy(), 3)
    got = done.orderBy("row_id").toPandas()[list("abc")].to_numpy()
    assert np.allclose(got, want)
    replay = model.transform(df).orderBy("row_id").toPandas()[list("abc")].to_numpy()
    assert np.allclose(replay, want)


def test_quantile_codes_drop_duplicate_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 8 + [1, 2, 3, 4]], "x double")
    assert scaling.fit_quantile_edges(df, ["x"])["x"] == [pytest.approx(1 / 3)]
    codes = {r["x"] for r in scaling.quantile_discretise(df, ["x"]).collect()}
    assert codes == {0, 1}


def test_few_values_keep_their_code(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "x double")
    assert [r["x"] for r in scaling.quantile_discretise(df, ["x"]).collect()] == [0, 1, 2, 0]


def test_ingest_maps_labels_and_missing(spark, tmp_path):
    f = tmp_path / "in.csv"
    f.write_text("class,x,y\nneg,1.5,na\npos,,2\nodd,NaN,3\n")
    df = csv_source.ingest_labelled_csv(spark, str(f), "class string, x double, y double" and _schema("class string, x double, y double"))
    rows = [tuple(r) for r in df.collect()]
    assert rows == [(0, 1.5, None), (1, None, 2.0), (None, None, 3.0)]
    with pytest.raises(ValueError):
        csv_source.ingest_labelled_csv(spark, str(f), _schema("x double"))


def _schema(ddl):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def test_consolidate_ragged_nodes(spark, tmp_path):
    a = spark.createDataFrame([("f1", "Mediator")], "Feature string, Role string")
    b = spark.createDataFrame([("f2", "Physical Root", "0.5")], "Feature string, Role string, PyMC_Mean string")
    results.write_experiment_csv(a, str(tmp_path), "nodes", "EXP_FFF", 8)
    results.write_experiment_csv(b, str(tmp_path), "nodes", "EXP_TTT", 8)
    rows = {r["Feature"]: r for r in results.consolidate_runs(spark, str(tmp_path), "nodes").collect()}
    assert rows["f1"]["Experiment"] == "EXP_FFF" and rows["f1"]["PyMC_Mean"] is None
    assert rows["f2"]["Experiment"] == "EXP_TTT" and rows["f2"]["PyMC_Mean"] == "0.5"
