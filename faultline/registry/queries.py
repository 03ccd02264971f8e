"""One query per operator: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import hist as hf
from faultline.operators import (
    balancing, correlation, cost, describe, discovery, explain, graphs, histograms, independence, logit, marginals, mice,
    missing, models, outliers, pairs, pca, profile, ranktests, sampling, scaling, selection,
)
from faultline.session import configure, spread
from faultline.plans import causal, experiment, rca
from faultline.sources import csv as csv_source
from faultline.sources import fixtures as X
from faultline.sources import results

Query = Callable[[SparkSession, str], DataFrame]

CORE = ["aa_000", *X.AG]
NUMERIC = ["aa_000", *X.AG, *X.AY, *X.CN, *X.BA]
WITH_GAPS = ["aa_000", *X.AG, *X.GAPPY]
SEED = 42
THRESHOLD = 0.3
GAPS = ["aa_000", "ba_000", "na_mid", "na_low"]


def r6(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in cols})


def quick(depth: int = 3, iterations: int = 5):
    return models.model_registry(SEED, iterations, depth)


# --- sources and sinks -------------------------------------------------------------


def q_ingest_labelled_csv(spark, sf):
    cust = X.cust_features(spark, sf)
    path = results.scratch_path(spark, "labelled")
    cls = F.when(F.col("label") == 1, "pos").otherwise("neg")
    cols = [f.name for f in X.LABELLED_SCHEMA if f.name != "class"]
    cust.select(cls.alias("class"), *cols).write.option("header", True).option("nullValue", "na").csv(path)
    return csv_source.ingest_labelled_csv(spark, path, X.LABELLED_SCHEMA)


def q_label_audit(spark, sf):
    return csv_source.label_audit(X.doc_scores(spark, sf))


def q_write_results(spark, sf):
    path = results.scratch_path(spark, "ranked")
    ks = ranktests.ks_two_sample(X.item_features(spark, sf), X.ITEM, alpha=1.0)
    for run in ("run_a", "run_b"):
        results.write_results(ks, path, run)
    return rounded(spark.read.parquet(path).select("run_name", "feature", "stat"), "stat")


def q_consolidate_runs(spark, sf):
    base = results.scratch_path(spark, "runs")
    raw = X.edge_table(spark, sf)
    kept = graphs.edge_cleanup(raw)
    out = lambda df: df.select(F.lit("LiNGAM").alias("Algo"), F.col("src").alias("Source"), F.col("dst").alias("Target"), "run_id")
    results.write_experiment_csv(out(raw), base, "edges", "EXP_FFF", 8)
    results.write_experiment_csv(out(kept), base, "edges", "EXP_TTT", 8)
    hybrid = graphs.hybrid_graph(kept, X.edge_table(spark, sf, "PC").select("run_id", "src", "dst"))
    named = hybrid.select(F.lit("Hybrid").alias("Algo"), F.col("src").alias("Source"), F.col("dst").alias("Target"),
                          F.col("type").alias("Type"), "run_id")
    results.write_experiment_csv(named, base, "hybrid", "EXP_TTT", 8)
    return results.consolidate_runs(spark, base, "edges").withColumn("run_id", F.col("run_id").cast("long"))


def q_write_reports(spark, sf):
    path = results.scratch_path(spark, "report")
    m = cost.metrics_at(X.doc_scores(spark, sf), THRESHOLD).first().asDict()
    results.write_reports(m, spark, path)
    return rounded(spark.read.json(path).select("metric", "value"), "value")


# --- profiles and filters ----------------------------------------------------------


def q_profile_columns(spark, sf):
    return rounded(profile.profile_columns(X.cust_features(spark, sf), WITH_GAPS), "na_share")


def q_drop_sparse_constant(spark, sf):
    df = X.cust_features(spark, sf).withColumn("flat", F.lit(1.0))
    return profile.drop_sparse_constant(df.select("row_id", *WITH_GAPS, "flat"), [*WITH_GAPS, "flat"])


def q_na_strategy(spark, sf):
    return rounded(profile.na_strategy(X.cust_features(spark, sf), WITH_GAPS), "na_share")


def q_drop_incomplete_rows(spark, sf):
    return profile.drop_incomplete_rows(X.cust_features(spark, sf).select("row_id", *X.GAPPY), X.GAPPY)


def q_split_column_roles(spark, sf):
    flagged = missing.missing_flags(X.cust_features(spark, sf), X.GAPPY)
    return profile.role_table(flagged, [c for c in flagged.columns if c not in ("row_id", "label")])


def q_project_selected(spark, sf):
    return profile.project_selected(X.cust_features(spark, sf), ["ag_001", "aa_000"])


def q_complete_filter_inf(spark, sf):
    df = X.cust_features(spark, sf)
    ratio = F.when(F.col("ag_000") == 0, F.lit(float("inf"))).when(F.col("ag_001") == 0, F.lit(float("nan"))).otherwise(
        F.col("ag_002") / F.col("ag_000")
    )
    return rounded(profile.complete_filter_inf(df.withColumn("ratio", ratio), ["ratio", "na_mid"], ["row_id"]), "value")


def q_subset_by_class(spark, sf):
    return profile.subset_by_class(X.cust_features(spark, sf), 1).select("row_id", "label", "aa_000")


def _feature_groups(spark, sf):
    """Per nation: the graph's nodes with a group from how often they are a source."""
    e = X.edge_table(spark, sf)
    n_out = e.groupBy("run_id", F.col("src").alias("feature")).agg(F.count("*").alias("n"))
    group = F.when(F.col("n") >= 3, "Global").when(F.col("n") == 2, "Secondary").otherwise("Diagnostic")
    w = Window.partitionBy("run_id").orderBy("feature")
    return n_out.select("run_id", F.row_number().over(w).alias("position"), "feature", group.alias("feature_group"))


def q_filter_redundant_globals(spark, sf):
    return profile.filter_redundant_globals(_feature_groups(spark, sf))


def q_high_risk_rows(spark, sf):
    return rounded(profile.high_risk_rows(X.doc_scores(spark, sf).select("row_id", "prob"), 0.5, 20), "prob")


# --- missing values ----------------------------------------------------------------


def q_missing_flags(spark, sf):
    df = missing.missing_flags(X.cust_features(spark, sf), X.GAPPY)
    return df.select("row_id", *[c + missing.FLAG for c in X.GAPPY])


def q_median_impute(spark, sf):
    return missing.median_impute(X.cust_features(spark, sf), ["na_low"]).select("row_id", r6("na_low").alias("na_low"))


def q_mice_impute(spark, sf):
    cols = ["na_mid", "na_high"]
    _, done = mice.mice_fit(X.cust_features(spark, sf).select("row_id", *cols), cols)
    return rounded(done, *cols)


def q_mice_first_step(spark, sf):
    df = X.cust_features(spark, sf).select("na_mid", "na_high")
    mean = df.agg(F.avg("na_high")).first()[0]
    filled = df.withColumn("na_high", F.coalesce("na_high", F.lit(mean))).where(F.col("na_mid").isNotNull())
    intercept, coefs = mice.ridge_step(filled, "na_mid", ["na_high"], 10.0)
    n = filled.agg(F.count("*").alias("n"))
    return n.select("n", r6(F.lit(intercept), 8).alias("intercept"), r6(F.lit(coefs["na_high"]), 8).alias("slope"))


def q_fallback_impute(spark, sf):
    df = X.cust_features(spark, sf)
    return rounded(missing.median_impute(df, X.GAPPY).select("row_id", *X.GAPPY), *X.GAPPY)


def q_missingness_correlation(spark, sf):
    return rounded(missing.missingness_correlation(X.cust_features(spark, sf), X.GAPPY), "r", "distance")


def q_missingness_modules(spark, sf):
    df = X.cust_features(spark, sf)
    return missing.module_table(df, missing.missingness_modules(df, X.GAPPY, 0.5))


MODULES = {1: ["na_drop", "na_high"], 2: ["na_low", "na_mid"]}


def q_module_connectivity(spark, sf):
    df = missing.module_connectivity(X.cust_features(spark, sf), MODULES)
    return df.select("row_id", *[f"Module_{i}_Connectivity" for i in MODULES])


def q_hardware_fingerprint(spark, sf):
    """Nodes (features) by run (module) of the edge table."""
    e = X.edge_table(spark, sf).select(F.col("src").alias("feature"), F.concat(F.lit("m"), "run_id").alias("module"))
    return missing.hardware_fingerprint(e.distinct())


def q_hardware_fingerprint_fitted(spark, sf):
    df = X.cust_features(spark, sf)
    table = missing.module_table(df, missing.missingness_modules(df, X.GAPPY, 0.999))
    return missing.hardware_fingerprint(table.select("feature", F.concat(F.lit("Module "), "module").alias("module")))


def q_median_fill_for_test(spark, sf):
    return q_fallback_impute(spark, sf)


def q_zero_fill(spark, sf):
    return missing.zero_fill(X.cust_features(spark, sf), X.GAPPY).select("row_id", *X.GAPPY)


# --- histograms --------------------------------------------------------------------


def _engineered(spark, sf) -> DataFrame:
    return histograms.engineer_histograms(X.cust_features(spark, sf), X.FAMILIES)


def _hist(suffixes: list[str]) -> Query:
    def run(spark, sf):
        df = _engineered(spark, sf)
        cols = [c for c in df.columns if c.endswith(tuple(suffixes))]
        return df.select("row_id", *[r6(c).alias(c) for c in cols])

    return run


def q_hist_pmf(spark, sf):
    df = X.cust_features(spark, sf)
    return df.select("row_id", *[r6(e).alias(f"p_{i}") for i, e in enumerate(hf.hist_pmf(X.AG))])


def q_engineer_histograms(spark, sf):
    df = histograms.engineer_histograms(X.user_hist(spark, sf), {"hr": X.HOURS, "val": X.VALUES}, mileage=None)
    return rounded(df, *[c for c in df.columns if c not in ("row_id", "label")])


def q_collapse_histograms(spark, sf):
    df = histograms.collapse_histograms(X.cust_features(spark, sf).select("row_id", *X.AG, *X.BA), {"ag": X.AG, "ba": X.BA})
    return rounded(df, *[c for c in df.columns if c != "row_id"])


def q_healthy_reference(spark, sf):
    ref = histograms.healthy_reference(X.cust_features(spark, sf), X.FAMILIES)
    return rounded(ref.withColumn("bin", F.col("bin").cast("int")), "share")


def q_healthy_reference_mean(spark, sf):
    ref = histograms.healthy_reference(X.cust_features(spark, sf), X.FAMILIES, method="mean")
    return rounded(ref.withColumn("bin", F.col("bin").cast("int")), "share")


def q_wasserstein_to_ref(spark, sf):
    df = X.cust_features(spark, sf)
    refs = histograms.reference_map(histograms.healthy_reference(df, X.FAMILIES))
    out = histograms.wasserstein_to_ref(df, X.FAMILIES, refs)
    return rounded(out, *[c for c in out.columns if c != "row_id"])


def q_replace_bins(spark, sf):
    df = X.cust_features(spark, sf)
    refs = histograms.reference_map(histograms.healthy_reference(df, X.FAMILIES))
    out = histograms.replace_bins(missing.missing_flags(df, X.GAPPY), refs)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


def q_remove_uptime_redundancy(spark, sf):
    df = _engineered(spark, sf).join(X.cust_features(spark, sf).select("row_id", "aa_000"), "row_id")
    out = histograms.remove_uptime_redundancy(df.select("row_id", "aa_000", *[f"{f}_sum" for f in X.FAMILIES]))
    return out


def q_family_sums(spark, sf):
    return histograms.family_sums(X.cust_features(spark, sf), X.FAMILIES)


def q_log1p_if_skewed(spark, sf):
    o = X.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "value", F.col("user_id").cast("double").alias("user_id"))
    return rounded(histograms.log1p_if_skewed(o, ["value", "user_id"]), "value", "user_id")


def q_log1p_sums_vars(spark, sf):
    df = histograms.collapse_histograms(X.cust_features(spark, sf).select("row_id", *X.AG), {"ag": X.AG})
    return rounded(histograms.log1p_sums_vars(df), "ag_sum", "ag_mean", "ag_var")


# --- statistics --------------------------------------------------------------------


def q_ks_two_sample(spark, sf):
    return rounded(ranktests.ks_two_sample(X.item_features(spark, sf), X.ITEM, alpha=1.0), "stat", "p_value")


def q_ks_top_features(spark, sf):
    df = histograms.engineer_histograms(X.cust_features(spark, sf), {"ag": X.AG})
    cols = [c for c in df.columns if c.startswith("ag_")]
    return rounded(ranktests.ks_two_sample(df, cols, alpha=1.0, top_n=10), "stat", "p_value")


def q_ks_pvalues(spark, sf):
    return rounded(ranktests.ks_pvalues(X.cust_features(spark, sf), WITH_GAPS), "p_value")


def q_ks_drift(spark, sf):
    train, test = sampling.split_frames(X.cust_features(spark, sf))
    return rounded(ranktests.ks_drift(train, test, CORE, alpha=1.0), "stat", "p_value")


def q_kruskal_wallis(spark, sf):
    out = ranktests.kruskal_wallis(X.cust_features(spark, sf).withColumn("flat", F.lit(1.0)), [*WITH_GAPS, "flat"])
    return rounded(out.select("feature", "stat"), "stat")


def q_mutual_info_rank(spark, sf):
    return rounded(ranktests.mutual_info_rank(X.item_features(spark, sf), X.ITEM), "mi")


def q_mutual_info_binned(spark, sf):
    return rounded(ranktests.mutual_info_binned(X.item_features(spark, sf), X.ITEM), "mi")


def q_ks_pvalues_ties(spark, sf):
    """Chances given the ties, exact up to the size for it."""
    return rounded(ranktests.ks_statistics(X.cust_features(spark, sf), [*CORE, *X.BA], ties=True), "stat", "p_value")


def q_spearman_pair(spark, sf):
    return rounded(correlation.spearman_pair(X.cust_features(spark, sf), "na_mid", "aa_000"), "rho")


def q_spearman_matrix(spark, sf):
    return rounded(correlation.spearman_matrix(X.cust_features(spark, sf), ["aa_000", *X.BA]), "rho")


def q_pearson_matrix(spark, sf):
    return rounded(pairs.pearson_matrix(X.item_features(spark, sf), X.ITEM), "r")


def q_high_corr_pairs(spark, sf):
    return rounded(pairs.high_corr_pairs(X.cust_features(spark, sf), NUMERIC, 0.5), "r")


def q_corr_with_reference(spark, sf):
    return rounded(correlation.corr_with_reference(X.cust_features(spark, sf), NUMERIC, "aa_000"), "abs_rho")


def q_describe_by_class(spark, sf):
    df = describe.describe_by_class(X.item_features(spark, sf), X.ITEM)
    return rounded(df, "mean", "std", "min", "max", "q25", "q50", "q75")


def q_killer_bins(spark, sf):
    return rounded(ranktests.killer_bins(X.cust_features(spark, sf), X.FAMILIES), "rho")


def q_gaussianity_check(spark, sf):
    return rounded(describe.gaussianity_check(X.item_features(spark, sf), X.ITEM), "skew", "kurt")


def q_entropy_delta(spark, sf):
    df = _engineered(spark, sf)
    return rounded(describe.entropy_delta(df, [c for c in df.columns if c.endswith("_entropy")]), "healthy", "failing", "ratio")


def q_peak_mode_by_class(spark, sf):
    return describe.peak_mode_by_class(_engineered(spark, sf), "ag_peaks")


def q_peak_regimes(spark, sf):
    df = _engineered(spark, sf)
    return rounded(describe.peak_regimes(df, [c for c in df.columns if c.endswith("_peaks")]), "pct")


def q_mileage_skew_corr(spark, sf):
    df = histograms.engineer_histograms(X.cust_features(spark, sf), {"ag": X.AG}, keep=("row_id", "aa_000"))
    return rounded(describe.mileage_skew_corr(df, "aa_000", "ag_skew"), "r")


def _with_mileage(spark, sf):
    return histograms.engineer_histograms(X.cust_features(spark, sf), X.FAMILIES, keep=("row_id", "label", "aa_000"))


def q_fan_points(spark, sf):
    return rounded(describe.fan_points(_with_mileage(spark, sf), "aa_000", "ay_DCI"), "x", "y")


def q_zone_means(spark, sf):
    return rounded(describe.zone_means(_with_mileage(spark, sf), "aa_000", "ay_DCI"), "mean_y", "slope", "intercept", digits=8)


def q_density_by_class(spark, sf):
    df = X.item_features(spark, sf)
    return rounded(describe.density_by_class(df, ["l_extendedprice", "l_quantity"]), "x", "density", "cdf")


def q_histogram_by_class(spark, sf):
    df = X.item_features(spark, sf)
    return rounded(describe.histogram_by_class(df, ["l_extendedprice", "l_quantity"], 20), "density", "cdf", digits=9)


def q_melt_by_class(spark, sf):
    df = _engineered(spark, sf)
    cols = [c for c in df.columns if c.endswith(("_skew", "_kurt"))]
    return rounded(describe.melt_by_class(df, cols), "min", "q25", "q50", "q75", "max")


def q_feature_group_correlation(spark, sf):
    df = correlation.feature_group_correlation(X.cust_features(spark, sf), ["aa_000", *X.BA, "ag_000"], X.FAMILIES)
    return rounded(df, "avg_corr")


def q_feature_group_usage(spark, sf):
    df = correlation.feature_group_usage(X.cust_features(spark, sf), ["aa_000", *X.BA, "ag_000"], X.FAMILIES)
    return rounded(df, "avg_corr")


def _scaled_emb(spark, sf):
    return scaling.standard_scale(X.emb_features(spark, sf), X.EMB)


def q_pca_explained(spark, sf):
    return rounded(pca.pca_explained(pca.pca_fit(_scaled_emb(spark, sf), X.EMB, 5), spark), "share", "cumulative")


def q_pca_fit(spark, sf):
    df = _scaled_emb(spark, sf)
    return pca.pca_transform(pca.pca_fit(df, X.EMB, 3), df, X.EMB, ["row_id", "label"])


def q_pca_loadings(spark, sf):
    model = pca.pca_fit(_scaled_emb(spark, sf), X.EMB, 2)
    return rounded(pca.pca_loadings(model, X.EMB, spark, 1, 10), "loading")


def q_pca_extreme_row(spark, sf):
    df = _scaled_emb(spark, sf)
    return rounded(pca.pca_extreme_row(pca.pca_fit(df, X.EMB, 2), df, X.EMB), "z", "pc1")


# --- scaling, discretising, sampling -------------------------------------------------


SCALED = ["aa_000", "ag_000", "na_mid"]


def _scaled(fn) -> Query:
    return lambda spark, sf: rounded(fn(X.cust_features(spark, sf), SCALED).select("row_id", *SCALED), *SCALED)


DISC = ["aa_000", "ag_000", "ba_000", "na_mid"]


def q_quantile_discretise(spark, sf):
    return scaling.quantile_discretise(X.cust_features(spark, sf).select("row_id", *DISC), DISC)


def q_equal_width_discretise(spark, sf):
    return scaling.equal_width_discretise(X.cust_features(spark, sf).select("row_id", *DISC), DISC)


def q_undersample_majority(spark, sf):
    return sampling.undersample_majority(X.cust_features(spark, sf), 1.5).select("row_id", "label")


def q_stratified_split(spark, sf):
    return sampling.stratified_split(X.cust_features(spark, sf).select("row_id", "label"))


def q_stratified_kfold(spark, sf):
    return sampling.stratified_kfold(X.cust_features(spark, sf).select("row_id", "label"), 5)


def q_row_subsample(spark, sf):
    return sampling.row_subsample(X.doc_scores(spark, sf).select("row_id", "n_chars"), 500)


def q_smote(spark, sf):
    return rounded(balancing.smote(X.cust_features(spark, sf), CORE, 0.25), *CORE)


def q_smote_enn(spark, sf):
    return rounded(balancing.smote_enn(X.cust_features(spark, sf), CORE, 0.25), *CORE)


def q_smote_tomek(spark, sf):
    return rounded(balancing.smote_tomek(X.cust_features(spark, sf), CORE, 0.25), *CORE)


def q_copula_balance(spark, sf):
    return balancing.copula_balance(X.cust_features(spark, sf), CORE, 0.25)


def _copula_frame(spark, sf):
    """Counters, a flag of two values and a column of fractions; the ratio adds rows at every size."""
    df = X.cust_features(spark, sf)
    return df.select("row_id", "label", *CORE, F.col("na_high").isNull().cast("double").alias("na_high_is_missing"), (F.col("aa_000") / 1e6).alias("millions"))


def q_copula_domains(spark, sf):
    """Rows of each kind and class, and how many of their values leave the domains of the columns."""
    df = _copula_frame(spark, sf)
    cols = df.columns[2:]
    counters = [c for c in cols if c[-1].isdigit()]
    odd = lambda names, bad: F.sum(sum((bad(F.col(c)).cast("long") for c in names), F.lit(0)))
    return balancing.copula_balance(df, cols, 0.9).groupBy((F.col("row_id") < 0).cast("int").alias("made"), "label").agg(
        F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"), odd(cols, lambda c: c < 0).alias("negative"),
        odd(counters, lambda c: (c != F.round(c)) & (F.col("row_id") < 0)).alias("fractions"), odd(["na_high_is_missing"], lambda c: ~c.isin(0.0, 1.0)).alias("no_flag"))


def q_marginal_parameters(spark, sf):
    """Shapes of every family for the minority's columns, from sums; the distance of the uniform one."""
    df = X.cust_features(spark, sf).where("label = 1")
    out = marginals.marginal_parameters(df, CORE).withColumn("distance", F.when(F.col("family") == "uniform", F.col("distance")))
    return rounded(out.drop("chosen"), "distance", "a", "b")


def q_marginal_fits(spark, sf):
    return rounded(marginals.marginal_parameters(X.cust_features(spark, sf).where("label = 1"), CORE), "distance", "a", "b")


def q_class_weights(spark, sf):
    return rounded(sampling.class_weights(X.cust_features(spark, sf)), "weight")


# --- outliers ----------------------------------------------------------------------


def _isolated(spark, sf):
    def build(s, d):
        return outliers.isolation_forest(X.cust_features(s, d), CORE, 0.02)

    return X.shared(spark, sf, "isolated", build)


def q_isolation_forest(spark, sf):
    return _isolated(spark, sf)


def _scored_docs(spark, sf):
    """Document length as the anomaly score: longest 2 % are outliers."""
    docs = X.doc_scores(spark, sf)
    flagged = outliers.flag_outliers(docs.select("row_id", F.col("n_chars").alias("score")), 0.02)
    return outliers.failure_rescue(flagged.join(docs.select("row_id", "label"), "row_id"))


def q_failure_rescue(spark, sf):
    return _scored_docs(spark, sf)


def q_outlier_audit(spark, sf):
    return rounded(outliers.outlier_audit(_scored_docs(spark, sf)), "base_rate", "drop_rate")


def q_rescue_groups(spark, sf):
    return outliers.rescue_groups(X.cust_features(spark, sf), _isolated(spark, sf), CORE)


# --- selection ---------------------------------------------------------------------


def q_rank_rfe_forest(spark, sf):
    return selection.rank_rfe_forest(X.cust_features(spark, sf), CORE, 8)


def q_rank_from_model(spark, sf):
    return selection.rank_from_model(X.cust_features(spark, sf), CORE)


def q_rank_gbt(spark, sf):
    return selection.rank_gbt(X.cust_features(spark, sf), CORE, 5)


def q_rank_lasso(spark, sf):
    return rounded(selection.rank_lasso(X.cust_features(spark, sf), CORE, 5, alpha=0.002), "stat")


def _rankings(spark, sf):
    df = X.cust_features(spark, sf)
    return {
        "ks": selection._ranked(ranktests.ks_two_sample(df, CORE, alpha=1.0)),
        "kruskal": ranktests.kruskal_wallis(df, CORE).select("feature", "rank"),
        "mi": selection._ranked(ranktests.mutual_info_rank(df, CORE), "mi"),
    }


def q_consensus_union(spark, sf):
    return selection.consensus_union(list(_rankings(spark, sf).values()), 4)


def q_select_union(spark, sf):
    """Union of KS, mutual information and forest importance, as a fold's selector takes it."""
    return selection.select_union(X.cust_features(spark, sf), CORE, 4)


def q_consensus_vote(spark, sf):
    return selection.consensus_vote(_rankings(spark, sf), 4, 2)


def q_selection_stability(spark, sf):
    e = X.edge_table(spark, sf).groupBy(F.col("run_id").alias("fold")).agg(F.collect_set("src").alias("features"))
    return rounded(selection.selection_stability(e), "pct")


# --- training and cost -------------------------------------------------------------


def q_model_registry(spark, sf):
    df = X.cust_features(spark, sf)
    parts = []
    registry = models.model_registry(SEED)
    for name in registry:
        scaled = scaling.standard_scale(df, CORE)
        scores = models.predict(models.fit_model(name, scaled, CORE, registry), scaled, CORE)
        parts.append(cost.auc(scores).withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def q_normalised_scores(spark, sf):
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), "c_acctbal")
    return rounded(cost.normalised_scores(c, "c_acctbal").select("row_id", "prob"), "prob")


def q_cost_curve(spark, sf):
    return rounded(cost.cost_curve(X.doc_scores(spark, sf), cost.tuning_grid(spark)), "threshold", digits=9)


def q_cost_curve_items(spark, sf):
    df = X.item_features(spark, sf)
    scores = df.select("label", ((F.col("l_extendedprice") % 1000) / 1000).alias("prob"))
    return rounded(cost.cost_curve(scores, cost.dense_grid(spark)), "threshold", digits=9)


def q_best_threshold_grid(spark, sf):
    return rounded(cost.best_threshold_grid(X.doc_scores(spark, sf)), "threshold", digits=9)


def q_best_threshold_dense(spark, sf):
    return rounded(cost.best_threshold_dense(X.doc_scores(spark, sf)), "threshold", digits=9)


def q_best_threshold_roc(spark, sf):
    return rounded(cost.best_threshold_roc(X.doc_scores(spark, sf)), "threshold", digits=9)


def q_confusion_at(spark, sf):
    return cost.confusion_at(X.doc_scores(spark, sf), THRESHOLD)


def q_metrics_at(spark, sf):
    m = cost.metrics_at(X.doc_scores(spark, sf), THRESHOLD)
    return rounded(m, "auc", "macro_f1", "recall", "precision", "cost", "threshold")


def q_roc_curve(spark, sf):
    return rounded(cost.roc_curve(X.doc_scores(spark, sf)), "threshold", "fpr", "tpr")


def q_cv_cost(spark, sf):
    cols = [*CORE, "na_low", "na_mid", "na_high"]
    return experiment.cv_cost(X.cust_features(spark, sf), cols, "logistic", modules=True, selector="kruskal", n_features=10)


def q_fold_summary(spark, sf):
    c = X.table(spark, sf, "customer")
    folds = c.groupBy(F.col("c_nationkey").alias("fold")).agg(
        (F.count_if(F.col("c_acctbal") > 0) / F.count("*")).alias("auc"),
        F.count_if(F.col("c_acctbal") < 0).cast("double").alias("cost"),
        (F.count_if(F.col("c_mktsegment") == "BUILDING") / F.count("*")).alias("f1"),
        (F.min(F.abs("c_acctbal")) / 100).alias("threshold"),
        F.count("*").cast("double").alias("fit_time"),
        F.lit(0.0).alias("pred_time"),
    )
    out = experiment.fold_summary(folds)
    return rounded(out, *out.columns)


def q_evaluate_holdout(spark, sf):
    train, test = sampling.split_frames(X.cust_features(spark, sf), 0.75, seed=7)
    return experiment.evaluate_holdout(train, test, CORE, "logistic")


_SELECTORS = {"None": None, "Kruskal": "kruskal"}
_COUNTERS = ["aa_000", *X.BA, *X.CN]


def q_experiment_grid(spark, sf):
    """Two models with and without a selector in four folds, imputed, selected and scaled in each."""
    df = X.cust_features(spark, sf)
    return experiment.experiment_grid({"Counters": (df, _COUNTERS)}, ["logistic", "tree"], selectors=_SELECTORS, n_features=6)


def q_leaderboard_on_test(spark, sf):
    """The three best runs of a grid on the training rows, fitted again and scored on the test rows."""
    df = X.cust_features(spark, sf)
    marked = X.shared(spark, sf, "cust_split", lambda s, d: spread(sampling.stratified_split(df), "row_id", X.CUSTOMERS_TASK, df.count()))
    train, test = marked.where("is_train = 1").drop("is_train"), marked.where("is_train = 0").drop("is_train")
    runs = experiment.experiment_grid({"Counters": (train, _COUNTERS)}, ["logistic", "tree"], selectors=_SELECTORS, folds=2, n_features=6)
    return experiment.leaderboard_on_test(runs, {"Counters": (train, test, _COUNTERS)}, selectors=_SELECTORS, top_n=3, n_features=6)


def _derived_runs(spark, sf):
    """A run table from the orders: priority as model, nation as feature set, price as cost."""
    o = X.table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    c = X.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("o_orderpriority").alias("model"), F.col("c_nationkey").cast("string").alias("feature_set")
    ).agg(
        F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*"), 4).alias("cost_mean"),
    ).withColumn("run_name", F.concat_ws(" | ", "model", "feature_set"))


def q_experiment_leaderboard(spark, sf):
    return experiment.experiment_leaderboard(_derived_runs(spark, sf), 80)


def q_best_per_feature_set(spark, sf):
    return experiment.best_per_feature_set(_derived_runs(spark, sf))


# --- explanation -------------------------------------------------------------------


def _reference(spark, sf):
    return rca.shared_reference(X.cust_features(spark, sf), CORE, None)


def q_reference_model(spark, sf):
    model, _, valid = _reference(spark, sf)
    return cost.auc(models.predict(model, valid, CORE))


def q_shap_values(spark, sf):
    model, _, valid = _reference(spark, sf)
    return explain.shap_values(model, valid, CORE)


def q_shap_global(spark, sf):
    return explain.shap_global(q_shap_values(spark, sf), CORE)


def q_shap_local(spark, sf):
    model, _, valid = _reference(spark, sf)
    return explain.shap_local(explain.shap_values(model, valid, CORE), valid, CORE, THRESHOLD)


def _given_phi(spark, sf):
    """Embeddings in the role of attributions: ``phi`` is the vector, ``margin`` its first entry."""
    df = X.emb_features(spark, sf)
    return df.select("row_id", "label", F.col("e_00").alias("margin"), F.array(*X.EMB).alias("phi"))


def q_shap_global_given_phi(spark, sf):
    return rounded(explain.shap_global(_given_phi(spark, sf), X.EMB), "mean_abs_shap")


def q_shap_local_given_phi(spark, sf):
    out = explain.shap_local(_given_phi(spark, sf), X.emb_features(spark, sf), X.EMB, 0.5, 7, 8)
    return rounded(out, "proba", "value", "shap")


def q_permutation_importance_cost(spark, sf):
    model, _, valid = _reference(spark, sf)
    return explain.permutation_importance_cost(model, valid, CORE, 0.45, repeats=10)


def q_compare_ranks(spark, sf):
    df = X.cust_features(spark, sf)
    a = ranktests.ks_two_sample(df, CORE, alpha=1.0).select("feature", r6("stat").alias("mean_abs_shap"))
    b = ranktests.mutual_info(df, CORE).select("feature", r6("mi").alias("pi_mean"))
    return explain.compare_ranks(a, b)


def q_rank_agreement(spark, sf):
    return rounded(explain.rank_agreement(q_compare_ranks(spark, sf)), "rho")


def q_pdp_ice(spark, sf):
    model, _, valid = _reference(spark, sf)
    return explain.pdp(explain.pdp_ice(model, valid, CORE))


def q_surrogate_tree(spark, sf):
    model, _, valid = _reference(spark, sf)
    _, fidelity = explain.surrogate_tree(model, valid, CORE, 0.45, depth=3)
    return valid.agg(F.count("*").alias("n")).withColumn("fidelity", F.lit(fidelity))


def q_surrogate_rules(spark, sf):
    model, _, valid = _reference(spark, sf)
    tree, _ = explain.surrogate_tree(model, valid, CORE, 0.45, depth=3)
    return explain.surrogate_rules(tree, CORE, valid)


def q_rca_steps(spark, sf):
    """Every part of the explanation run: its name and its rows as JSON."""
    run = rca.explain_run(X.cust_features(spark, sf), CORE)
    numbers = spark.createDataFrame([(float(run.pop("threshold")), float(run.pop("fidelity")))], "threshold double, fidelity double")
    parts = {"numbers": numbers, **run}
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in parts.items()])


# --- causal discovery --------------------------------------------------------------


def q_prior_matrix(spark, sf):
    return graphs.prior_matrix(_feature_groups(spark, sf).select("run_id", "feature", "feature_group"))


CAUSAL = ["aa_000", "ag_000", "ag_003", "ba_000", "na_mid"]
TESTS = [("aa_000", "ag_000", ()), ("ag_003", "class", ()), ("ag_003", "class", ("aa_000",)), ("ba_000", "ag_000", ("aa_000", "ag_003"))]


def _codes(spark, sf):
    df = X.cust_features(spark, sf).select(F.col("label").alias("class"), *CAUSAL)
    return scaling.quantile_discretise(df, CAUSAL)


def q_contingency(spark, sf):
    return independence.contingency(_codes(spark, sf), TESTS)


def _by_nation(spark, sf, df):
    nation = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").cast("long").alias("run_id"))
    return df.join(nation, "row_id").select("run_id", F.col("label").alias("class"), *CAUSAL)


def q_contingency_by_run(spark, sf):
    df = _by_nation(spark, sf, X.cust_features(spark, sf))
    return independence.contingency(scaling.quantile_discretise(df, CAUSAL), TESTS[:3], by="run_id")


def q_chisq_ci(spark, sf):
    out = independence.chisq_ci(_codes(spark, sf), TESTS)
    return rounded(out.select("test", "x", "y", "z", "stat", "dof"), "stat")


def q_pc_skeleton_orient(spark, sf):
    names = [*CAUSAL, "class"]
    return discovery.pc_skeleton_orient(_codes(spark, sf), names, discovery.forbidden_pairs(names))


def _continuous(spark, sf):
    df = missing.median_impute(X.cust_features(spark, sf), ["na_mid"])
    return scaling.standard_scale(df, CAUSAL).select(F.col("label").alias("class"), *CAUSAL)


def q_direct_lingam(spark, sf):
    names = [*CAUSAL, "class"]
    return discovery.direct_lingam(_continuous(spark, sf).persist(), names, discovery.forbidden_pairs(names))


def q_pc_by_run(spark, sf):
    """One search per nation, all at once."""
    names = [*CAUSAL, "class"]
    codes = scaling.quantile_discretise(_by_nation(spark, sf, X.cust_features(spark, sf)), CAUSAL)
    return discovery.pc_by_run(codes, names, "run_id", discovery.forbidden_pairs(names))


def q_lingam_by_run(spark, sf):
    names = [*CAUSAL, "class"]
    df = _by_nation(spark, sf, missing.median_impute(X.cust_features(spark, sf), ["na_mid"]))
    found = discovery.lingam_by_run(scaling.standard_scale(df, CAUSAL), names, "run_id", {"ruled": discovery.forbidden_pairs(names), "free": set()})
    return rounded(found, "weight")


def q_edge_cleanup(spark, sf):
    return graphs.edge_cleanup(X.edge_table(spark, sf))


def q_edge_strength_list(spark, sf):
    return rounded(graphs.edge_strength_list(X.edge_table(spark, sf)), "strength")


def q_node_roles(spark, sf):
    return graphs.node_roles(q_edge_cleanup(spark, sf))


def _size_chain(spark, sf):
    """A path over all part sizes, one hop from each to the next larger, the largest to the class."""
    sizes = X.table(spark, sf, "part").select(F.col("p_size").cast("long").alias("size")).distinct()
    after = F.lead("size").over(Window.partitionBy(F.lit(1)).orderBy("size"))
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    return sizes.select(F.lit(1).cast("long").alias("run_id"), name(F.col("size")).alias("src"), F.coalesce(name(after), F.lit("class")).alias("dst"))


def q_node_roles_chain(spark, sf):
    return graphs.node_roles(_size_chain(spark, sf))


def q_path_depth_chain(spark, sf):
    return graphs.path_depth(_size_chain(spark, sf))


def q_contingency_wide_codes(spark, sf):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    df = X.table(spark, sf, "customer").select(
        (key % 2 * 3).cast("int").alias("a"), (key % 2).cast("int").alias("b"), (nation % 5 * 7 - 7).cast("int").alias("c"))
    return independence.contingency(df, [("a", "b", ()), ("a", "c", ()), ("b", "c", ("a",))])


def q_spearman_matrix_gaps(spark, sf):
    return rounded(correlation.spearman_matrix(X.cust_features(spark, sf), GAPS), "rho")


def q_graph_structure(spark, sf):
    return graphs.graph_structure(q_edge_cleanup(spark, sf))


def q_hybrid_graph(spark, sf):
    return graphs.hybrid_graph(q_edge_cleanup(spark, sf), X.edge_table(spark, sf, "PC").select("run_id", "src", "dst"))


def q_hybrid_layers(spark, sf):
    return graphs.hybrid_layers(q_hybrid_graph(spark, sf))


def q_path_depth(spark, sf):
    return graphs.path_depth(q_hybrid_graph(spark, sf))


def _standard(spark, sf):
    return scaling.standard_scale(X.cust_features(spark, sf), CORE)


def q_age_adjusted_logit(spark, sf):
    out = logit.age_adjusted_logit(_standard(spark, sf), CORE)
    return rounded(out, *out.columns[1:-1])


def q_univariate_age_logit(spark, sf):
    out = logit.univariate_age_logit(_standard(spark, sf))
    return rounded(out, *out.columns[1:-1])


def q_bayes_logit(spark, sf):
    out = logit.bayes_logit(X.cust_features(spark, sf), CORE)
    return rounded(out, *out.columns[1:-1])


def q_bayes_logit_by_feature(spark, sf):
    out = logit.bayes_logit_by_feature(_standard(spark, sf), CORE)
    return rounded(out, *out.columns[1:-1])


PRUNED = ["ag_total", "ay_total", "cn_total", "ba_total", "aa_000"]


def q_collinearity_prune(spark, sf):
    df = histograms.family_sums(X.cust_features(spark, sf), X.FAMILIES, ["row_id", "label", "aa_000"])
    kept = logit.collinearity_prune(df, PRUNED)
    return rounded(df.agg(*[F.avg(c).alias(c) for c in kept]).unpivot([], kept, "feature", "mean"), "mean", digits=4)


def _rules_grid(spark, sf):
    df = missing.median_impute(X.cust_features(spark, sf), ["na_mid"])
    groups = {"aa_000": "Global", "ag_000": "Secondary", "ag_003": "Secondary", "ba_000": "Secondary", "na_mid": "Diagnostic"}
    return causal.experiment_rules_grid(df, CAUSAL, groups)


def q_experiment_rules_grid(spark, sf):
    return _rules_grid(spark, sf)["nodes"]


def q_experiment_rules_edges(spark, sf):
    return _rules_grid(spark, sf)["edges"]


_RENAMED = {
    "hist_sum": _hist(["_sum"]),
    "hist_center_mass": _hist(["_center_mass"]),
    "hist_entropy": _hist(["_entropy"]),
    "hist_skew": _hist(["_skew"]),
    "hist_kurt": _hist(["_kurt"]),
    "hist_bimodality": _hist(["_bimodality"]),
    "hist_peaks": _hist(["_peaks"]),
    "hist_intensity": _hist(["_DCI", "_LLI"]),
    "hist_stress_slope": _hist(["_stress_slope"]),
    "standard_scale": _scaled(scaling.standard_scale),
    "sample_scale": _scaled(scaling.sample_scale),
    "minmax_scale": _scaled(scaling.minmax_scale),
    "robust_scale": _scaled(scaling.robust_scale),
}


def queries() -> dict[str, Query]:
    found = {k[2:]: v for k, v in globals().items() if k.startswith("q_") and callable(v)}
    return {name: _configured(fn) for name, fn in {**found, **_RENAMED}.items()}


def _configured(fn: Query) -> Query:
    return lambda spark, sf_dir: fn(configure(spark), sf_dir)
