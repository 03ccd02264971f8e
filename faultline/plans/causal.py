"""Causal discovery under different rule sets, with consolidated node and edge tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import discovery, graphs, logit, scaling
from faultline.operators.sampling import undersample_majority
from faultline.session import cut_lineage

# Rule triples: class is a sink, time is a source, time acts through mediators only.
EXPERIMENTS = [(False, False, False), (True, False, False), (True, True, True)]


def experiment_name(rules: tuple[bool, bool, bool]) -> str:
    return "EXP_" + "".join("T" if r else "F" for r in rules)


def one_global(features: Sequence[str], groups: Mapping[str, str], preferred: Sequence[str] = ("aa_000", "ci_000")) -> list[str]:
    """Keep one Global feature, by preference or else the first."""
    top = [f for f in features if groups.get(f) == "Global"]
    if len(top) <= 1:
        return list(features)
    best = next((p for p in preferred if p in top), top[0])
    return [f for f in features if f not in top or f == best]


def experiment_rules_grid(
    df: DataFrame,
    features: Sequence[str],
    groups: Mapping[str, str],
    experiments: Sequence[tuple[bool, bool, bool]] = EXPERIMENTS,
    label: str = "label",
    ratio: float = 1.0,
    time: str = graphs.TIME,
    max_level: int | None = None,
) -> dict[str, DataFrame]:
    """Run both searches per rule triple; returns ``nodes`` and ``edges`` for all experiments.

    The sample and its discretised form are the same for every experiment, and the skeleton does
    not depend on the rules: it is searched once. The linear models of all experiments go in
    lockstep.
    """
    names = one_global(features, groups)
    balanced = undersample_majority(df, ratio, label).select("row_id", label, *names).persist()
    codes = scaling.quantile_discretise(balanced, names).select(F.col(label).alias(graphs.TARGET), *names).persist()
    smooth = scaling.standard_scale(balanced, names).select(F.col(label).cast("double").alias(graphs.TARGET), *names).persist()
    everyone = [*names, graphs.TARGET]
    skeletons = discovery.pc_skeletons(codes.withColumn("run_id", F.lit("")), everyone, "run_id", max_level=max_level)
    skeleton = skeletons.get("", discovery.SkeletonSearch(everyone, 0.05))
    names_of = {experiment_name(rules): rules for rules in experiments}
    models = cut_lineage(discovery.lingam_by_run(
        smooth.withColumn("_all", F.lit("")), everyone, "_all",
        {k: discovery.forbidden_pairs(everyone, dict(groups), *rules) for k, rules in names_of.items()}, spread=False))
    codes.unpersist()
    smooth.unpersist()
    balanced.unpersist()
    whole = scaling.standard_scale(df.select("row_id", label, *names), names).persist()
    screen = {s: _screen(whole, names, time, label, s) for s in {(r[1], r[2]) for r in names_of.values()} if s[0] and time in names}
    node_parts, edge_parts, extra = [], [], []
    for name, (sink, source, mediation) in names_of.items():
        edges = discovery.pc_orient(everyone, skeleton.adj, skeleton.sepset, discovery.forbidden_pairs(everyone, None, sink, source, mediation))
        pc = df.sparkSession.createDataFrame([(name, a, b) for a, b in sorted(edges)], "run_id string, src string, dst string")
        raw = models.where(F.col("rule") == name).select(F.col("rule").alias("run_id"), "src", "dst", "weight")
        lingam = graphs.edge_cleanup(raw, sink, source, mediation)
        hybrid = graphs.hybrid_graph(lingam, pc, source)
        nodes = df.sparkSession.createDataFrame([(name, n) for n in everyone], "run_id string, node string")
        roles = {algo: cut_lineage(graphs.node_roles(edges, nodes)) for algo, edges in (("PC", pc), ("LiNGAM", lingam))}
        # At most one row per variable.
        candidates = sorted(r["node"] for r in roles["LiNGAM"].where(F.col("role").isin("Physical Root", "Mediator")).collect())
        extra.append(validated(whole, candidates, screen.get((source, mediation)), time, label, name))
        for algo, edges in (("PC", pc), ("LiNGAM", lingam)):
            node_parts.append(roles[algo].withColumn("algo", F.lit(algo)))
            edge_parts.append(edges.select("run_id", "src", "dst", F.lit(None).cast("string").alias("type"),
                                           F.lit(algo).alias("algo"), F.lit("Standard").alias("graph_type")))
        edge_parts.append(hybrid.select("run_id", "src", "dst", "type", F.lit("Hybrid").alias("algo"), F.lit("Hybrid").alias("graph_type")))
    whole.unpersist()
    rename = lambda d: d.withColumnRenamed("run_id", "experiment")
    # One row per experiment and variable.
    small = reduce(DataFrame.unionByName, extra)
    nodes = reduce(DataFrame.unionByName, node_parts).join(F.broadcast(small), ["run_id", "node"], "left")
    return {"nodes": rename(nodes), "edges": rename(reduce(DataFrame.unionByName, edge_parts))}


def _screen(whole: DataFrame, names: Sequence[str], time: str, label: str, rules: tuple[bool, bool]) -> dict[str, tuple[float, float]]:
    """Coefficient and odds ratio of each feature given time, largest first; time by itself where it may act directly."""
    rows = logit.age_adjusted_logit(whole, names, time, label).where("converged").collect()
    if not rules[1]:
        rows += logit.univariate_age_logit(whole, time, label).where("converged").collect()
    return {r["feature"]: (r["coef"], r["odds_ratio"]) for r in sorted(rows, key=lambda r: (-abs(r["coef"]), r["feature"]))}


VALIDATED = "run_id string, node string, coef double, odds_ratio double, posterior_mean double, posterior_odds double"


def validated(
    whole: DataFrame, candidates: Sequence[str], screen: Mapping[str, tuple[float, float]] | None, time: str, label: str, run_id: str, deep: int = 3,
) -> DataFrame:
    """Screening and posterior columns of an experiment's variables (``VALIDATED``).

    Where time is a source, every screened feature has its coefficient given time, and the ``deep`` strongest
    candidates their posterior given time. Otherwise the candidates have the joint posterior of those that the
    collinearity prune keeps.
    """
    if screen is not None:
        top = [f for f in screen if f in candidates and f != time][:deep]
        found = logit.bayes_logit_by_feature(whole, top, time, label).where("converged").collect() if top else []
    else:
        found = logit.bayes_logit(whole, list(candidates), label).where("converged").collect() if candidates else []
    posterior = {r["feature"]: (r["mean"], r["odds_ratio"]) for r in found}
    names = sorted({*(screen or {}), *posterior})
    rows = [(run_id, n, *(screen or {}).get(n, (None, None)), *posterior.get(n, (None, None))) for n in names]
    return whole.sparkSession.createDataFrame(rows, VALIDATED)
