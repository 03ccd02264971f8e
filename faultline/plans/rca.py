"""Model explanation from fit to rules, in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from faultline.operators import cost, explain, models
from faultline.session import cut_lineage

_FITTED: dict[tuple, tuple] = {}


def shared_reference(df: DataFrame, cols: Sequence[str], registry):
    """Reference model fitted once per session and table."""
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(cols), repr(registry))
    if key not in _FITTED:
        model, train, valid = explain.reference_model(df, cols, registry=registry)
        _FITTED[key] = (model, train, valid.persist())
    return _FITTED[key]


def explain_run(
    df: DataFrame, cols: Sequence[str], seed: int = 42, registry=None, repeats: int = 10, shap_rows: int | None = None,
    pdp_rows: int | None = None, pdp_top: int = 3, surrogate_depth: int = 3, top_k: int = 5,
) -> dict[str, object]:
    """Fit, threshold, attributions, cost importance, rank comparison, partial dependence, rules.

    All rows are explained; ``shap_rows`` and ``pdp_rows`` bound them for a quick look.
    """
    from faultline.operators.order import seeded_take

    model, _, valid = explain.reference_model(df, cols, seed, registry)
    valid = valid.persist()
    scores = models.predict(model, valid, cols).persist()
    best = cost.best_threshold_dense(scores).first()
    sample = valid if shap_rows is None else seeded_take(valid, shap_rows, (), seed)
    # Several parts take each of these: rows are explained once, and one row per feature is kept of both rankings.
    shap = explain.shap_values(model, sample, cols).persist()
    top = cut_lineage(explain.shap_global(shap, cols))
    pi = cut_lineage(explain.permutation_importance_cost(model, valid, cols, best["threshold"], repeats, seed))
    # A handful of features: the names of the strongest few choose the curves.
    leaders = [r["feature"] for r in top.limit(pdp_top).collect()]
    tree, fidelity = explain.surrogate_tree(model, valid, cols, best["threshold"], surrogate_depth, seed)
    return {
        "threshold": best["threshold"],
        "metrics": cost.metrics_at(scores, best["threshold"]),
        "shap_global": top,
        "shap_local": explain.shap_local(shap, valid, cols, best["threshold"], top_k),
        "importance": pi,
        "ranks": explain.compare_ranks(top, pi),
        "pdp": explain.pdp(explain.pdp_ice(model, valid, cols, leaders, max_rows=pdp_rows, seed=seed)),
        "rules": explain.surrogate_rules(tree, cols, valid),
        "fidelity": fidelity,
    }
