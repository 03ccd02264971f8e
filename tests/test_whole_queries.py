"""Registered queries use the operators' own defaults."""

from conftest import SF

from faultline.operators import models
from faultline.registry import queries as Q


def test_all_models_in_the_registry_query(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(models, "fit_model", lambda name, df, cols, registry: fitted.append((name, registry[name](2))))
    monkeypatch.setattr(models, "predict", lambda model, df, cols: df.selectExpr("row_id", "label", "0.5D as prob"))
    Q.q_model_registry(spark, SF)
    assert [name for name, _ in fitted] == list(models.model_registry())
    assert dict(fitted)["gbt"].getMaxIter() == 20 and dict(fitted)["gbt"].getMaxDepth() == 5


def test_explanation_queries_are_whole(spark):
    assert Q._reference(spark, SF)[0].getNumTrees == 20
    assert {r["feature"] for r in Q.q_pdp_ice(spark, SF).select("feature").distinct().collect()} == set(Q.CORE)
    parts = {r["part"] for r in Q.q_rca_steps(spark, SF).collect()}
    assert parts == {"numbers", "metrics", "shap_global", "shap_local", "importance", "ranks", "pdp", "rules"}
