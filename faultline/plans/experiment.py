"""Cross-validated cost, hold-out evaluation, experiment grids and leaderboards.

The driver loops over folds and configurations; everything inside one step is Spark,
and only fold summaries come back.
"""

from __future__ import annotations

import itertools
import logging
import threading
import time
from collections.abc import Callable, Mapping, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.balancing import copula_balance, smote, smote_enn, smote_tomek
from faultline.operators.cost import best_threshold_grid, metrics_at
from faultline.operators.models import fit_model, predict
from faultline.operators.prefix import few_rows
from faultline.operators.sampling import split_frames, stratified_kfold
from faultline.operators.scaling import apply_affine, fit_standard
from faultline.operators.selection import SELECTORS
from faultline.plans.prep import fit_prep
from faultline.session import cut_lineage, spread

log = logging.getLogger(__name__)

# Rows of a task where a training table is kept.
ROWS_TASK = 50_000
RUNS_AT_ONCE = 4  # configurations fitted at the same time on the same kept rows

# A name of SELECTORS, or a function that returns column names.
Selector = str | Callable[[DataFrame, Sequence[str]], list[str]]

SAMPLERS = {"smote": smote, "smote_enn": smote_enn, "smote_tomek": smote_tomek, "copula": copula_balance}

RUN_SCHEMA = (
    "model string, feature_set string, selector string, sampler string, tuning string, run_name string, "
    "cost_mean double, cost_std double, auc_mean double, f1_mean double, fit_time_mean double, "
    "sampling_percentage double, status string, message string"
)
FOLD_SCHEMA = (
    "fold int, auc double, cost double, f1 double, threshold double, fit_time double, pred_time double, "
    "features array<string>"
)


def _together(spark, tasks: Sequence[Callable]) -> list:
    """Results of ``tasks``, a few at a time: their jobs are short, and the cluster would wait for the driver's planning."""
    if len(tasks) < 2:
        return [t() for t in tasks]
    pool = ThreadPool(min(RUNS_AT_ONCE, len(tasks)))
    try:
        return pool.map(lambda t: t(), [inheritable_thread_target(spark)(t) for t in tasks], chunksize=1)
    finally:
        pool.close()
        pool.join()


class _Shared:
    """What runs on the same rows have in common: a step is done for the first run that asks for it, others wait.

    ``saved`` are the seconds that steps took for other runs, so that a run's fit time counts all its steps once.
    ``rows`` is the number of rows, if known.
    """

    def __init__(self, rows: int | None = None):
        self.made, self.locks, self.kept, self.saved, self.rows = {}, {}, [], 0.0, rows

    def once(self, step, build, run: _Shared | None = None):
        t0 = time.perf_counter()
        with self.locks.setdefault(step, threading.Lock()):
            if step not in self.made:
                t1 = time.perf_counter()
                out = build()
                self.made[step] = (out, time.perf_counter() - t1)
                return out
            out, seconds = self.made[step]
            if run is not None:
                run.saved += seconds - (time.perf_counter() - t0)
            return out

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df.persist())
        return self.kept[-1]

    def branch(self, rows: int | None = None) -> _Shared:
        self.kept.append(_Shared(rows))
        return self.kept[-1]

    def unpersist(self) -> None:
        for part in self.kept:
            part.unpersist()
        self.kept.clear()
        self.made.clear()
        self.locks.clear()


def _dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` in as many parts as its rows need, with a plan that only reads them: a fold runs dozens of jobs on it."""
    if rows is not None or df.storageLevel.useMemory:
        return cut_lineage(spread(df, "row_id", ROWS_TASK, rows))
    try:  # counted and dealt: the rows are made once
        df.persist()
        return cut_lineage(spread(df, "row_id", ROWS_TASK, df.count()))
    finally:
        df.unpersist()


def _train(
    train: DataFrame, cols: Sequence[str], model: str, sampler: str | None, ratio: float,
    selector: Selector | None, preprocess: bool, registry, modules: bool, n_features: int, shared: _Shared | None = None,
    run: _Shared | None = None,
):
    """Impute, select, balance, scale, fit; returns the fitted model and a scorer.

    ``shared`` belongs to these rows and columns: imputation and named selections in it are not fitted again.
    """
    own = _Shared() if shared is None else shared
    large = few_rows(own.rows)

    def prepared():
        prep = fit_prep(train, cols, modules=modules, large=large) if preprocess else None
        ready = prep.transform(train) if prep else train.select("row_id", "label", *cols)
        return prep, own.keep(ready), prep.output_columns() if prep else list(cols)

    try:
        prep, ready, used = own.once("prep", prepared, run)
        if isinstance(selector, str):
            every = used
            used = own.once(("select", selector), lambda: SELECTORS[selector](ready, every, n_features, large), run)
        elif selector is not None:
            used = selector(ready, used)
        balanced = SAMPLERS[sampler](ready, used, ratio) if sampler else ready.select("row_id", "label", *used)
        scale = fit_standard(balanced, used)
        fitted = fit_model(model, apply_affine(balanced, scale), used, registry)
    finally:
        if shared is None:
            own.unpersist()

    def score(df: DataFrame) -> DataFrame:
        x = prep.transform(df) if prep else df
        return predict(fitted, apply_affine(x.select("row_id", "label", *used), scale), used)

    return fitted, used, score


def _fold_row(
    train: DataFrame, valid: DataFrame, cols: Sequence[str], p: Mapping, max_threshold: float,
    preprocess: bool, registry, modules: bool, n_features: int, shared: _Shared, n_valid: int,
) -> tuple:
    run, t0 = _Shared(), time.perf_counter()
    _, used, score = _train(train, cols, p["model"], p["sample"], p["pct"] or 1.0, p["select"], preprocess, registry, modules, n_features, shared, run)
    t1 = time.perf_counter()
    scores = cut_lineage(score(valid))
    t2 = time.perf_counter()
    thr = best_threshold_grid(scores, max_threshold, rows=n_valid).first()["threshold"] if p["tune"] else 0.5
    m = metrics_at(scores, thr, large=few_rows(n_valid)).first()
    return m["auc"], m["cost"], m["macro_f1"], float(thr), t1 - t0 + run.saved, t2 - t1, list(used)


def _fold_rows(
    df: DataFrame, cols: Sequence[str], plan: Sequence[Mapping], folds: int, max_threshold: float,
    preprocess: bool, seed: int, registry, modules: bool, n_features: int,
) -> list[list[tuple] | Exception]:
    """For each run of ``plan`` its row of each fold, or the error that ended it.

    All runs see the same folds, so a fold is taken once, for every run; its imputed rows are freed after it.
    """
    got: list[list[tuple] | Exception] = [[] for _ in plan]
    was_kept = df.storageLevel.useMemory
    try:
        if not was_kept:  # its number, ranks and rows are made once
            df.persist()
        marked = _dealt(stratified_kfold(df.where("label is not null"), folds, seed=seed), df.count()).persist()
    finally:
        if not was_kept:
            df.unpersist()
    try:
        sizes = {r["fold"]: r["count"] for r in marked.groupBy("fold").count().collect()}
        for f in range(folds):
            train, valid = marked.where(F.col("fold") != f).drop("fold"), marked.where(F.col("fold") == f).drop("fold")
            shared = _Shared(sum(n for g, n in sizes.items() if g != f))

            def row(p, f=f, train=train, valid=valid, shared=shared):
                try:
                    return f, *_fold_row(train, valid, cols, p, max_threshold, preprocess, registry, modules, n_features, shared, sizes.get(f, 0))
                except Exception as e:  # noqa: BLE001 - one bad configuration must not stop the others
                    return e

            left = [i for i, g in enumerate(got) if not isinstance(g, Exception)]
            for i, r in zip(left, _together(df.sparkSession, [partial(row, plan[i]) for i in left]), strict=True):
                if isinstance(r, Exception):
                    got[i] = r
                else:
                    got[i].append(r)
            shared.unpersist()
    finally:
        marked.unpersist()
    return got


def cv_cost(
    df: DataFrame, cols: Sequence[str], model: str = "gbt", folds: int = 4, sampler: str | None = None,
    ratio: float = 1.0, selector: Selector | None = None, tune: bool = True, max_threshold: float = 0.4,
    preprocess: bool = True, seed: int = 42, registry=None, modules: bool = False, n_features: int = 50,
) -> DataFrame:
    """One row per fold: AUC, cost, macro-F1, threshold, times and selected features.

    Imputation, missingness modules (``modules``) and selection are fitted inside each fold.
    """
    run = dict(model=model, sample=sampler, pct=ratio, select=selector, tune=tune)
    rows = _fold_rows(df, cols, [run], folds, max_threshold, preprocess, seed, registry, modules, n_features)[0]
    if isinstance(rows, Exception):
        raise rows
    return df.sparkSession.createDataFrame(rows, FOLD_SCHEMA)


def fold_summary(folds: DataFrame) -> DataFrame:
    """Means, population standard deviations, and the median threshold over folds."""
    return folds.agg(
        F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"),
        F.avg("cost").alias("cost_mean"), F.stddev_pop("cost").alias("cost_std"),
        F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"),
        # A handful of folds: the exact in-memory median is fine here.
        F.median("threshold").alias("threshold"),
        F.avg("fit_time").alias("fit_time_mean"), F.avg("pred_time").alias("pred_time_mean"),
    )


def evaluate_holdout(
    train: DataFrame, test: DataFrame, cols: Sequence[str], model: str = "gbt", sampler: str | None = None,
    ratio: float = 1.0, selector: Selector | None = None, tune: bool = True, max_threshold: float = 0.4,
    preprocess: bool = True, seed: int = 42, registry=None, modules: bool = False, n_features: int = 50,
    shared: _Shared | None = None,
) -> DataFrame:
    """Tune the threshold on a stratified 20 %, refit on all of train, score test."""
    own = _Shared() if shared is None else shared

    def parts():
        fit_part, tune_part = split_frames(rows, 0.8, seed=seed)
        fit_part = own.keep(_dealt(fit_part, round(0.8 * whole.rows)))
        tune_part = own.keep(_dealt(tune_part, round(0.2 * whole.rows)))
        return fit_part, tune_part, tune_part.count(), own.branch(fit_part.count())

    def tuned():
        fit_part, tune_part, n_tune, within = own.once("parts", parts)
        _, _, score = _train(fit_part, cols, model, sampler, ratio, selector, preprocess, registry, modules, n_features, within)
        return best_threshold_grid(score(tune_part), max_threshold, rows=n_tune).first()["threshold"]

    def fitted():
        return _train(rows, cols, model, sampler, ratio, selector, preprocess, registry, modules, n_features, whole)[2]

    def all_rows():
        kept = own.keep(_dealt(train))
        return kept, own.branch(kept.count())

    try:
        rows, whole = own.once("train", all_rows)
        fits = [tuned, fitted] if tune else [fitted]
        # Neither needs the other; where runs share their rows, both are kept anyway.
        got = [f() for f in fits] if shared is None else _together(train.sparkSession, fits)
        thr, score = got[0] if tune else 0.5, got[-1]
    finally:
        if shared is None:
            own.unpersist()
    if shared is None:
        return metrics_at(score(test), thr)
    scores = cut_lineage(score(test))
    return metrics_at(scores, thr, large=few_rows(scores.count()))


def run_name(model: str, fset: str, selector: str, sampler: str, tuning: str, pct: float | None) -> str:
    part = fset if selector == "None" else f"{fset} + {selector}"
    tail = "" if pct is None else f" | Sampling Percentage: {pct}"
    return f"{model} | {part} | {sampler} | {tuning}{tail}"


def run_plan(models, feature_sets, selectors, samplers, tunings, percentages) -> list[dict]:
    """Every configuration; percentages apply only where a sampler is set."""
    out = []
    for model, fset, (sel_name, sel), (samp_name, samp), (tune_name, tune) in itertools.product(
        models, feature_sets, selectors.items(), samplers.items(), tunings.items()
    ):
        for pct in percentages if samp is not None else [None]:
            out.append(dict(
                model=model, feature_set=fset, selector=sel_name, sampler=samp_name, tuning=tune_name,
                pct=pct, select=sel, sample=samp, tune=tune,
                run_name=run_name(model, fset, sel_name, samp_name, tune_name, pct),
            ))
    return out


def experiment_grid(
    feature_sets: Mapping[str, tuple[DataFrame, Sequence[str]]],
    models: Sequence[str],
    selectors: Mapping[str, Selector | None] | None = None,
    samplers: Mapping[str, str | None] | None = None,
    tunings: Mapping[str, bool] | None = None,
    percentages: Sequence[float] = (1.0,),
    folds: int = 4,
    max_threshold: float = 0.4,
    preprocess: bool = True,
    seed: int = 42,
    registry=None,
    modules: bool = False,
    n_features: int = 50,
) -> DataFrame:
    """Cross-validated cost of every configuration, one row each.

    A run that fails has the status ``failed``, the error as its message and NULL metrics.
    """
    plan = run_plan(
        models, feature_sets, selectors or {"None": None}, samplers or {"No Sampling": None},
        tunings or {"Tuned Threshold": True}, percentages,
    )
    spark = next(iter(feature_sets.values()))[0].sparkSession
    found: list = [None] * len(plan)
    for name, (df, cols) in feature_sets.items():
        here = [i for i, p in enumerate(plan) if p["feature_set"] == name]
        try:
            got = _fold_rows(df, cols, [plan[i] for i in here], folds, max_threshold, preprocess, seed, registry, modules, n_features)
        except Exception as e:  # noqa: BLE001 - nor one bad feature set
            got = [e] * len(here)
        for i, r in zip(here, got, strict=True):
            found[i] = r
    rows = []
    metrics = ["cost_mean", "cost_std", "auc_mean", "f1_mean", "fit_time_mean"]
    for p, r in zip(plan, found, strict=True):
        if isinstance(r, Exception):
            log.warning("run %s failed: %s", p["run_name"], r)
            got, status = [None] * len(metrics), ("failed", f"{type(r).__name__}: {r}")
        else:
            s = fold_summary(spark.createDataFrame(r, FOLD_SCHEMA)).first()
            got, status = [s[m] for m in metrics], ("ok", None)
        rows.append((
            p["model"], p["feature_set"], p["selector"], p["sampler"], p["tuning"], p["run_name"], *got, p["pct"], *status,
        ))
    return spark.createDataFrame(rows, RUN_SCHEMA)


def _ranked(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("feature_set").orderBy(F.asc_nulls_last("cost_mean"), "run_name")
    return runs.withColumn("set_rank", F.row_number().over(w))


def experiment_leaderboard(runs: DataFrame, top_n: int = 20) -> DataFrame:
    """Runs by mean cost, with the position inside their feature set."""
    return _ranked(runs).orderBy(F.asc_nulls_last("cost_mean"), "run_name").limit(top_n)


def best_per_feature_set(runs: DataFrame) -> DataFrame:
    return _ranked(runs).where("set_rank = 1")


TEST_SCHEMA = (
    "rank int, run_name string, cost_mean double, auc double, macro_f1 double, recall double, precision double, fp long, fn long, "
    "cost double, threshold double, status string, message string"
)


def leaderboard_on_test(
    runs: DataFrame,
    feature_sets: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]],
    selectors: Mapping[str, Selector | None] | None = None,
    samplers: Mapping[str, str | None] | None = None,
    tunings: Mapping[str, bool] | None = None,
    top_n: int = 20,
    **options,
) -> DataFrame:
    """The cheapest runs of a grid, built again and scored on test rows; one row each, by their rank in the grid.

    ``feature_sets`` gives training rows, test rows and columns by name; the other mappings are those the grid had. A
    run is refitted whole: imputation, selection, sampling and scaling on the training rows, its threshold
    tuned on a part of them. A run that fails has the status ``failed`` and NULL metrics.
    """
    selectors, samplers = selectors or {"None": None}, samplers or {"No Sampling": None}
    tunings = tunings or {"Tuned Threshold": True}
    metrics = ["auc", "macro_f1", "recall", "precision", "fp", "fn", "cost", "threshold"]
    # At most ``top_n`` rows.
    best = runs.where("status = 'ok'").orderBy("cost_mean", "run_name").limit(top_n).collect()
    shared = {r["feature_set"]: _Shared() for r in best}

    def scored(i, r):
        try:
            train, test, cols = feature_sets[r["feature_set"]]
            kept = shared[r["feature_set"]]
            m = evaluate_holdout(
                train, kept.once("test", lambda: kept.keep(_dealt(test))), cols, r["model"], samplers[r["sampler"]],
                1.0 if r["sampling_percentage"] is None else r["sampling_percentage"],
                selectors[r["selector"]], tunings[r["tuning"]], **options, shared=kept,
            ).first()
            got, status = [m[k] for k in metrics], ("ok", None)
        except Exception as e:  # noqa: BLE001 - one bad run must not stop the others
            log.warning("run %s failed on test: %s", r["run_name"], e)
            got, status = [None] * len(metrics), ("failed", f"{type(e).__name__}: {e}")
        return i + 1, r["run_name"], r["cost_mean"], *got, *status

    rows = _together(runs.sparkSession, [partial(scored, i, r) for i, r in enumerate(best)])
    for kept in shared.values():
        kept.unpersist()
    return runs.sparkSession.createDataFrame(rows, TEST_SCHEMA)
