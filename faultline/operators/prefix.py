"""Running counts over an ordered value, the kernel behind ranks, curves and quantiles.

Counts are prefix sums on two levels. Cut points are fitted to the values of every key that has
many; they divide the values of a key into slices of bounded size. Windows run inside ``(keys, slice)``,
and the sums of the slices before, a small table, are joined to them. A hot key is thus spread over many
tasks, a hot value is a slice of its own, and results don't depend on the cut points. Only fitting them
runs a job; the rest is lazy.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.numeric import finite_or_null

# Up to this many quantiles are computed as columns of one aggregation.
_WIDE_PROBS = 9
SLICE_ROWS = 1 << 14  # rows of a key in a slice, about
CUTS = 4096  # slices of a key, about, at most


def slice_rows(large: bool | None) -> int | None:
    """Rows in a slice: as set, few if asked to slice whatever there is, or None for no slices."""
    return None if large is False else 64 if large else SLICE_ROWS


def few_rows(rows: int | None) -> bool | None:
    """``large=False`` if so many rows fit into a slice, so that no key can have cuts and none need a job to be fitted."""
    return False if rows is not None and rows <= SLICE_ROWS else None


@lru_cache(maxsize=1)
def _shares(app: str) -> Column:
    """The shares at which cuts may lie, as one literal, made once an application: filling it takes thousands of calls."""
    return F.lit(np.arange(1, CUTS) / CUTS)


def fitted_cuts(rows: DataFrame, keys: Sequence[str], at: Sequence[Column], per_slice: int) -> list[DataFrame | None]:
    """For each of the ordered numbers ``at``: ``(keys..., _cuts)``, its cut points in ascending order.

    One job for all. Keys with at most ``per_slice`` rows have no cuts; None if no key has any. There
    is at most one cut for ``per_slice`` rows, so the tables are small beside the rows. The column's metadata
    tell the ``most`` cuts of a key.
    """
    shares = _shares(rows.sparkSession.sparkContext.applicationId)
    step = F.greatest(F.lit(1), F.floor(F.lit(float(CUTS * per_slice)) / F.col("_n")))
    thin = lambda q: F.array_distinct(F.filter(q, lambda c, i: (i + 1) % step == 0))
    found = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("_n"), *[F.percentile_approx(a.cast("double"), shares, 2 * CUTS).alias(f"_q{i}") for i, a in enumerate(at)])
        .where(F.col("_n") > per_slice)
        .select(*keys, *[thin(F.col(f"_q{i}")).alias(f"_c{i}") for i in range(len(at))])
    )
    got = found.collect()
    if not got:
        return [None] * len(at)
    table = rows.sparkSession.createDataFrame(got, found.schema)
    most = [max(len(r[f"_c{i}"]) for r in got) for i in range(len(at))]
    return [table.select(*keys, F.col(f"_c{i}").alias("_cuts", metadata={"most": m})) for i, m in enumerate(most)]


def with_slice(rows: DataFrame, keys: Sequence[str], at: Column, cuts: DataFrame, out: str = "_slice") -> DataFrame:
    """Add the slice of ``at``: 2 i between the cuts i - 1 and i, 2 i + 1 at cut i; 0 for keys without cuts."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    most = cuts.schema["_cuts"].metadata.get("most", CUTS)
    # At most one number for as many rows as a slice has.
    table = F.broadcast(cuts.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "_cuts"))
    joined = rows.join(table, on, "left") if keys else rows.join(table, F.lit(True))
    # One halving a projection: a lambda would leave the generated code, for microseconds a row and step.
    placed = joined.select(*rows.columns, "_cuts", at.alias("_at"), F.lit(0).alias("_below"))
    for step in (1 << i for i in reversed(range(int(most).bit_length()))):
        below = F.col("_below") + F.when(F.get("_cuts", F.col("_below") + F.lit(step - 1)) < F.col("_at"), F.lit(step)).otherwise(F.lit(0))
        placed = placed.select(*rows.columns, "_cuts", "_at", below.alias("_below"))
    here = 2 * F.col("_below") + F.coalesce((F.get("_cuts", F.col("_below")) == F.col("_at")).cast("int"), F.lit(0))
    return placed.select(*rows.columns, here.alias(out))


def _slice_offsets(sliced: DataFrame, keys: Sequence[str], measures: Sequence[str], slice_: str) -> DataFrame:
    """Per key and slice: its sums ``_s_<m>``, those of the slices before ``_o_<m>``, and the key's ``_t_<m>``."""
    before = Window.partitionBy(*keys).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # One row per key and slice, so that the windows see summaries only.
    return sliced.groupBy(*keys, slice_).agg(*[F.sum(m).alias(f"_s_{m}") for m in measures]).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(slice_).alias("_o_slice"), *[f"_s_{m}" for m in measures],
        *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(whole).alias(f"_t_{m}") for m in measures])


def _at_slice(keys: Sequence[str], slice_: str) -> Column:
    on = F.col(slice_) == F.col("_o_slice")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return on


def running_counts(
    agg: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Sequence[str],
    large: bool | None = None,
    at: Column | None = None,
) -> DataFrame:
    """Add ``cum_<m>``, the sum of ``m`` over rows of the same key with value <= this value,
    and ``tot_<m>``, its sum over the key.

    ``agg`` must hold one row per ``(keys, value)``. ``at`` is the number that ``value`` is ordered by first, if it
    isn't one. ``large=True`` cuts small inputs too, ``large=False`` fits no cuts: for summaries.
    """
    keys, at = list(keys), F.col(value) if at is None else at
    per_slice = slice_rows(large)
    cuts = None if per_slice is None else fitted_cuts(agg, keys, [at], per_slice)[0]
    upto = lambda w: w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if cuts is None:  # no key has more rows than a slice
        w = Window.partitionBy(*keys)
        return agg.select("*", *[F.sum(m).over(upto(w)).alias(f"cum_{m}") for m in measures], *[F.sum(m).over(w).alias(f"tot_{m}") for m in measures])
    sliced = with_slice(agg, keys, at, cuts)
    offsets = _slice_offsets(sliced, keys, measures, "_slice")
    inside = Window.partitionBy(*keys, "_slice")
    inner = sliced.select("*", *[F.sum(m).over(upto(inside)).alias(f"_in_{m}") for m in measures])
    return inner.join(offsets, _at_slice(keys, "_slice")).select(
        *agg.columns, *[(F.col(f"_in_{m}") + F.col(f"_o_{m}")).alias(f"cum_{m}") for m in measures], *[F.col(f"_t_{m}").alias(f"tot_{m}") for m in measures])


def carried_ranks(
    rows: DataFrame, keys: Sequence[str], value: str, n: str, out: str, cuts: DataFrame | None, total: str | None = None, salts: int = 64,
) -> DataFrame:
    """``rows`` with the average rank of ``value`` among the rows of the same keys, ``n`` copies each, and their ``total``.

    Rows may share a value. Ranks are worked out where a slice's rows meet and stay on them, so nothing is
    joined by value; a value that is a cut has one rank, known from the sums of the slices, and its rows are
    dealt out by their hash.
    """
    keys, kept = list(keys), rows.columns
    if cuts is None:
        w = Window.partitionBy(*keys)
        cum, same = F.sum(n).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.sum(n).over(w.orderBy(value).rangeBetween(Window.currentRow, Window.currentRow))
        return rows.select(*kept, (cum - (same - 1) / 2.0).alias(out), *([F.sum(n).over(w).alias(total)] if total else []))
    sliced = with_slice(rows, keys, F.col(value), cuts)
    offsets = _slice_offsets(sliced, keys, [n], "_slice")
    alone = F.col("_slice") % 2 == 1
    salted = sliced.withColumn("_salt", F.when(alone, F.pmod(F.xxhash64(*kept), F.lit(salts))).otherwise(F.lit(0)))
    w = Window.partitionBy(*keys, "_slice", "_salt").orderBy(value)
    inner = salted.select("*", F.sum(n).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("_cum"),
                          F.sum(n).over(w.rangeBetween(Window.currentRow, Window.currentRow)).alias("_same"))
    upto, group = F.when(alone, F.col(f"_s_{n}")).otherwise(F.col("_cum")), F.when(alone, F.col(f"_s_{n}")).otherwise(F.col("_same"))
    return inner.join(offsets, _at_slice(keys, "_slice")).select(
        *kept, (F.col(f"_o_{n}") + upto - (group - 1) / 2.0).alias(out), *([F.col(f"_t_{n}").alias(total)] if total else []))


def long_form(
    df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), drop_null: bool = True
) -> DataFrame:
    """Unpivot numeric columns to ``(ids..., feature, value)`` with missing values removed."""
    out = df.select(*ids, *[finite_or_null(c).alias(c) for c in cols]).unpivot(
        list(ids), list(cols), "feature", "value"
    )
    # -0.0 and 0.0 are one value for ranks but two groups for a shuffle.
    out = out.withColumn("value", F.col("value") + F.lit(0.0))
    return out.where(F.col("value").isNotNull()) if drop_null else out


def coded_form(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """``long_form`` with ``feature`` as a position in ``cols``: integer keys group and sort faster."""
    cells = F.array(
        *[F.struct(F.lit(i).alias("feature"), (finite_or_null(c) + F.lit(0.0)).alias("value")) for i, c in enumerate(cols)]
    )
    return df.select(*ids, F.inline(cells)).where(F.col("value").isNotNull())


def name_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace the positions of ``coded_form`` by column names."""
    names = F.array(*[F.lit(c) for c in cols])
    return df.withColumn("feature", F.get(names, F.col("feature")))


def class_counts_by_value(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """``(feature, value, n0, n1)``: rows of each class at each distinct value; coded features."""
    return (
        coded_form(df.where(F.col(label).isin(0, 1)), cols, [label])
        .groupBy("feature", "value")
        .agg(
            F.count_if(F.col(label) == 0).alias("n0"),
            F.count_if(F.col(label) == 1).alias("n1"),
        )
    )


def class_running_counts(
    df: DataFrame, cols: Sequence[str], label: str, large: bool | None = None
) -> DataFrame:
    """Class counts by value with running counts and per-feature totals ``t0, t1``."""
    counts = class_counts_by_value(df, cols, label)
    run = running_counts(counts, ["feature"], "value", ["n0", "n1"], large)
    return name_features(run.withColumnsRenamed({"tot_n0": "t0", "tot_n1": "t1"}), cols)


def small_sorted(df: DataFrame, *order) -> DataFrame:
    """Order a per-feature summary (one row per column name) in one task.

    A global sort would run the whole upstream twice to sample its range bounds.
    """
    return df.repartition(1).sortWithinPartitions(*order)


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    large: bool | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per ``(by..., feature, prob)``."""
    by = list(by)
    keys = [*by, "feature"]
    agg = coded_form(df, cols, by).groupBy(*keys, "value").agg(F.count("*").alias("n"))
    run = running_counts(agg, keys, "value", ["n"], large).withColumnRenamed("tot_n", "_total")
    last = F.col("_total") - 1
    if len(probs) > _WIDE_PROBS:
        # Many quantiles: each value emits the few whose ranks fall on it.
        upto, before = F.col("cum_n"), F.col("cum_n") - F.col("n")
        on = lambda rank: (rank > before) & (rank <= upto)
        low, high = (lambda p: F.floor(last * p) + 1), (lambda p: F.ceil(last * p) + 1)
        hit = F.filter(F.array(*[F.lit(float(p)) for p in probs]), lambda p: on(low(p)) | on(high(p)))
        tall = (
            run.select(*keys, "_total", "value", "cum_n", "n", F.explode(hit).alias("prob"))
            .groupBy(*keys, "prob")
            .agg(
                F.max("_total").alias("_total"),
                F.max(F.when(on(low(F.col("prob"))), F.col("value"))).alias("lo"),
                F.max(F.when(on(high(F.col("prob"))), F.col("value"))).alias("hi"),
            )
        )
        share = last * F.col("prob") - F.floor(last * F.col("prob"))
        return name_features(tall.select(*keys, "prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * share).alias("value")), cols)
    parts = []
    for i, p in enumerate(probs):
        pos = last * F.lit(float(p))
        parts += [
            F.min(F.when(F.col("cum_n") >= F.floor(pos) + 1, F.col("value"))).alias(f"_lo{i}"),
            F.min(F.when(F.col("cum_n") >= F.ceil(pos) + 1, F.col("value"))).alias(f"_hi{i}"),
        ]
    wide = run.groupBy(*keys).agg(F.first("_total").alias("_total"), *parts)
    picks = []
    for i, p in enumerate(probs):
        pos, lo, hi = last * F.lit(float(p)), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        picks.append(F.struct(F.lit(float(p)).alias("prob"), (lo + (hi - lo) * (pos - F.floor(pos))).alias("value")))
    rows = wide.select(*keys, F.inline(F.array(*picks)))
    return name_features(rows, cols)


def quantile_map(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], large: bool | None = None
) -> dict[str, list[float]]:
    """Fitted quantiles on the driver: ``{column: [one value per prob]}``."""
    out: dict[str, dict[float, float]] = {}
    for r in quantiles(df, cols, probs, large=large).collect():
        out.setdefault(r["feature"], {})[r["prob"]] = r["value"]
    return {c: [v[float(p)] for p in probs] for c, v in out.items()}
