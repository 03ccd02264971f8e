"""Exact distances, neighbour estimates, densities, path attributions and permutations against plain versions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from faultline.functions.numeric import digamma_count, ks_exact_p
from faultline.functions.seeded import seeded_bijection
from faultline.operators import describe, explain, order, ranktests
from faultline.sources import fixtures as X


def _gaps(pool, second, n1):
    """Largest gap over the ends of ties, and over all places."""
    n0, i, tied, free = len(pool) - n1, 0, 0, 0
    for s in range(1, len(pool) + 1):
        i += (s - 1) in second
        gap = abs(i * n0 - (s - i) * n1)
        free = max(free, gap)
        if s == len(pool) or pool[s] != pool[s - 1]:
            tied = max(tied, gap)
    return tied, free


def test_exact_chances_equal_all_splits():
    rng = np.random.default_rng(1)
    for _ in range(25):
        n = int(rng.integers(2, 13))
        n1, pool = int(rng.integers(1, n)), sorted(rng.integers(0, 5, n).tolist())
        found = [_gaps(pool, set(c), n1) for c in itertools.combinations(range(n), n1)]
        ends = [s for s in range(1, n + 1) if s == n or pool[s] != pool[s - 1]]
        for gap in {g for both in found for g in both} | {1, 2}:
            assert ks_exact_p(n - n1, n1, gap, ends) == pytest.approx(np.mean([t >= gap for t, _ in found]), abs=1e-12)
            assert ks_exact_p(n - n1, n1, gap) == pytest.approx(np.mean([f >= gap for _, f in found]), abs=1e-12)
    assert ks_exact_p(5, 5, 25) == pytest.approx(2 / math.comb(10, 5)) and ks_exact_p(3, 4, 0) == 1
    assert ks_exact_p(400, 300, 400 * 300) == pytest.approx(2 / math.comb(700, 300), rel=1e-9)  # no digits lost near 0


def test_ks_summary_uses_exact_chances_up_to_the_size(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"label": [0] * 7 + [1] * 5, "a": rng.normal(size=12), "b": rng.integers(0, 3, 12).astype(float), "c": [np.nan] * 7 + [1.0] * 5})
    df = spark.createDataFrame(pdf).repartition(3)
    for ties in (False, True):
        rows = {r["feature"]: r for r in ranktests.ks_statistics(df, ["a", "b", "c"], ties=ties).collect()}
        for c in "ab":
            order_ = np.argsort(pdf[c].to_numpy(), kind="stable")
            pool = pdf[c].to_numpy()[order_].tolist()
            d, _ = _gaps(pool, set(np.flatnonzero(pdf.label.to_numpy()[order_] == 1)), 5)
            every = [_gaps(pool, set(s), 5) for s in itertools.combinations(range(12), 5)]
            assert rows[c]["stat"] == pytest.approx(d / 35)
            assert rows[c]["p_value"] == pytest.approx(np.mean([(t if ties else f) >= d for t, f in every]))
        assert (rows["c"]["stat"], rows["c"]["p_value"]) == (None, 1.0)
    limit = ranktests.ks_statistics(df, ["a"], exact=6).first()["p_value"]
    assert limit != pytest.approx(ranktests.ks_statistics(df, ["a"], exact=7).first()["p_value"])


def test_digamma_of_counts(spark):
    got = [r[0] for r in spark.range(1, 60).select(digamma_count(F.col("id"))).collect()]
    harmonic = np.concatenate([[0], np.cumsum(1 / np.arange(1, 59))])
    assert np.allclose(got, harmonic - 0.5772156649015329, atol=1e-13, rtol=0)


def neighbour_information(x, y, k=3):
    """All pairs; distances and interval ends as the operator states them."""
    keep = ~np.isnan(x) & np.isin(y, [c for c in (0, 1) if (y[~np.isnan(x)] == c).sum() > 1])
    x, y = x[keep], y[keep]
    if not len(x):
        return 0.0
    psi = np.concatenate([[0.0], np.concatenate([[0], np.cumsum(1 / np.arange(1, len(x) + 2))]) - 0.5772156649015329])  # psi[n]
    total = 0.0
    for i in range(len(x)):
        same = np.flatnonzero((y == y[i]) & (np.arange(len(x)) != i))
        distance = np.abs(x[same] - x[i])
        at = np.lexsort((x[same], distance))[min(k, len(same)) - 1]
        low, high = min(x[i] - distance[at], x[same][at]), max(x[i] + distance[at], x[same][at])
        inside = (x >= low) & (x <= high)
        total += psi[(inside & (y == y[i])).sum() - 1] - psi[inside.sum() - 1] - psi[len(same) + 1]
    return max(0.0, psi[len(x)] + total / len(x))


def test_neighbour_information_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    n = 700
    y = (rng.random(n) < 0.3).astype(int)
    pdf = pd.DataFrame({"label": y, "shifted": rng.normal(size=n) + 1.5 * y, "noise": rng.normal(size=n), "whole": rng.integers(0, 9, n) + 2 * y,
                        "hot": np.where(rng.random(n) < 0.6, 0.0, rng.random(n)), "gaps": np.where(rng.random(n) < 0.5, np.nan, rng.random(n) - y)})
    pdf["alone"] = np.where(y == 1, np.nan, pdf.noise)
    pdf.loc[pdf.index[y == 1][:1], "alone"] = 5.0  # one row of the class: left out
    pdf["empty"] = np.nan
    cols = [c for c in pdf if c != "label"]
    df = spark.createDataFrame(pdf).repartition(4)
    want = {c: neighbour_information(pdf[c].to_numpy(), y) for c in cols}
    for options in ({}, {"block": 16}, {"large": True, "block": 64}):
        got = {r["feature"]: r["mi"] for r in ranktests.mutual_info(df, cols, **options).collect()}
        assert got == {c: pytest.approx(want[c], abs=1e-9) for c in cols}
    assert want["shifted"] > 0.1 > want["noise"] and want["alone"] == want["empty"] == 0
    one = ranktests.mutual_info(df, ["shifted"], neighbours=1).first()["mi"]
    assert one == pytest.approx(neighbour_information(pdf["shifted"].to_numpy(), y, 1), abs=1e-9)


def test_neighbour_information_of_the_tables(spark):
    pdf = X.item_features(spark, SF).limit(1500).toPandas()
    got = {r["feature"]: r["mi"] for r in ranktests.mutual_info(spark.createDataFrame(pdf), X.ITEM).collect()}
    assert got == {c: pytest.approx(neighbour_information(pdf[c].to_numpy(), pdf.label.to_numpy()), abs=1e-9) for c in X.ITEM}


def test_densities_near_the_direct_sum(spark):
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({"label": rng.integers(0, 2, n), "a": rng.normal(size=n), "b": np.where(rng.random(n) < 0.01, 1e4, rng.exponential(size=n)),
                        "c": rng.integers(0, 4, n).astype(float), "flat": 1.0})
    pdf.loc[::7, "a"] = np.nan
    got = describe.density_by_class(spark.createDataFrame(pdf).repartition(3), ["a", "b", "c", "flat"]).toPandas()
    assert set(got.feature) == {"a", "b", "c"} and len(got) == 3 * 2 * 200
    for (f, y), part in got.groupby(["feature", "label"]):
        v = pdf.loc[pdf.label == y, f].dropna().to_numpy()
        width = v.std(ddof=1) * len(v) ** -0.2
        part = part.sort_values("point")
        assert np.allclose(part.x, np.linspace(v.min() - 3 * width, v.max() + 3 * width, 200))
        z = (part.x.to_numpy()[:, None] - v) / width
        direct = np.exp(-z * z / 2).sum(axis=1) / (len(v) * width * math.sqrt(2 * math.pi))
        share = np.array([[0.5 * math.erfc(-t / math.sqrt(2)) for t in row] for row in z]).mean(axis=1)
        assert np.abs(part.density - direct).max() < 1e-3 * direct.max() and np.abs(part["cdf"] - share).max() < 1e-3


def _random_tree(rng, depth, features):
    f, split, left, right, value, cover = [], [], [], [], [], []

    def grow(level, rows):
        at = len(f)
        for column, v in ((f, -1), (split, 0.0), (left, -1), (right, -1), (value, rng.normal()), (cover, rows)):
            column.append(v)
        if level and rows > 1:
            f[at], split[at], value[at] = int(rng.integers(features)), rng.normal(), 0.0
            mine = max(1.0, rows * rng.uniform(0.2, 0.8))
            left[at], right[at] = grow(level - 1, mine), grow(level - 1, rows - mine if rows > mine else 1.0)
        return at

    grow(depth, float(2**depth) * 8)
    return explain.Tree(0.5, *(np.array(c) for c in (f, split, left, right)), np.array(value), np.array(cover))


def test_path_attributions_equal_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(5):
        tree, n = _random_tree(rng, 5, 6), 6
        x = rng.normal(size=(4, n))
        got = explain.attributions(explain.leaf_paths(tree), x)
        for row, phi in zip(x, got):
            def expect(known, at=0):
                if tree.feature[at] < 0:
                    return tree.weight * tree.value[at]
                a, b = tree.left[at], tree.right[at]
                if tree.feature[at] in known:
                    return expect(known, a if row[tree.feature[at]] <= tree.split[at] else b)
                return (tree.cover[a] * expect(known, a) + tree.cover[b] * expect(known, b)) / tree.cover[at]

            v = {s: expect(set(s)) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
            for i in range(n):
                want = sum((v[tuple(sorted((*s, i)))] - v[s]) / (n * math.comb(n - 1, len(s))) for s in v if i not in s)
                # Covers of children need not add up to that of their node here, so shares differ from a tree's.
                assert phi[i] == pytest.approx(want, abs=1e-9)


def test_deep_paths_stay_small():
    import tracemalloc

    rng = np.random.default_rng(6)
    tree = _random_tree(rng, 12, 30)
    x = rng.normal(size=(20, 30))
    tracemalloc.start()
    paths = explain.leaf_paths(tree)
    phi = explain.attributions(paths, x)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    assert max(len(p.features) for p in paths) >= 9
    base = sum(p.value * np.prod(p.share) for p in paths)
    assert np.allclose(phi.sum(axis=1) + base, tree.score(x), atol=1e-8)


def test_bijection(spark):
    for n in (1, 2, 3, 5, 17, 100, 1023, 4096, 10_007):
        got = [r[0] for r in spark.range(n).select(seeded_bijection(F.col("id"), n, 7, F.lit(3))).collect()]
        assert sorted(got) == list(range(n))
    other = [r[0] for r in spark.range(n).select(seeded_bijection(F.col("id"), n, 7, F.lit(4))).collect()]
    assert np.mean(np.array(got) == np.array(other)) < 0.01 and abs(np.corrcoef(got, np.arange(n))[0, 1]) < 0.05


def test_dense_positions(spark):
    df = spark.range(1000, numPartitions=7).where("id % 7 <> 3")
    placed, n = order.dense_positions(df)
    rows = sorted(placed.collect(), key=lambda r: r["position"])
    assert n == len(rows) and [r["position"] for r in rows] == list(range(n)) and [r["id"] for r in rows] == sorted(r["id"] for r in rows)
    assert order.dense_positions(df.where("false"))[1] == 0


def test_permutation_costs_equal_a_plain_permutation(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n, cols, repeats = 3000, ["a", "b", "c"], 4
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=cols)
    pdf["label"] = (pdf.a + 0.3 * rng.normal(size=n) > 0.8).astype(int)
    trees = [_random_tree(rng, 3, 2) for _ in range(3)]  # the third column is unused
    monkeypatch.setattr(explain, "read_trees", lambda model: trees)
    df = spark.createDataFrame(pdf).repartition(5)
    stored = {}
    monkeypatch.setattr(explain, "dense_positions", lambda d, out: stored.setdefault("at", order.dense_positions(d, out)))
    got = {r["feature"]: (r["pi_mean"], r["pi_std"]) for r in explain.permutation_importance_cost(None, df, cols, 0.5, repeats=repeats).collect()}
    rows = stored["at"][0].orderBy("_at").collect()
    x, y = np.array([r["_x"] for r in rows]), np.array([r["_y"] for r in rows]) == 1

    def cost(x):
        hit = explain.to_prob(sum(t.score(x) for t in trees)) >= 0.5
        return 10 * (hit & ~y).sum() + 500 * (~hit & y).sum()

    for i, c in enumerate(cols):
        rises = []
        for rep in range(repeats):
            to = [r[0] for r in spark.range(n).select(seeded_bijection(F.col("id"), n, 42, F.lit(rep))).collect()]
            mixed = x.copy()
            mixed[to, i] = x[:, i]
            rises.append(cost(mixed) - cost(x))
        assert got[c] == (pytest.approx(np.mean(rises)), pytest.approx(np.std(rises)))
    assert got["c"] == (0, 0)


def test_radii_stay_in_generated_code(spark):
    rng = np.random.default_rng(5)
    v = np.sort(np.unique(np.round(rng.normal(size=60), 2)))
    n = rng.integers(1, 4, len(v))
    counts = spark.createDataFrame([(0, float(a), 0, int(b)) for a, b in zip(v, n)], "feature int, value double, n0 long, n1 long")
    for neighbours in (1, 3, 9):
        found = ranktests._radii(counts, neighbours, 256, False)
        if neighbours == 3:
            assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()
        every = np.repeat(v, n)
        for r in found.collect():
            d = np.sort(np.abs(every - r["value"]))[min(neighbours, len(every) - 1)]
            assert r["low"] == pytest.approx(r["value"] - d) and r["high"] == pytest.approx(r["value"] + d)
