"""Causal discovery from distributed sufficient statistics.

Searches run over at most a few dozen variables; every question they ask about rows
(contingency counts, covariances, entropy terms) is one Spark aggregation over the
whole table, and only the answers reach the driver. Many runs (segments, replicates, rule
sets) are searched in lockstep: each job answers what all of them ask next.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from heapq import merge
from itertools import combinations, groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.numeric import chi2_sf, finite_or_null
from faultline.operators.graphs import TARGET, TIER_DEFAULT, TIERS, TIME
from faultline.operators.independence import Test, chi_square, code_ranges, code_weights
from faultline.session import cut_lineage


def forbidden_pairs(
    names: Sequence[str], groups: dict[str, str] | None = None, class_sink: bool = True, time_source: bool = True,
    mediation: bool = True, target: str = TARGET, time: str = TIME,
) -> set[tuple[str, str]]:
    """``(cause, effect)`` pairs ruled out; the driver-side twin of ``prior_matrix``."""
    out = set()
    for c in names:
        for e in names:
            if c == e:
                continue
            plain = not {c, e} & {target, time}
            tier = lambda f: TIERS.get((groups or {}).get(f, ""), TIER_DEFAULT)
            if (
                (class_sink and c == target)
                or (time_source and e == time)
                or (mediation and c == time and e == target)
                or (groups and plain and tier(c) > tier(e))
            ):
                out.add((c, e))
    return out


class SkeletonSearch:
    """Stable skeleton of one run: all tests of a level use the adjacency from before it.

    Conditioning sets come from generators, so a level of a dense graph is asked in parts; the
    first set in order that separates a pair is its separating set, whatever the parts.
    """

    def __init__(self, names: Sequence[str], alpha: float, max_level: int | None = None):
        self.names, self.alpha, self.max_level = list(names), alpha, max_level
        self.adj = {a: set(names) - {a} for a in names}
        self.sepset: dict[tuple[str, str], set[str]] = {}
        self.open: dict[tuple[str, str], Iterator] = {}

    def start(self, level: int) -> bool:
        """Open the tests of a level; False if there is none."""
        if self.max_level is not None and level > self.max_level or all(len(n) <= level for n in self.adj.values()):
            return False
        for a in sorted(self.names):
            for b in sorted(x for x in self.adj[a] if x > a):
                sides = [combinations(sorted(self.adj[p] - {q}), level) for p, q in ((a, b), (b, a))]
                self.open[a, b] = (z for z, _ in groupby(merge(*sides)))
        return True

    def draw(self, each: int) -> list[Test]:
        """The next tests of every open pair, at most ``each``; exhausted pairs are closed."""
        out = []
        for pair in list(self.open):
            sets = list(islice(self.open[pair], each))
            out += [(*pair, z) for z in sets]
            if len(sets) < each:
                del self.open[pair]
        return out

    def learn(self, tests: Sequence[Test], p_values: Sequence[float]) -> None:
        """Separate pairs by the first of their tests, in order, with a p-value above alpha."""
        for (a, b, z), p in zip(tests, p_values):
            if p > self.alpha and (a, b) not in self.sepset:
                self.sepset[a, b] = set(z)
                self.open.pop((a, b), None)

    def finish(self) -> None:
        for a, b in self.sepset:
            self.adj[a].discard(b)
            self.adj[b].discard(a)


def _fold_codes(codes: DataFrame, names: Sequence[str], run: str) -> DataFrame:
    """Distinct coded rows of every run with their count ``n``, runs in neighbouring partitions.

    A run with many rows spreads over several partitions by its codes.
    """
    folded = codes.groupBy(run, *names).agg(F.count("*").alias("_n"))
    return cut_lineage(folded.repartitionByRange(run, *names).sortWithinPartitions(run))


def run_contingency(folded: DataFrame, names: Sequence[str], run: str, asked: Mapping[object, Sequence[Test]], low: Mapping[str, int], radix: Mapping[str, int]) -> DataFrame:
    """``(run, test, z, x, y, n)``: the tests that each run asks for, all runs in one job.

    ``test`` numbers the tests of a run. Tests over one set of columns share a count; a task
    holds the counts of the run that it reads and emits them when the next run begins. ``low``
    and ``radix`` are the lowest code and the number of codes of each column.
    """
    names = list(names)
    at = {c: i for i, c in enumerate(names)}
    base = np.array([low[c] for c in names], dtype="int64")
    plans = {}
    for r, tests in asked.items():
        by_set: dict[tuple, list] = {}
        for t, (x, y, z) in enumerate(tests):
            by_set.setdefault(tuple(sorted({x, y, *z})), []).append((t, x, y, z))
        plans[r] = by_set
    kind = dict(folded.dtypes)[run]

    def emit(r, held) -> pd.DataFrame:
        parts = []
        for s, (code, size) in held.items():
            digit = {c: code // w % radix[c] for c, w in zip(s, code_weights([radix[c] for c in s]))}
            for t, x, y, z in plans[r][s]:
                strata = sum((digit[c] * w for c, w in zip(z, code_weights([radix[c] for c in z]))), np.zeros(len(code), dtype="int64"))
                parts.append(np.stack([np.full(len(code), t), strata, digit[x] + low[x], digit[y] + low[y], size]))
        test, strata, x, y, n = np.concatenate(parts, axis=1)
        out = pd.DataFrame({"test": test.astype("int32"), "z": strata, "x": x.astype("int32"), "y": y.astype("int32"), "n": n})
        out.insert(0, run, r)
        return out

    def fold(batches):
        current, held = None, {}
        for pdf in batches:
            for r, part in pdf.groupby(run, sort=False, dropna=False):
                r = None if pd.isna(r) else r
                if r not in plans:
                    continue
                if held and r != current:
                    yield emit(current, held)
                    held = {}
                current = r
                codes, size = part[names].to_numpy(dtype="int64") - base, part["_n"].to_numpy()
                for s in plans[r]:
                    code = codes[:, [at[c] for c in s]] @ code_weights([radix[c] for c in s])
                    old = held.get(s, (np.zeros(0, "int64"), np.zeros(0, "int64")))
                    code, place = np.unique(np.concatenate([old[0], code]), return_inverse=True)
                    both = np.zeros(len(code), "int64")
                    np.add.at(both, place, np.concatenate([old[1], size]))
                    held[s] = code, both
        if held:
            yield emit(current, held)

    return folded.mapInPandas(fold, f"{run} {kind}, test int, z long, x int, y int, n long").groupBy(run, "test", "z", "x", "y").agg(F.sum("n").alias("n"))


def _p_values(folded, names, run, asked, low, radix) -> dict[object, list[float]]:
    """One job: a p-value for every test that a run asks; 1 where a test has no rows."""
    out = {r: [1.0] * len(tests) for r, tests in asked.items()}
    for row in chi_square(run_contingency(folded, names, run, asked, low, radix), [run]).collect():
        out[row[run]][row["test"]] = chi2_sf(row["stat"], row["dof"])
    return out


def pc_skeletons(
    codes: DataFrame, names: Sequence[str], run: str, levels: int = 3, alpha: float = 0.05, max_level: int | None = None, batch: int = 50_000,
) -> dict[object, SkeletonSearch]:
    """The skeleton of every run, searched in lockstep: one job answers the open tests of all runs.

    A level takes one job as long as all its tests number at most ``batch``, so there are as
    many jobs as the deepest run has levels; more tests are asked in parts, evenly over the
    open pairs, so the driver and a job never hold more. The result doesn't depend on ``batch``
    and equals that of every run alone. The driver keeps the graph of each run, tens of nodes.
    """
    folded = _fold_codes(codes, names, run)
    low, radix = code_ranges(folded, names, levels)
    searches = {r[0]: SkeletonSearch(names, alpha, max_level) for r in folded.select(run).distinct().collect()}
    level, active = 0, dict(searches)
    while active := {r: s for r, s in active.items() if s.start(level)}:
        while pairs := sum(len(s.open) for s in active.values()):
            asked, room = {}, batch
            for r, s in active.items():
                if s.open and room > 0:
                    asked[r] = s.draw(max(1, batch // pairs))
                    room -= len(asked[r])
            asked = {r: tests for r, tests in asked.items() if tests}
            for r, p in _p_values(folded, names, run, asked, low, radix).items() if asked else ():
                searches[r].learn(asked[r], p)
        for s in active.values():
            s.finish()
        level += 1
    return searches


def pc_orient(names, adj, sepset, forbidden) -> set[tuple[str, str]]:
    """Directed edges after background knowledge, v-structures and the propagation rules."""
    adj = {a: set(b) for a, b in adj.items()}
    for a, b in combinations(names, 2):
        if (a, b) in forbidden and (b, a) in forbidden:
            adj[a].discard(b)
            adj[b].discard(a)
    directed: set[tuple[str, str]] = set()

    def orient(a, b) -> bool:
        # An earlier orientation keeps priority.
        if b in adj[a] and (a, b) not in directed and (b, a) not in directed and (a, b) not in forbidden:
            directed.add((a, b))
            return True
        return False

    def undirected(a, b):
        return b in adj[a] and (a, b) not in directed and (b, a) not in directed

    for a in names:
        for b in names:
            if (a, b) in forbidden and b in adj[a]:
                orient(b, a)
    for c in names:
        for a, b in combinations(sorted(adj[c]), 2):
            if b not in adj[a]:
                key = tuple(sorted((a, b)))
                if c not in sepset.get(key, {c}):
                    orient(a, c)
                    orient(b, c)
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in sorted(adj[a]):
                if not undirected(a, b):
                    continue
                into_a = {x for x in adj[a] if (x, a) in directed}
                # Away from a collider, then from a cycle, then double triangle.
                if any(x not in adj[b] and x != b for x in into_a):
                    changed |= orient(a, b)
                elif any((a, x) in directed and (x, b) in directed for x in adj[a] & adj[b]):
                    changed |= orient(a, b)
                else:
                    sides = [x for x in adj[a] & adj[b] if undirected(a, x) and (x, b) in directed]
                    if any(y not in adj[x] for x, y in combinations(sides, 2)):
                        changed |= orient(a, b)
    return directed


_RUN = "_run"


def pc_by_run(
    codes: DataFrame, names: Sequence[str], run: str = "run_id", forbidden: set[tuple[str, str]] = frozenset(), levels: int = 3,
    alpha: float = 0.05, max_level: int | None = None, batch: int = 50_000,
) -> DataFrame:
    """PC on integer codes for every run at once: ``(run, src, dst, weight)``, directed edges of weight 1.

    Rows with a NULL run are one run. An empty table gives no edges.
    """
    found = pc_skeletons(codes, names, run, levels, alpha, max_level, batch)
    edges = [(r, a, b, 1.0) for r, s in found.items() for a, b in sorted(pc_orient(list(names), s.adj, s.sepset, forbidden))]
    return codes.sparkSession.createDataFrame(edges, f"{run} {dict(codes.dtypes)[run]}, src string, dst string, weight double")


def pc_skeleton_orient(
    codes: DataFrame, names: Sequence[str], forbidden: set[tuple[str, str]] = frozenset(), levels: int = 3,
    alpha: float = 0.05, run_id: str = "run", max_level: int | None = None,
) -> DataFrame:
    """PC on integer codes of one run: the directed edges, weight 1."""
    return pc_by_run(codes.withColumn(_RUN, F.lit(run_id)), names, _RUN, forbidden, levels, alpha, max_level).withColumnRenamed(_RUN, "run_id")


# Constants of the maximum-entropy approximation of differential entropy.
_K1, _K2, _GAMMA = 79.047, 7.4129, 0.37457


def _entropy(log_cosh: np.ndarray, gauss: np.ndarray) -> np.ndarray:
    return (1 + np.log(2 * np.pi)) / 2 - _K1 * (log_cosh - _GAMMA) ** 2 - _K2 * gauss**2


def entropy_terms(rows: DataFrame, names: Sequence[str], run: str, forms: Mapping[object, tuple[np.ndarray, np.ndarray]]) -> dict[object, np.ndarray]:
    """Means of log cosh u and u exp(-u^2/2) for standardised linear forms u = W x - offset of each run.

    One pass for all runs: a task adds up the rows of a run and emits one row per form.
    """
    names = list(names)
    kind = dict(rows.dtypes)[run]

    def emit(r, n, sums):
        out = pd.DataFrame({"form": np.arange(sums.shape[1], dtype="int32"), "n": n, "s1": sums[0], "s2": sums[1]})
        out.insert(0, run, r)
        return out

    def partial(batches):
        current, n, sums = None, 0, None
        for pdf in batches:
            for r, part in pdf.groupby(run, sort=False, dropna=False):
                r = None if pd.isna(r) else r
                if r not in forms:
                    continue
                if n and r != current:
                    yield emit(current, n, sums)
                    n = 0
                weights, offset = forms[r]
                if not n:
                    current, sums = r, np.zeros((2, len(weights)))
                u = part[names].to_numpy(dtype=float) @ weights.T - offset
                a = np.abs(u)
                n += len(u)
                sums[0] += (a + np.log1p(np.exp(-2 * a)) - np.log(2)).sum(axis=0)
                sums[1] += (u * np.exp(-u * u / 2)).sum(axis=0)
        if n:
            yield emit(current, n, sums)

    out = {r: np.zeros((2, len(w))) for r, (w, _) in forms.items()}
    summed = rows.mapInPandas(partial, f"{run} {kind}, form int, n long, s1 double, s2 double").groupBy(run, "form").agg(
        (F.sum("s1") / F.sum("n")).alias("a"), (F.sum("s2") / F.sum("n")).alias("b"))
    for row in summed.collect():
        out[row[run]][:, row["form"]] = row["a"], row["b"]
    return out


_NIL = 1e-10  # a residual's share of variance that counts as none


class CausalOrder:
    """Causal order of one run: repeatedly the variable most independent of its residuals.

    Residuals are linear forms of the original columns, so each step reads the table
    once with new coefficients; the plan does not grow.
    """

    def __init__(self, names: Sequence[str], forbidden, mean: np.ndarray, cov: np.ndarray):
        self.names, self.forbidden, self.mean, self.cov = list(names), forbidden, mean, cov
        self.left, self.order, self._forms = list(range(len(self.names))), [], np.eye(len(self.names))

    def forms(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Weights and offsets whose entropy decides the next variable; None when all are placed.

        Variables that the prior rules leave no choice about are placed on the way.
        """
        names, forbidden = self.names, self.forbidden
        while len(self.left) > 1:
            left = self.left
            free = [j for j in left if all((names[i], names[j]) in forbidden for i in left if i != j)]
            if not free:
                free = [j for j in left if not all((names[j], names[i]) in forbidden for i in left if i != j)] or left
            if len(free) > 1:
                c = self._forms @ self.cov @ self._forms.T
                self._free, self._pairs = free, [(i, j) for j in left for i in left if i != j and (i in free or j in free)]
                w = [self._standard(self._forms[i]) for i in left]
                w = np.array(w + [self._standard(self._forms[i] - self._slope(c, i, j) * self._forms[j]) for i, j in self._pairs])
                return w, w @ self.mean
            self._place(free[0])
        return None

    def learn(self, terms: np.ndarray) -> None:
        h, left = _entropy(*terms), self.left
        single, resid = dict(zip(left, h)), dict(zip(self._pairs, h[len(left) :]))

        def dependence(j):
            diffs = [single[i] + resid[(j, i)] - single[j] - resid[(i, j)] for i in left if i != j]
            return sum(min(0.0, d) ** 2 for d in diffs)

        self._place(min(self._free, key=lambda j: (dependence(j), j)))

    def _standard(self, form: np.ndarray) -> np.ndarray:
        """A form of variance 1, or 0 where rounding is all that is left of its variance."""
        variance, size = form @ self.cov @ form, (form * form) @ np.diag(self.cov)
        return form / np.sqrt(variance) if variance > _NIL * size else np.zeros_like(form)

    def _slope(self, c: np.ndarray, i: int, j: int) -> float:
        return c[i, j] / c[j, j] if c[j, j] > _NIL * ((self._forms[j] ** 2) @ np.diag(self.cov)) else 0.0

    def _place(self, best: int) -> None:
        c = self._forms @ self.cov @ self._forms.T
        self.order.append(best)
        self.left.remove(best)
        for i in self.left:
            self._forms[i] = self._forms[i] - self._slope(c, i, best) * self._forms[best]


def adaptive_lasso(cov: np.ndarray, target: int, predictors: list[int], n: float, steps: int = 60) -> np.ndarray:
    """Sparse weights of ``target`` on ``predictors`` from covariances; BIC picks the penalty."""
    if not predictors:
        return np.zeros(0)
    sd = np.sqrt(np.maximum(np.diag(cov)[predictors], 1e-300))
    g = cov[np.ix_(predictors, predictors)] / np.outer(sd, sd)
    b = cov[predictors, target] / sd
    var = cov[target, target]
    ols = np.linalg.lstsq(g, b, rcond=None)[0]
    scale = np.maximum(np.abs(ols), 1e-12)
    g, b = g * np.outer(scale, scale), b * scale
    top = np.abs(b).max()
    best, beta = (np.inf, np.zeros(len(b))), np.zeros(len(b))
    for lam in [*(top * np.logspace(0, -5, steps)), 0.0] if top > 0 else [0.0]:
        for _ in range(500):
            old = beta.copy()
            for i in range(len(b)):
                rho = b[i] - g[i] @ beta + g[i, i] * beta[i]
                beta[i] = np.sign(rho) * max(abs(rho) - lam, 0.0) / max(g[i, i], 1e-300)
            if np.abs(beta - old).max() < 1e-10:
                break
        rss = max(var - 2 * beta @ b + beta @ g @ beta, 1e-300)
        bic = n * np.log(rss) + np.log(n) * np.count_nonzero(beta)
        if bic < best[0]:
            best = (bic, beta.copy())
    return best[1] * scale / sd


def run_moments(rows: DataFrame, names: Sequence[str], run: str) -> dict[object, tuple[int, np.ndarray, np.ndarray]]:
    """Rows, means and covariances (by n) of every run; sums are taken about the run's first means."""
    names, p = list(names), len(names)
    center = {r[run]: np.array([r[f"m{i}"] for i in range(p)]) for r in rows.groupBy(run).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).collect()}
    kind, (i, j) = dict(rows.dtypes)[run], np.triu_indices(p + 1)

    def partial(batches):
        for pdf in batches:
            for r, part in pdf.groupby(run, sort=False, dropna=False):
                r = None if pd.isna(r) else r
                x = np.column_stack([np.ones(len(part)), part[names].to_numpy(dtype=float) - center[r]])
                out = pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "s": (x.T @ x)[i, j]})
                out.insert(0, run, r)
                yield out

    sums = {r: np.zeros((p + 1, p + 1)) for r in center}
    for row in rows.mapInPandas(partial, f"{run} {kind}, i int, j int, s double").groupBy(run, "i", "j").agg(F.sum("s").alias("s")).collect():
        sums[row[run]][row["i"], row["j"]] = sums[row[run]][row["j"], row["i"]] = row["s"]
    out = {}
    for r, g in sums.items():
        n, shift = g[0, 0], g[0, 1:] / g[0, 0]
        out[r] = int(n), center[r] + shift, g[1:, 1:] / n - np.outer(shift, shift)
    return out


def lingam_by_run(
    df: DataFrame, names: Sequence[str], run: str = "run_id", rules: Mapping[str, set[tuple[str, str]]] | None = None, batch: int = 200_000,
    spread: bool = True,
) -> DataFrame:
    """``(run, rule, src, dst, weight)``: linear non-Gaussian acyclic models of every run under every rule.

    ``rules`` names sets of forbidden ``(cause, effect)`` pairs. All runs and rules go in lockstep:
    one job per place of the causal order answers the entropies of all of them (several where
    they number more than ``batch`` forms). Rows with a missing or non-finite value are left out; rows with a
    NULL run are one run. ``spread`` writes the rows once, runs side by side and large runs
    over several partitions; without it the table is read as it is.
    """
    names, rules = list(names), rules if rules is not None else {"": set()}
    rows = df.select(run, *[finite_or_null(c).alias(c) for c in names]).dropna(subset=names)
    if spread:
        rows = cut_lineage(rows.repartitionByRange(run, *names).sortWithinPartitions(run))
    moments = run_moments(rows, names, run)
    orders = {(r, k): CausalOrder(names, rule, mean, cov) for r, (_, mean, cov) in moments.items() for k, rule in rules.items()}
    while asked := {key: f for key, o in orders.items() if (f := o.forms())}:
        keys = sorted(asked, key=lambda k: (str(k[0]), k[1]))
        for part in _parts(keys, [len(asked[k][0]) for k in keys], batch):
            by_run: dict[object, list] = {}
            for key in part:
                by_run.setdefault(key[0], []).append(key)
            forms = {r: tuple(np.concatenate(x) for x in zip(*[asked[k] for k in own])) for r, own in by_run.items()}
            found = entropy_terms(rows, names, run, forms)
            for r, own in by_run.items():
                for key, terms in zip(own, np.split(found[r], np.cumsum([len(asked[k][0]) for k in own])[:-1], axis=1)):
                    orders[key].learn(terms)
    out = []
    for (r, k), o in orders.items():
        n, _, cov = moments[r]
        order = o.order + o.left
        for at, j in enumerate(order):
            causes = [i for i in order[:at] if (names[i], names[j]) not in rules[k]]
            out += [(r, k, names[i], names[j], float(w)) for i, w in zip(causes, adaptive_lasso(cov, j, causes, n)) if w != 0]
    return df.sparkSession.createDataFrame(out, f"{run} {dict(df.dtypes)[run]}, rule string, src string, dst string, weight double")


def _parts(keys: Sequence, sizes: Sequence[int], most: int) -> Iterator[list]:
    """Consecutive keys whose sizes add up to at most ``most``, at least one each."""
    part, held = [], 0
    for key, size in zip(keys, sizes):
        if part and held + size > most:
            yield part
            part, held = [], 0
        part.append(key)
        held += size
    if part:
        yield part


def direct_lingam(
    df: DataFrame, names: Sequence[str], forbidden: set[tuple[str, str]] = frozenset(), run_id: str = "run"
) -> DataFrame:
    """Weighted edges of a linear non-Gaussian acyclic model that honours the prior rules."""
    found = lingam_by_run(df.withColumn(_RUN, F.lit(run_id)), names, _RUN, {"": forbidden}, spread=False)
    return found.select(F.col(_RUN).alias("run_id"), "src", "dst", "weight")
