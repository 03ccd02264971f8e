"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from faultline.functions import hist as hf
from faultline.registry.queries import (
    CAUSAL, CORE, DISC, MODULES, NUMERIC, PRUNED, SCALED, TESTS, THRESHOLD, WITH_GAPS,
)
from faultline.sources import fixtures as X


def r6(expr: str, alias: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {alias or expr}"


def cols(names) -> str:
    return ", ".join(names)


# --- shared table expressions --------------------------------------------------------

_LINE = ", ".join(
    [f"count(*) FILTER (WHERE floor((l_quantity - 1) / 5) = {i}) AS {c}" for i, c in enumerate(X.AG)]
    + [f"count(*) FILTER (WHERE round(l_discount * 100) = {i}) AS {c}" for i, c in enumerate(X.AY)]
    + [
        "max(l_tax) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS na_low",
        "max(l_tax) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 40) AS na_mid",
        "max(l_discount) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 47) AS na_high",
        "min(l_extendedprice) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O' AND l_quantity > 49) AS na_drop",
    ]
)
_ORDER = ", ".join(
    ["CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS aa_000"]
    + [f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in X.AG + X.AY]
    + [f"CAST(count(*) FILTER (WHERE month(o_orderdate) = {i + 1}) AS DOUBLE) AS {c}" for i, c in enumerate(X.CN)]
    + [f"CAST(count(*) FILTER (WHERE o_orderpriority LIKE '{i + 1}%') AS DOUBLE) AS {c}" for i, c in enumerate(X.BA)]
    + ["max(na_low) AS na_low", "max(na_mid) AS na_mid", "max(na_high) AS na_high", "min(na_drop) AS na_drop"]
)
CUST = f"""per_order AS (SELECT l_orderkey, {_LINE} FROM lineitem GROUP BY l_orderkey),
per_cust AS (SELECT o_custkey, {_ORDER} FROM orders LEFT JOIN per_order ON o_orderkey = l_orderkey GROUP BY o_custkey),
cust AS (SELECT c_custkey AS row_id, CAST(c_acctbal < 0 AS INT) AS label,
 {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in NUMERIC)}, {cols(X.GAPPY)}
 FROM customer LEFT JOIN per_cust ON c_custkey = o_custkey)"""
ITEM = f"""item AS (SELECT CAST(l_returnflag = 'R' AS INT) AS label, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in X.ITEM)} FROM lineitem)"""
DOCS = """docs AS (SELECT d.doc_id AS row_id, CAST(toxic AS INT) AS label,
 CASE WHEN toxic = 1 THEN sqrt(((d.doc_id * 7919) % 1009) / 1009.0::DOUBLE)
  ELSE (((d.doc_id * 7919) % 1009) / 1009.0::DOUBLE) * (((d.doc_id * 7919) % 1009) / 1009.0::DOUBLE) END AS prob,
 CAST(n_chars AS DOUBLE) AS n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_USER = ", ".join(
    [f"CAST(count(*) FILTER (WHERE hour(ts) = {i}) AS DOUBLE) AS {c}" for i, c in enumerate(X.HOURS)]
    + [f"CAST(count(*) FILTER (WHERE least(7, floor(value / 20)) = {i}) AS DOUBLE) AS {c}" for i, c in enumerate(X.VALUES)]
)
USER = f"""per_user AS (SELECT user_id, {_USER}, count(*) FILTER (WHERE event_type = 'error') / count(*) AS share FROM events GROUP BY user_id),
users AS (SELECT user_id AS row_id, CAST(share > (SELECT quantile_cont(share, 0.5) FROM per_user) AS INT) AS label,
 {cols(X.HOURS + X.VALUES)} FROM per_user)"""


def edges(name: str, salt: int) -> str:
    names = "['aa_000', 'f1', 'f2', 'f3', 'f4', 'f5', 'class']"
    return f"""{name}_c AS (SELECT run_id, src, dst, count(*) AS n FROM (
  SELECT CAST(c_nationkey AS BIGINT) AS run_id, {names}[1 + (o_orderkey * 3 + {salt}) % 7] AS src,
   {names}[CAST(1 + (floor(o_totalprice) + {salt}) % 7 AS INT)] AS dst
  FROM orders JOIN customer ON o_custkey = c_custkey) WHERE src <> dst GROUP BY ALL),
{name} AS (SELECT run_id, src, dst, CASE WHEN n % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END
  * (n - CAST(floor(top * 0.7::DOUBLE) AS BIGINT)) / top * 0.2::DOUBLE AS weight
 FROM (SELECT *, max(n) OVER (PARTITION BY run_id) AS top FROM {name}_c) WHERE n * 10 >= top * 7)"""


def long(src: str, names, ids: str = "label", where: str = "value IS NOT NULL") -> str:
    ids = ids + ", " if ids else ""
    parts = [f"SELECT {ids}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src}" for c in names]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {where}"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def running(src: str, names, label: str = "label") -> str:
    """Counts by (feature, value) with running counts and totals."""
    return f"""tall AS ({long(src, names, label)}),
cnt AS (SELECT feature, value, count(*) FILTER (WHERE {label} = 0) AS n0, count(*) FILTER (WHERE {label} = 1) AS n1
 FROM tall WHERE {label} IN (0, 1) GROUP BY feature, value),
run AS (SELECT *, sum(n0) OVER w AS c0, sum(n1) OVER w AS c1, sum(n0) OVER (PARTITION BY feature) AS t0,
 sum(n1) OVER (PARTITION BY feature) AS t1 FROM cnt
 WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING))"""


def ks(ties: bool = False) -> str:
    """Distances and p-values; the exact chance is a recursion over the pooled rows."""
    ends = ", list(c0 + c1) AS ends" if ties else ""
    checked = " AND list_contains(ends, s + 1)" if ties else ""
    carried = ", ends" if ties else ""
    return f"""ks AS (SELECT feature, max(CASE WHEN t0 > 0 AND t1 > 0 THEN abs(c1 / t1 - c0 / t0) END) AS stat, max(t0) AS n0, max(t1) AS n1,
 CAST(max(abs(c1 * t0 - c0 * t1)) AS BIGINT) AS gap{ends} FROM run GROUP BY feature),
ksx(feature, a, b, gap{carried}, s, u) USING KEY (feature) AS (
 SELECT feature, CAST(greatest(n0, n1) AS BIGINT), CAST(least(n0, n1) AS BIGINT), gap{carried}, CAST(0 AS BIGINT), list_transform(range(0, CAST(least(n0, n1) + 1 AS BIGINT)), lambda i: 0.0::DOUBLE)
 FROM ks WHERE stat IS NOT NULL AND greatest(n0, n1) <= 10000
 UNION SELECT feature, a, b, gap{carried}, s + 1, list_transform(range(0, b + 1), lambda i: CASE WHEN i > s + 1 OR s + 1 - i > a THEN 0.0::DOUBLE
  WHEN abs(i * (a + b) - (s + 1) * b) >= gap{checked} THEN 1.0::DOUBLE ELSE (i * coalesce(u[i], 0.0) + (s + 1 - i) * u[i + 1]) / (s + 1) END) FROM ksx WHERE s < a + b),
ksp AS (SELECT z.feature, stat, coalesce(ksx.u[ksx.b + 1], CASE WHEN stat IS NULL OR x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * (
 SELECT sum(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * x * x)) FROM range(1, 51) t(j)))) END) AS p_value, z.n0, z.n1
 FROM (SELECT *, stat * sqrt(CAST(n1 AS DOUBLE) * n0 / (n1 + n0)) AS x FROM ks) z LEFT JOIN ksx ON ksx.feature = z.feature)"""


KS = ks()


def _psi(x: str) -> str:
    z = f"({x} + 8.0::DOUBLE)"
    inv = f"(1.0 / ({z} * {z}))"
    terms = " + ".join(f"1.0 / ({x} + {i}.0::DOUBLE)" for i in range(8))
    return f"(ln({z}) - 0.5 / {z} - {inv} * (1.0 / 12 - {inv} * (1.0 / 120 - {inv} * (1.0 / 252 - {inv} * (1.0 / 240 - {inv} / 132)))) - ({terms}))"


def _near(k: int) -> str:
    return ", ".join(f"{{'d': abs({f}(value, {i}) OVER w - value), 'n': {f}(n, {i}) OVER w, 'v': {f}(value, {i}) OVER w}}" for i in range(1, k + 1) for f in ("lag", "lead"))


# Nearest-neighbour mutual information: counts in the interval of each row's third neighbour.
MI = f"""nn0 AS ({" UNION ALL ".join(f"SELECT feature, value, {c} AS cls, CAST(n{c} AS BIGINT) AS n, CAST(t{c} AS BIGINT) AS total FROM run WHERE n{c} > 0 AND t{c} > 1" for c in (0, 1))}),
nn1 AS (SELECT *, list_sort(list_filter([{{'d': 0.0::DOUBLE, 'n': n - 1, 'v': value}}, {_near(3)}], lambda e: e.d IS NOT NULL)) AS around FROM nn0 WINDOW w AS (PARTITION BY feature, cls ORDER BY value)),
nn2 AS (SELECT feature, value, cls, n, total, around[list_filter(range(1, len(around) + 1), lambda i: list_sum(list_transform(around[1:i], lambda e: e.n)) >= least(3, total - 1))[1]] AS r FROM nn1),
nn3 AS (SELECT *, least(value - r.d, r.v) AS low, greatest(value + r.d, r.v) AS high FROM nn2),
nn4 AS (SELECT q.*, b.c0 - coalesce(a.c0, 0) AS k0, b.c1 - coalesce(a.c1, 0) AS k1 FROM nn3 q ASOF JOIN run b ON q.feature = b.feature AND q.high >= b.value
 ASOF LEFT JOIN run a ON q.feature = a.feature AND q.low > a.value),
mi AS (SELECT feature, greatest(0.0, {_psi('CAST(sum(n) AS DOUBLE)')} + sum(n * ({_psi('(CASE WHEN cls = 1 THEN k1 ELSE k0 END - 1)')} - {_psi('(k0 + k1 - 1)')} - {_psi('total')})) / sum(n)) AS mi FROM nn4 GROUP BY feature)"""
KW = """kw0 AS (SELECT feature, t0, t1, n0, n1, CAST(n0 + n1 AS DOUBLE) AS t, c0 + c1 - (CAST(n0 + n1 AS DOUBLE) - 1) / 2 AS rk FROM run),
kw1 AS (SELECT feature, max(t0) AS n0, max(t1) AS n1, CAST(max(t0 + t1) AS DOUBLE) AS n, sum(n0 * rk) AS r0, sum(n1 * rk) AS r1,
 sum(t * t * t - t) AS ties FROM kw0 GROUP BY feature),
kw AS (SELECT feature, n0, n1, n, r0, r1, CASE WHEN n0 > 0 AND n1 > 0 AND 1 - ties / (n * n * n - n) > 0 THEN
 (12.0 / (n * (n + 1)) * (r0 * r0 / n0 + r1 * r1 / n1) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) END AS stat FROM kw1)"""
MI_BINNED = """mib AS (SELECT *, ntile(10) OVER (PARTITION BY feature ORDER BY value) AS b FROM run),
mic AS (SELECT feature, b, sum(n0) AS n0, sum(n1) AS n1, CAST(max(t0) AS DOUBLE) AS t0, CAST(max(t1) AS DOUBLE) AS t1 FROM mib GROUP BY feature, b),
mi AS (SELECT feature, sum(CASE WHEN n0 > 0 THEN n0 / (t0 + t1) * ln((n0 / (t0 + t1)) / (((n0 + n1) / (t0 + t1)) * (t0 / (t0 + t1)))) ELSE 0 END
 + CASE WHEN n1 > 0 THEN n1 / (t0 + t1) * ln((n1 / (t0 + t1)) / (((n0 + n1) / (t0 + t1)) * (t1 / (t0 + t1)))) ELSE 0 END) AS mi
 FROM mic GROUP BY feature)"""


def engineered(src: str, families: dict, keep: str = "row_id, label", mileage: str | None = "aa_000") -> str:
    """Staged projections with the arithmetic of the pinned definitions, as CTEs e0..e5."""
    add = " + ".join
    carry = keep + (f", {mileage}" if mileage and mileage not in keep else "")
    fam = families.items()
    e0 = ", ".join(f"{add(f'coalesce({c}, 0.0)' for c in b)} AS {f}_sum" for f, b in fam)
    e1 = ", ".join(f"coalesce({c}, 0.0) / ({f}_sum + 1e-9::DOUBLE) AS p_{f}_{i}" for f, b in fam for i, c in enumerate(b))
    sums = ", ".join(f"{f}_sum" for f, _ in fam)
    p = {f: [f"p_{f}_{i}" for i in range(len(b))] for f, b in fam}
    e2 = ", ".join(f"{add(f'{v} * {float(i)}::DOUBLE' for i, v in enumerate(p[f]))} AS {f}_center_mass" for f, _ in fam)
    e3 = ", ".join(
        f"sqrt(greatest(0.0::DOUBLE, ({add(f'{v} * {float(i * i)}::DOUBLE' for i, v in enumerate(p[f]))}) - {f}_center_mass * {f}_center_mass)) AS sd_{f}"
        for f, _ in fam
    )
    e4 = []
    for f, b in fam:
        n, mu = len(b), f"{f}_center_mass"
        dev = lambda i: f"({float(i)}::DOUBLE - {mu})"
        m3 = add(f"{v} * ({dev(i)} * {dev(i)} * {dev(i)})" for i, v in enumerate(p[f]))
        m4 = add(f"{v} * ({dev(i)} * {dev(i)} * {dev(i)} * {dev(i)})" for i, v in enumerate(p[f]))
        ent = add(f"{v} * ln(greatest(least({v}, 1.0::DOUBLE), 1e-12::DOUBLE))" for v in p[f])
        pad = ["-1.0", *p[f], "-1.0"]
        peaks = add(f"CAST({pad[i]} > {pad[i - 1]} AND {pad[i]} > {pad[i + 1]} AS DOUBLE)" for i in range(1, n + 1))
        e4 += [
            f"-({ent}) / ln({float(n)}::DOUBLE) AS {f}_entropy",
            f"CASE WHEN sd_{f} > 1e-6::DOUBLE THEN ({m3}) / (sd_{f} * sd_{f} * sd_{f}) ELSE 0.0 END AS {f}_skew",
            f"CASE WHEN sd_{f} > 1e-6::DOUBLE THEN ({m4}) / (sd_{f} * sd_{f} * sd_{f} * sd_{f}) - 3.0 ELSE 0.0 END AS {f}_kurt",
            f"{peaks} AS {f}_peaks",
        ]
        kind = hf.intensity_name(f)
        if kind:
            at = (lambda i: i) if kind == "DCI" else (lambda i: n - 1 - i)
            e4.append(f"{add(f'{v} * {float(at(i) ** 2)}::DOUBLE' for i, v in enumerate(p[f]))} AS {f}_{kind}")
    e5 = []
    for f, _ in fam:
        e5.append(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({f}_skew * {f}_skew + 1.0) / ({f}_kurt + 3.0 + 1e-9::DOUBLE))) AS {f}_bimodality")
        kind = hf.intensity_name(f)
        if kind and mileage:
            e5.append(f"{f}_{kind} / ({mileage} + 1e-3::DOUBLE) AS {f}_stress_slope")
    bins = cols(c for _, b in fam for c in b)
    return f"""e0 AS (SELECT {carry}, {bins}, {e0} FROM {src}),
e1 AS (SELECT {carry}, {sums}, {e1} FROM e0), e2 AS (SELECT *, {e2} FROM e1), e3 AS (SELECT *, {e3} FROM e2),
e4 AS (SELECT *, {", ".join(e4)} FROM e3), eng AS (SELECT *, {", ".join(e5)} FROM e4)"""


def engineered_names(families: dict, mileage: bool = True) -> list[str]:
    out = []
    for f in families:
        kind = hf.intensity_name(f)
        out += [f"{f}_{s}" for s in ("sum", "center_mass", "entropy", "skew", "kurt", "peaks", "bimodality")]
        out += [f"{f}_{kind}"] if kind else []
        out += [f"{f}_stress_slope"] if kind and mileage else []
    return out


ENG = engineered("cust", X.FAMILIES)


def _hist(*suffixes: str) -> str:
    names = [n for n in engineered_names(X.FAMILIES) if n.endswith(suffixes)]
    return with_(CUST, ENG) + f"SELECT row_id, {', '.join(r6(n) for n in names)} FROM eng"


def rank_corr(a: str, b: str) -> str:
    return f"corr({a}, {b})"


def avg_rank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


def quartile_sql(src: str, names, label: str = "label") -> str:
    return f"""tall AS ({long(src, names, label)}),
d AS (SELECT feature, {label}, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS mn,
 quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS mx
 FROM tall GROUP BY feature, {label})"""


def reference_share(f: str, c: str) -> str:
    total = " + ".join(f"sum({x})" for x in X.FAMILIES[f])
    return f"(SELECT sum({c}) / ({total}) FROM cust WHERE label = 0)"


def wasserstein(f: str, ref_src: str = "refs") -> str:
    bins = X.FAMILIES[f]
    total = " + ".join(f"({c} + 1e-9::DOUBLE)" for c in bins)
    ref_total = " + ".join(f"ref_{c}" for c in bins)
    terms = []
    for i in range(1, len(bins)):
        q = " + ".join(f"({c} + 1e-9::DOUBLE)" for c in bins[:i])
        r = " + ".join(f"ref_{c}" for c in bins[:i])
        terms.append(f"abs(({q}) / ({total}) - ({r}) / ({ref_total}))")
    return " + ".join(terms)


REFS = "refs AS (SELECT " + ", ".join(
    f"sum({c}) / sum({' + '.join(b)}) AS ref_{c}" for b in X.FAMILIES.values() for c in b
) + " FROM cust WHERE label = 0)"

CURVE = """sc AS (SELECT prob, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM {src} WHERE label IN (0, 1) GROUP BY prob),
tot AS (SELECT sum(n0) AS t0, sum(n1) AS t1 FROM sc),
pts AS (SELECT prob AS threshold, n0, n1, {obs} AS pt FROM sc {grid}),
mrg AS (SELECT threshold, sum(n0) AS n0, sum(n1) AS n1, max(pt) AS pt FROM pts GROUP BY threshold),
cum AS (SELECT *, sum(n0) OVER w AS fp, sum(n1) OVER w AS tp FROM mrg WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT threshold, CAST(fp AS BIGINT) AS fp, CAST(t1 - tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, t0, t1,
 CAST(10.0 * fp + 500.0 * (t1 - tp) AS DOUBLE) AS cost FROM cum, tot WHERE pt = 1)"""
GRID_TUNE = "UNION ALL SELECT i * (0.4::DOUBLE / 4001), 0, 0, 1 FROM range(4002) t(i)"
GRID_DENSE = "UNION ALL SELECT CASE WHEN i <= 100 THEN i / 1000.0::DOUBLE ELSE (i - 90) / 100.0::DOUBLE END, 0, 0, 1 FROM range(190) t(i)"


def curve(src: str = "docs", grid: str | None = None) -> str:
    return CURVE.format(src=src, grid=grid or "", obs=0 if grid else 1)


CURVE_COLS = f"{r6('threshold', digits=9)}, fp, fn, cost"
CONF = f"""conf AS (SELECT count(*) FILTER (WHERE label = 0 AND prob < {THRESHOLD}) AS tn, count(*) FILTER (WHERE label = 0 AND prob >= {THRESHOLD}) AS fp,
 count(*) FILTER (WHERE label = 1 AND prob < {THRESHOLD}) AS fn, count(*) FILTER (WHERE label = 1 AND prob >= {THRESHOLD}) AS tp FROM docs WHERE label IN (0, 1))"""
AUC = """rk AS (SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS r FROM docs WHERE label IN (0, 1)),
au AS (SELECT (sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
 / (count(*) FILTER (WHERE label = 1) * CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE)) AS auc FROM rk)"""
METRICS = f"""{CONF}, {AUC},
met AS (SELECT auc, ((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END)
 + (CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END)) / 2 AS macro_f1,
 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
 fp, fn, CAST(10 * fp + 500 * fn AS DOUBLE) AS cost, {THRESHOLD}::DOUBLE AS threshold FROM conf, au)"""

SCORED = """sd AS (SELECT row_id, label, n_chars AS score, CAST(n_chars > (SELECT quantile_cont(n_chars, 0.98) FROM docs) AS INT) AS is_outlier FROM docs),
scored AS (SELECT *, CAST(is_outlier = 0 OR coalesce(label = 1, FALSE) AS INT) AS keep FROM sd)"""


def code(c: str) -> str:
    """Quantile code of a column with more than three values."""
    q = lambda p: f"(SELECT quantile_cont({c}, {p}::DOUBLE) FROM cust)"
    lo, hi, a, b = q(0), q(1), q(repr(1 / 3)), q(repr(2 / 3))
    return (
        f"coalesce(CAST({c} > {a} AND {a} > {lo} AND {a} < {hi} AS INT) + "
        f"CAST({c} > {b} AND {b} <> {a} AND {b} > {lo} AND {b} < {hi} AS INT), 0)"
    )


CODES = f"codes AS (SELECT row_id, label AS class, {', '.join(f'{code(c)} AS {c}' for c in CAUSAL)} FROM cust)"


def contingency(by: str = "") -> str:
    parts = []
    for t, (x, y, z) in enumerate(TESTS if not by else TESTS[:3]):
        key = " + ".join(f"CAST({c} AS BIGINT) * {3**k}" for k, c in enumerate(z)) or "CAST(0 AS BIGINT)"
        parts.append(
            f"SELECT {by}CAST({t} AS INT) AS test, {key} AS z, CAST({x} AS INT) AS x, CAST({y} AS INT) AS y, count(*) AS n FROM codes_x GROUP BY ALL"
        )
    return " UNION ALL ".join(parts)


CHI = f"""cells AS ({contingency()}),
mar AS (SELECT *, sum(n) OVER (PARTITION BY test, z, x) AS nx, sum(n) OVER (PARTITION BY test, z, y) AS ny, sum(n) OVER (PARTITION BY test, z) AS nz FROM cells),
str AS (SELECT test, z, sum(CAST(n AS DOUBLE) * n * nz / (CAST(nx AS DOUBLE) * ny)) - max(nz) AS stat, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS dof FROM mar GROUP BY test, z),
chi AS (SELECT test, sum(stat) AS stat, CAST(sum(dof) AS INT) AS dof FROM str GROUP BY test)"""

GROUPS = f"""{edges('lin', 1)},
groups AS (SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY feature) AS INT) AS position, feature,
 CASE WHEN n >= 3 THEN 'Global' WHEN n = 2 THEN 'Secondary' ELSE 'Diagnostic' END AS feature_group
 FROM (SELECT run_id, src AS feature, count(*) AS n FROM lin GROUP BY run_id, src))"""
CLEAN = """clean AS (SELECT DISTINCT run_id, CASE WHEN src = 'class' THEN dst WHEN dst = 'aa_000' THEN 'aa_000' ELSE src END AS src,
 CASE WHEN src = 'class' THEN 'class' WHEN dst = 'aa_000' THEN src ELSE dst END AS dst FROM lin
 WHERE abs(weight) >= 0.01 AND NOT (src = 'class' AND dst = 'aa_000') AND NOT (src = 'aa_000' AND dst = 'class'))"""
HYB = f"""{edges('pcx', 5)},
pcn AS (SELECT run_id, src, dst, row_number() OVER (PARTITION BY run_id, least(src, dst), greatest(src, dst) ORDER BY src, dst) AS r FROM pcx p
 WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.run_id = p.run_id AND least(c.src, c.dst) = least(p.src, p.dst) AND greatest(c.src, c.dst) = greatest(p.src, p.dst))),
pc1 AS (SELECT run_id, CASE WHEN dst = 'aa_000' THEN dst ELSE src END AS src, CASE WHEN dst = 'aa_000' THEN src ELSE dst END AS dst FROM pcn WHERE r = 1),
hyb AS (SELECT run_id, src, dst, 'LiNGAM' AS type, 2 AS weight FROM clean UNION ALL
 SELECT run_id, CASE WHEN src = 'class' THEN dst ELSE src END, CASE WHEN src = 'class' THEN src ELSE dst END, 'PC_Rescue', 1 FROM pc1)"""


def reach(src: str) -> str:
    return f"""walk(run_id, node, hops) AS (SELECT DISTINCT run_id, 'class', 0 FROM {src}
 UNION SELECT e.run_id, e.src, w.hops + 1 FROM walk w JOIN {src} e ON e.run_id = w.run_id AND e.dst = w.node WHERE w.hops < 7 AND e.src <> 'class'),
dist AS (SELECT run_id, node, min(hops) AS hops FROM walk GROUP BY run_id, node),
nodes AS (SELECT run_id, src AS node FROM {src} UNION SELECT run_id, dst FROM {src})"""


def md5_rank(by: str = "label") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY md5('42:' || row_id), row_id)"


EDGE_BASE = with_(edges("lin", 1), CLEAN)


def smote(names, ratio: float, k: int = 5, seed: int = 42) -> str:
    """CTEs up to ``grown``: the customers and the rows made between minority neighbours, all pairs compared."""
    uniform = lambda tag: f"CAST('0x' || substr(md5('{seed}{tag}:' || d.id || ':' || d.copy), 1, 13) AS BIGINT) / 4503599627370496.0"
    made = ", ".join(f"d.{c} + {uniform('u')} * (o.{c} - d.{c}) AS {c}" for c in names)
    return f"""mino AS (SELECT row_id AS id, {cols(names)} FROM cust WHERE label = 1),
sz AS (SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1, CAST(floor(count(*) FILTER (WHERE label = 0) * {ratio}::DOUBLE - count(*) FILTER (WHERE label = 1)) AS BIGINT) AS extra FROM cust),
{neighbours("mino", names, k, "mn")},
mr AS (SELECT m.*, row_number() OVER (ORDER BY md5('{seed}:' || id), id) AS rank, n1, extra FROM mino m, sz WHERE extra > 0 AND n1 > 1),
md AS (SELECT *, unnest(range(1, extra // n1 + CAST(rank <= extra % n1 AS BIGINT) + 1)) AS copy FROM mr),
mp AS (SELECT d.*, CAST(floor({uniform("n")} * least({k}, n1 - 1)) AS BIGINT) + 1 AS pick FROM md d),
grown AS (SELECT row_id, label, {cols(names)} FROM cust UNION ALL SELECT -(d.copy * d.n1 + d.rank), 1, {made} FROM mp d JOIN mn n ON n.id = d.id AND n.nn = d.pick JOIN mino o ON o.id = n.nbr)"""


def neighbours(src: str, names, k: int, name: str) -> str:
    """``name``: (id, nbr, nn) of the k nearest other rows, squares summed in the order of the columns."""
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in names)
    return f"""{name} AS (SELECT id, nbr, row_number() OVER (PARTITION BY id ORDER BY d2, nbr) AS nn FROM (SELECT a.id, b.id AS nbr, {d2} AS d2 FROM {src} a JOIN {src} b ON a.id <> b.id)
 QUALIFY nn <= {k})"""


def logits(features, control: str | None = "aa_000") -> str:
    """Newton steps of all models at once, as a recursion; standardised columns of the customers."""
    scaled = lambda c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"
    age = scaled(control) if control else "0.0::DOUBLE"
    tall = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST(label AS DOUBLE) AS y, {age} AS a, {scaled(f)} AS x FROM cust" for f in features)
    # Without a control its row and column of the information are those of the identity.
    h11 = "sum(w * a * a)" if control else "1.0::DOUBLE"
    return with_(CUST, f"zt AS MATERIALIZED ({tall})") + f""", nw AS (SELECT DISTINCT feature, 0 AS it, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS var FROM zt
 UNION ALL SELECT feature, it + 1, b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det, b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det, c22 / det
 FROM (SELECT *, h00 * c00 + h01 * c01 + h02 * c02 AS det FROM (SELECT *, h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02,
  h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22 FROM (SELECT feature, it, b0, b1, b2, sum(y - p) AS g0, sum((y - p) * a) AS g1,
  sum((y - p) * x) AS g2, sum(w) AS h00, sum(w * a) AS h01, sum(w * x) AS h02, {h11} AS h11, sum(w * a * x) AS h12, sum(w * x * x) AS h22
  FROM (SELECT *, p * (1 - p) AS w FROM (SELECT n.*, z.y, z.a, z.x, 1 / (1 + exp(-(b0 + b1 * z.a + b2 * z.x))) AS p FROM nw n JOIN zt z ON n.feature = z.feature WHERE it < 12))
  GROUP BY feature, it, b0, b1, b2)))),
fit AS (SELECT *, sqrt(var) AS se, abs(b2 / sqrt(var)) / sqrt(2.0) AS t FROM nw WHERE it = 12),
ps AS (SELECT *, CASE WHEN t > 5 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(greatest(t, 1e-300)) - lgamma(k + 1.0) - ln(2 * k + 1.0)))) END AS pv FROM fit)
SELECT feature, {r6('b2', 'coef')}, {r6('exp(b2)', 'odds_ratio')}, {r6('pv', 'p_value')}, {r6('b2 - 1.959963984540054 * se', 'lower_ci')}, {r6('b2 + 1.959963984540054 * se', 'upper_ci')},
 {r6('b1', 'age_coef')}, TRUE AS converged FROM ps"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    c = with_(CUST)
    o["ingest_labelled_csv"] = c + f"SELECT label, aa_000, {cols(X.AG)}, {cols(X.GAPPY)} FROM cust"
    o["label_audit"] = with_(DOCS) + "SELECT label, count(*) AS n_rows FROM docs GROUP BY label"
    ks_item = with_(ITEM, running("item", X.ITEM), KS)
    o["write_results"] = ks_item + f"SELECT run_name, feature, {r6('stat')} FROM ksp, (VALUES ('run_a'), ('run_b')) t(run_name)"
    o["consolidate_runs"] = with_(edges("lin", 1), CLEAN, HYB) + """
SELECT 'LiNGAM' AS Algo, src AS Source, dst AS Target, run_id, NULL::VARCHAR AS Type, 'EXP_FFF' AS Experiment, 'Standard' AS Graph_Type FROM lin
UNION ALL SELECT 'LiNGAM', src, dst, run_id, NULL, 'EXP_TTT', 'Standard' FROM clean
UNION ALL SELECT 'Hybrid', src, dst, run_id, type, 'EXP_TTT', 'Hybrid' FROM hyb"""
    o["write_reports"] = with_(DOCS, METRICS) + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {r6(f'CAST({m} AS DOUBLE)', 'value')} FROM met"
        for m in ("auc", "macro_f1", "recall", "precision", "fp", "fn", "cost", "threshold")
    )
    tall_null = f"tall AS ({long('cust', WITH_GAPS, '', 'TRUE')})"
    prof = "prof AS (SELECT feature, count(*) AS n_rows, avg(CAST(value IS NULL AS DOUBLE)) AS na_share, count(DISTINCT value) AS n_distinct FROM tall GROUP BY feature)"
    o["profile_columns"] = with_(CUST, tall_null, prof) + f"SELECT feature, n_rows, {r6('na_share')}, n_distinct FROM prof"
    o["drop_sparse_constant"] = c + f"SELECT row_id, {cols(x for x in WITH_GAPS if x != 'na_drop')} FROM cust"
    o["na_strategy"] = with_(CUST, tall_null, prof) + f"""SELECT feature, {r6('na_share')}, CASE WHEN na_share = 0 THEN 'none' WHEN na_share <= 0.15 THEN 'median'
 ELSE 'iterative' END AS strategy FROM prof WHERE na_share <= 0.7 AND n_distinct <> 1"""
    share = lambda x: f"(SELECT avg(CAST({x} IS NULL AS DOUBLE)) FROM cust)"
    o["drop_incomplete_rows"] = c + f"SELECT row_id, {cols(X.GAPPY)} FROM cust WHERE " + " AND ".join(
        f"NOT ({x} IS NULL AND {share(x)} <= 0.04)" for x in X.GAPPY
    )
    o["project_selected"] = c + "SELECT row_id, label, ag_001, aa_000 FROM cust"
    o["complete_filter_inf"] = c + f"""SELECT row_id, 'ratio' AS feature, {r6('ag_002 / ag_000', 'value')} FROM cust WHERE ag_000 <> 0 AND ag_001 <> 0
UNION ALL SELECT row_id, 'na_mid', {r6('na_mid', 'value')} FROM cust WHERE na_mid IS NOT NULL"""
    o["subset_by_class"] = c + "SELECT row_id, label, aa_000 FROM cust WHERE label = 1"
    o["filter_redundant_globals"] = with_(GROUPS) + """SELECT run_id, position, feature, feature_group FROM (SELECT *, row_number() OVER (PARTITION BY run_id, feature_group
 ORDER BY CASE feature WHEN 'aa_000' THEN 0 WHEN 'ci_000' THEN 1 ELSE 2 END, position) AS r FROM groups) WHERE feature_group <> 'Global' OR r = 1"""
    o["high_risk_rows"] = with_(DOCS) + f"SELECT row_id, {r6('prob')} FROM docs WHERE prob >= 0.5 ORDER BY docs.prob DESC, row_id LIMIT 20"
    o["split_column_roles"] = c + " UNION ALL ".join(
        [f"SELECT '{x}' AS feature, '{f}' AS family, 'histogram' AS role, count({x}) AS n_present FROM cust" for f, b in X.FAMILIES.items() for x in b]
        + [f"SELECT '{x}', NULL, 'numeric', count({x}) FROM cust" for x in ("aa_000", *X.GAPPY)]
        + [f"SELECT '{x}_is_missing', NULL, 'flag', count(*) FROM cust" for x in X.GAPPY]
    )
    # missing values
    o["missing_flags"] = c + "SELECT row_id, " + ", ".join(f"CAST({x} IS NULL AS INT) AS {x}_is_missing" for x in X.GAPPY) + " FROM cust"
    med = lambda x: f"coalesce({x}, (SELECT quantile_cont({x}, 0.5) FROM cust))"
    o["median_impute"] = c + f"SELECT row_id, {r6(med('na_low'), 'na_low')} FROM cust"
    o["fallback_impute"] = o["median_fill_for_test"] = c + "SELECT row_id, " + ", ".join(r6(med(x), x) for x in X.GAPPY) + " FROM cust"
    o["zero_fill"] = c + "SELECT row_id, " + ", ".join(f"coalesce({x}, 0.0) AS {x}" for x in X.GAPPY) + " FROM cust"
    o["mice_first_step"] = c + f""", f AS (SELECT na_mid AS y, coalesce(na_high, (SELECT avg(na_high) FROM cust)) AS x FROM cust WHERE na_mid IS NOT NULL),
s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS cxy FROM f),
b AS (SELECT n, mx, my, (n * cxy / sqrt(vx)) / (n + 10.0) / sqrt(vx) AS slope FROM s)
SELECT n, {r6('my - slope * mx', 'intercept', 8)}, {r6('slope', digits=8)} FROM b"""
    # Two columns: a round is two regressions on one predictor, over windows of the whole table.
    ridge = lambda y, x, g: f"covar_pop({y}, {x}) FILTER (WHERE NOT {g}) OVER () / var_pop({x}) FILTER (WHERE NOT {g}) OVER () * (count(*) FILTER (WHERE NOT {g}) OVER ()) / ((count(*) FILTER (WHERE NOT {g}) OVER ()) + 10.0)"
    filled = lambda y, x, g: f"CASE WHEN {g} THEN greatest(0.0, avg({y}) FILTER (WHERE NOT {g}) OVER () + ({ridge(y, x, g)}) * ({x} - avg({x}) FILTER (WHERE NOT {g}) OVER ())) ELSE {y} END"
    fewer = "(SELECT count(na_mid) >= count(na_high) FROM cust)"
    o["mice_impute"] = with_(CUST, f"""src AS (SELECT row_id, CASE WHEN {fewer} THEN na_mid ELSE na_high END AS a, CASE WHEN {fewer} THEN na_high ELSE na_mid END AS b FROM cust),
top AS (SELECT max(greatest(abs(coalesce(a, 0.0)), abs(coalesce(b, 0.0)))) AS top FROM src),
mice AS (SELECT 0 AS it, row_id, a IS NULL AS ga, b IS NULL AS gb, coalesce(a, avg(a) OVER ()) AS a, coalesce(b, avg(b) OVER ()) AS b, NULL::DOUBLE AS change FROM src
 UNION ALL SELECT it + 1, row_id, ga, gb, a2, b2, max(abs(a2 - a) + abs(b2 - b)) OVER () FROM (SELECT *, {filled("b", "a2", "gb")} AS b2 FROM (SELECT *, {filled("a", "b", "ga")} AS a2
  FROM mice WHERE it < 1000 AND (change IS NULL OR change >= 1e-3 * (SELECT top FROM top)))))""") + f"""SELECT row_id, {r6(f'CASE WHEN {fewer} THEN a ELSE b END', 'na_mid')}, {r6(f'CASE WHEN {fewer} THEN b ELSE a END', 'na_high')}
FROM mice WHERE it = (SELECT max(it) FROM mice)"""
    flag = lambda x: f"CAST({x} IS NULL AS DOUBLE)"
    o["missingness_correlation"] = c + " UNION ALL ".join(
        f"SELECT '{a}_is_missing' AS a, '{b}_is_missing' AS b, round(r, 6) + 0.0 AS r, round(greatest(0.0, 1.0 - r), 6) + 0.0 AS distance FROM (SELECT CASE WHEN isnan(k) OR k IS NULL THEN 0.0 ELSE abs(k) END AS r FROM (SELECT corr({flag(a)}, {flag(b)}) AS k FROM cust))"
        for a in X.GAPPY for b in X.GAPPY
    )
    o["module_connectivity"] = c + "SELECT row_id, " + ", ".join(
        f"CAST({' OR '.join(f'{x} IS NULL' for x in m)} AS INT) AS Module_{i}_Connectivity" for i, m in MODULES.items()
    ) + " FROM cust"
    o["hardware_fingerprint"] = with_(edges("lin", 1)) + "SELECT src AS feature, " + ", ".join(
        f"CAST(max(CAST(run_id = {i} AS INT)) AS INT) AS m{i}" for i in range(25)
    ) + " FROM lin GROUP BY src"
    # histograms
    for name, suffixes in {
        "hist_sum": ("_sum",), "hist_center_mass": ("_center_mass",), "hist_entropy": ("_entropy",), "hist_skew": ("_skew",),
        "hist_kurt": ("_kurt",), "hist_bimodality": ("_bimodality",), "hist_peaks": ("_peaks",), "hist_intensity": ("_DCI", "_LLI"),
        "hist_stress_slope": ("_stress_slope",),
    }.items():
        o[name] = _hist(*suffixes)
    o["hist_pmf"] = with_(CUST, ENG) + "SELECT row_id, " + ", ".join(r6(f"p_ag_{i}", f"p_{i}") for i in range(10)) + " FROM eng"
    fam_u = {"hr": X.HOURS, "val": X.VALUES}
    o["engineer_histograms"] = with_(USER, engineered("users", fam_u, mileage=None)) + "SELECT row_id, label, " + ", ".join(
        r6(n) for n in engineered_names(fam_u, False)
    ) + " FROM eng"

    def collapsed(fams):
        add = " + ".join
        out = [f"{add(b)} AS {f}_sum" for f, b in fams.items()]
        s1 = f"k1 AS (SELECT *, {', '.join(out)} FROM cust)"
        pr = lambda f, x: f"(CASE WHEN {f}_sum > 0 THEN {x} / {f}_sum ELSE 0 END)"
        mu = ", ".join(f"{add(f'{pr(f, x)} * {i}' for i, x in enumerate(b))} AS {f}_mean" for f, b in fams.items())
        va = ", ".join(f"greatest(0.0, {add(f'{pr(f, x)} * {i * i}' for i, x in enumerate(b))} - {f}_mean * {f}_mean) AS {f}_var" for f, b in fams.items())
        return f"{s1}, k2 AS (SELECT *, {mu} FROM k1), k3 AS (SELECT *, {va} FROM k2)"

    o["collapse_histograms"] = with_(CUST, collapsed({"ag": X.AG, "ba": X.BA})) + "SELECT row_id, " + ", ".join(
        r6(f"{f}_{s}") for f in ("ag", "ba") for s in ("sum", "mean", "var")
    ) + " FROM k3"
    o["log1p_sums_vars"] = with_(CUST, collapsed({"ag": X.AG})) + f"SELECT row_id, {r6('ln(1 + ag_sum)', 'ag_sum')}, {r6('ag_mean')}, {r6('ln(1 + ag_var)', 'ag_var')} FROM k3"
    o["log1p_if_skewed"] = f"""WITH m AS (SELECT avg(value) AS mv, avg(user_id) AS mu FROM events),
s AS (SELECT avg((value - mv) ** 3) / avg((value - mv) ** 2) ** 1.5 AS sv, avg((user_id - mu) ** 3) / avg((user_id - mu) ** 2) ** 1.5 AS su, min(value) AS lo FROM events, m)
SELECT event_id AS row_id, {r6('CASE WHEN sv > 2 THEN ln(1 + greatest(value, 0.0)) ELSE value END', 'value')},
 {r6('CASE WHEN su > 2 THEN ln(1 + user_id) ELSE CAST(user_id AS DOUBLE) END', 'user_id')} FROM events, s"""
    o["healthy_reference"] = c + " UNION ALL ".join(
        f"SELECT '{f}' AS family, {i} AS bin, {r6(f'sum({x}) / sum({chr(32).join([b[0], *[f'+ {y}' for y in b[1:]]])})', 'share')} FROM cust WHERE label = 0"
        for f, b in X.FAMILIES.items() for i, x in enumerate(b)
    )
    mean_share = lambda b, x: f"avg(CASE WHEN {' + '.join(b)} > 0 THEN {x} / ({' + '.join(b)}) ELSE 0 END)"
    o["healthy_reference_mean"] = c + " UNION ALL ".join(
        f"SELECT '{f}' AS family, {i} AS bin, {r6(mean_share(b, x) + ' / (' + ' + '.join(mean_share(b, y) for y in b) + ')', 'share')} FROM cust WHERE label = 0"
        for f, b in X.FAMILIES.items() for i, x in enumerate(b)
    )
    o["wasserstein_to_ref"] = with_(CUST, REFS) + "SELECT row_id, " + ", ".join(
        r6(wasserstein(f), f"{f}_wasserstein") for f in X.FAMILIES
    ) + " FROM cust, refs"
    keep = "row_id, label, aa_000, " + cols(X.GAPPY) + ", " + cols(c2 for b in X.FAMILIES.values() for c2 in b)
    sp = f"(SELECT corr(ra, rb) FROM (SELECT {avg_rank('ag_sum')} AS ra, {avg_rank('aa_000')} AS rb FROM e0))"
    names = [n for n in engineered_names(X.FAMILIES) if not n.endswith("_sum")]
    # The kept sum is not mileage again on this data: the twin fails loudly if it were.
    o["replace_bins"] = with_(CUST, REFS, engineered("cust", X.FAMILIES, "row_id, label, aa_000, " + cols(X.GAPPY))) + f"""
SELECT e.row_id, e.label, {r6('e.aa_000', 'aa_000')}, {', '.join(r6('e.' + x, x) for x in X.GAPPY)},
 {', '.join(f'CAST(e.{x} IS NULL AS INT) AS {x}_is_missing' for x in X.GAPPY)},
 {r6(f'CASE WHEN {sp} > 0.98 THEN NULL ELSE ag_sum END', 'Total_Operational_Events')}, {', '.join(r6(n) for n in names)},
 {', '.join(r6(wasserstein(f), f + '_wasserstein') for f in X.FAMILIES)}
FROM eng e JOIN cust USING (row_id), refs"""
    o["remove_uptime_redundancy"] = with_(CUST, ENG) + f"SELECT row_id, aa_000, CASE WHEN {sp} > 0.98 THEN NULL ELSE ag_sum END AS Total_Operational_Events FROM eng"
    o["family_sums"] = c + "SELECT row_id, " + ", ".join(f"{' + '.join(b)} AS {f}_total" for f, b in X.FAMILIES.items()) + " FROM cust"
    # statistics
    o["ks_two_sample"] = ks_item + f"SELECT feature, {r6('stat')}, {r6('p_value')} FROM ksp"
    one = {"ag": X.AG}
    ag_names = [n for n in engineered_names(one) if n.startswith("ag_")]
    o["ks_top_features"] = with_(CUST, engineered("cust", one), running("eng", ag_names), KS) + f"SELECT feature, {r6('stat')}, {r6('p_value')} FROM (SELECT * FROM ksp ORDER BY ksp.stat DESC, feature LIMIT 10)"
    run_gap = with_(CUST, running("cust", WITH_GAPS))
    o["ks_pvalues"] = run_gap + f", {KS} SELECT feature, {r6('p_value')} FROM ksp"
    split = f"""sp AS (SELECT *, CAST({md5_rank()} > round(count(*) OVER (PARTITION BY label) * 0.8) AS INT) AS side FROM cust)"""
    o["ks_drift"] = with_(CUST, split, running("sp", CORE, "side"), KS) + f"SELECT feature, {r6('stat')}, {r6('p_value')} FROM ksp"
    flat = "flatc AS (SELECT *, 1.0 AS flat FROM cust)"
    o["kruskal_wallis"] = with_(CUST, flat, running("flatc", [*WITH_GAPS, "flat"]), KW) + f"SELECT feature, {r6('stat')} FROM kw"
    o["mutual_info_rank"] = with_(ITEM, running("item", X.ITEM), MI) + f"SELECT feature, {r6('mi')} FROM mi"
    o["mutual_info_binned"] = with_(ITEM, running("item", X.ITEM), MI_BINNED) + f"SELECT feature, {r6('mi')} FROM mi"
    o["ks_pvalues_ties"] = with_(CUST, running("cust", [*CORE, *X.BA]), ks(True)) + f"SELECT feature, {r6('stat')}, {r6('p_value')}, n0, n1 FROM ksp"
    o["spearman_pair"] = with_(CUST, "f AS (SELECT * FROM cust WHERE na_mid IS NOT NULL)") + f"""SELECT 'na_mid' AS feature, {r6('corr(a, b)', 'rho')}
 FROM (SELECT {avg_rank('na_mid')} AS a, {avg_rank('aa_000')} AS b FROM f)"""
    sm = ["aa_000", *X.BA]
    o["spearman_matrix"] = with_(CUST, "rks AS (SELECT " + ", ".join(f"{avg_rank(x)} AS {x}" for x in sm) + " FROM cust)") + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})', 'rho')} FROM rks" for a in sm for b in sm
    )
    o["pearson_matrix"] = with_(ITEM) + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})', 'r')} FROM item" for a in X.ITEM for b in X.ITEM
    )
    o["high_corr_pairs"] = c + f"SELECT a, b, {r6('r')} FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM cust" for a in NUMERIC for b in NUMERIC if a != b
    ) + ") WHERE abs(r) > 0.5 AND abs(r) < 1"
    rks_all = "rks AS (SELECT " + ", ".join(f"{avg_rank(x)} AS {x}" for x in NUMERIC) + " FROM cust)"
    o["corr_with_reference"] = with_(CUST, rks_all) + "SELECT feature, round(v, 6) + 0.0 AS abs_rho FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature, abs(corr({a}, aa_000)) AS v FROM rks" for a in NUMERIC
    ) + ") ORDER BY v DESC, feature LIMIT 11"
    dcols = f"{r6('mn', 'min')}, {r6('q25')}, {r6('q50')}, {r6('q75')}, {r6('mx', 'max')}"
    o["describe_by_class"] = with_(ITEM, quartile_sql("item", X.ITEM)) + f"SELECT feature, label, n, {r6('mean')}, {r6('std')}, {dcols} FROM d"
    sk = [n for n in engineered_names(X.FAMILIES) if n.endswith(("_skew", "_kurt"))]
    o["melt_by_class"] = with_(CUST, ENG, quartile_sql("eng", sk)) + f"SELECT feature, label, n, {dcols} FROM d"
    rks_bins = "rks AS (SELECT " + ", ".join(f"{avg_rank(x)} AS {x}" for b in X.FAMILIES.values() for x in b) + f", {avg_rank('label')} AS lab FROM cust)"
    o["killer_bins"] = with_(CUST, rks_bins, "kb AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS family, '{x}' AS bin, corr({x}, lab) AS rho FROM rks" for f, b in X.FAMILIES.items() for x in b
    ) + ")") + f"SELECT family, bin, {r6('kb.rho', 'rho')}, CAST(coalesce(abs(kb.rho - max(kb.rho) OVER (PARTITION BY family)) < 1e-12, FALSE) AS INT) AS is_top FROM kb"
    o["gaussianity_check"] = with_(ITEM, f"tall AS ({long('item', X.ITEM, '')})") + f""", m AS (SELECT feature, avg(value) AS mu FROM tall GROUP BY feature),
g AS (SELECT t.feature, avg((value - mu) ** 3) / avg((value - mu) ** 2) ** 1.5 AS skew, avg((value - mu) ** 4) / avg((value - mu) ** 2) ** 2 - 3 AS kurt
 FROM tall t JOIN m ON t.feature = m.feature GROUP BY t.feature)
SELECT feature, {r6('g.skew', 'skew')}, {r6('g.kurt', 'kurt')}, CAST(abs(g.kurt) < 1 AND abs(g.skew) < 0.5 AS INT) AS gaussian FROM g"""
    ent = "(" + " + ".join(f"{f}_entropy" for f in X.FAMILIES) + f") / {len(X.FAMILIES)}"
    o["entropy_delta"] = with_(CUST, ENG) + f""", d AS (SELECT avg({ent}) FILTER (WHERE label = 0) AS h, avg({ent}) FILTER (WHERE label = 1) AS f FROM eng)
SELECT {r6('h', 'healthy')}, {r6('f', 'failing')}, {r6('f / h', 'ratio')} FROM d"""
    o["peak_mode_by_class"] = with_(CUST, ENG) + """SELECT label, peaks, n FROM (SELECT label, ag_peaks AS peaks, count(*) AS n,
 row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, ag_peaks) AS r FROM eng GROUP BY label, ag_peaks) WHERE r = 1"""
    pk = [f"{f}_peaks" for f in X.FAMILIES]
    o["peak_regimes"] = with_(CUST, ENG, f"tall AS ({long('eng', pk)})") + f""", top AS (SELECT feature FROM tall GROUP BY feature ORDER BY stddev_samp(value) DESC, feature LIMIT 3),
k AS (SELECT feature, label, value AS peaks, count(*) AS n FROM tall WHERE feature IN (SELECT feature FROM top) GROUP BY ALL)
SELECT feature, label, peaks, n, {r6('n / sum(n) OVER (PARTITION BY feature, label) * 100', 'pct')} FROM k"""
    o["mileage_skew_corr"] = with_(CUST, ENG) + f", q AS (SELECT corr(aa_000, ag_skew) AS r FROM eng) SELECT {r6('q.r', 'r')}, CAST(abs(q.r) > 0.3 AS INT) AS aging_shift FROM q"
    o["fan_points"] = with_(CUST, ENG) + f"SELECT row_id, {r6('aa_000', 'x')}, {r6('ay_DCI', 'y')}, label FROM eng"
    zone = lambda z, w: f"SELECT {z} AS zone, count(*) AS n, {r6('avg(ay_DCI)', 'mean_y', 8)}, {r6('regr_slope(ay_DCI, aa_000)', 'slope', 8)}, {r6('regr_intercept(ay_DCI, aa_000)', 'intercept', 8)} FROM eng {w}"
    o["zone_means"] = with_(CUST, ENG) + zone("CAST(label AS VARCHAR)", "GROUP BY label") + " UNION ALL " + zone("'all'", "")
    dens = lambda f: f"""SELECT '{f}' AS feature, label, CAST(least(19, floor(({f} - lo) / w)) AS INT) AS bin, count(*) AS n, max(w) AS w
 FROM item, (SELECT min({f}) AS lo, (max({f}) - min({f})) / 20 AS w FROM item) GROUP BY 1, 2, 3"""
    o["histogram_by_class"] = with_(ITEM) + f""", k AS ({dens('l_extendedprice')} UNION ALL {dens('l_quantity')})
SELECT feature, label, bin, n, {r6('n / sum(n) OVER (PARTITION BY feature, label) / w', 'density', 9)},
 {r6('sum(n) OVER (PARTITION BY feature, label ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY feature, label)', 'cdf', 9)} FROM k"""
    # The same grid as the operator; its closeness to the direct sum is tested apart.
    phi = "0.5 * ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-y * y)"
    o["density_by_class"] = with_(ITEM) + f""", dv AS (SELECT 'l_extendedprice' AS feature, label, l_extendedprice AS value FROM item UNION ALL SELECT 'l_quantity', label, l_quantity FROM item),
dw AS (SELECT feature, label, count(*) AS n, min(value) AS least, max(value) AS most, stddev_samp(value) * pow(CAST(count(*) AS DOUBLE), -0.2) AS w FROM dv GROUP BY 1, 2),
dg AS (SELECT *, least - 3.0 * w AS first, ((most + 3.0 * w) - (least - 3.0 * w)) / 199.0 AS step FROM dw),
db AS (SELECT feature, label, floor((value - first) / least(step, g.w / 16.0)) AS cell, (value - first) / least(step, g.w / 16.0) AS place FROM dv JOIN dg g USING (feature, label)),
dc AS (SELECT feature, label, cell, sum(weight) AS weight FROM (SELECT feature, label, cell, 1.0 - (place - cell) AS weight FROM db UNION ALL SELECT feature, label, cell + 1, place - cell FROM db) GROUP BY 1, 2, 3),
dn AS (SELECT c.*, g.*, first + cell * least(step, w / 16.0) AS at FROM dc c JOIN dg g ON c.feature = g.feature AND c.label = g.label),
dp AS (SELECT feature, label, unnest(range(0, 200)) AS point FROM dg),
dt AS (SELECT p.feature, p.label, p.point, d.weight, d.w, (d.first + p.point * d.step - d.at) / d.w AS z FROM dp p JOIN dn d ON p.feature = d.feature AND p.label = d.label),
du AS (SELECT *, abs(z) / sqrt(2.0) AS y, 1.0 / (1.0 + 0.3275911 * (abs(z) / sqrt(2.0))) AS t FROM dt),
ds AS (SELECT feature, label, point, sum(CASE WHEN abs(z) <= 6 THEN weight * exp(-z * z / 2.0) / (sqrt(2.0 * pi()) * w) END) AS density,
 sum(CASE WHEN z > 6 THEN weight WHEN z < -6 THEN 0 WHEN z >= 0 THEN weight * (1.0 - {phi}) ELSE weight * ({phi}) END) AS cdf FROM du GROUP BY 1, 2, 3)
SELECT s.feature, s.label, CAST(s.point AS INT) AS point, {r6('g.first + s.point * g.step', 'x')}, {r6('coalesce(s.density, 0) / g.n', 'density')},
 {r6('least(s.cdf / g.n, 1.0)', 'cdf')} FROM ds s JOIN dg g ON s.feature = g.feature AND s.label = g.label"""
    feats = ["aa_000", *X.BA, "ag_000"]
    fam_rk = with_(CUST, "fs AS (SELECT *, " + ", ".join(f"{' + '.join(b)} AS s_{f}" for f, b in X.FAMILIES.items()) + " FROM cust)",
                   "rks AS (SELECT " + ", ".join(f"{avg_rank(x)} AS {x}" for x in [*feats, *[f"s_{f}" for f in X.FAMILIES]]) + " FROM fs)",
                   "fc AS (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, (" + " + ".join(f"abs(corr({x}, s_{f}))" for f in X.FAMILIES) + f") / {len(X.FAMILIES)} AS v FROM rks" for x in feats) + ")")
    o["feature_group_correlation"] = fam_rk + f"SELECT feature, {r6('v', 'avg_corr')}, CASE WHEN v > 0.75 THEN 'Global' WHEN v > 0.25 THEN 'Secondary' ELSE 'Diagnostic' END AS feature_group FROM fc"
    o["feature_group_usage"] = fam_rk + f"""SELECT feature, {r6('v', 'avg_corr')}, CASE WHEN v > 0.85 THEN 'Global Usage (Proxy for Age)'
 WHEN v >= 0.5 THEN 'Secondary Usage (Duty Cycle)' ELSE 'Diagnostic / Specific Signal' END AS classification FROM fc"""
    # scaling, discretising, sampling
    sca = lambda num, den: c + "SELECT row_id, " + ", ".join(
        r6(f"({x} - (SELECT {num.format(x=x)} FROM cust)) / (SELECT {den.format(x=x)} FROM cust)", x) for x in SCALED
    ) + " FROM cust"
    o["standard_scale"] = sca("avg({x})", "stddev_pop({x})")
    o["sample_scale"] = sca("avg({x})", "stddev_samp({x}) + 1e-6")
    o["minmax_scale"] = sca("min({x})", "max({x}) - min({x})")
    o["robust_scale"] = sca("quantile_cont({x}, 0.5)", "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)")
    o["quantile_discretise"] = c + "SELECT row_id, " + ", ".join(f"{code(x)} AS {x}" for x in DISC) + " FROM cust"
    ew = lambda x, i: f"CAST({x} > (SELECT min({x}) + (max({x}) - min({x})) * {i} / 3 FROM cust) AS INT)"
    o["equal_width_discretise"] = c + "SELECT row_id, " + ", ".join(f"coalesce({ew(x, 1)} + {ew(x, 2)}, 0) AS {x}" for x in DISC) + " FROM cust"
    o["undersample_majority"] = c + f"""SELECT row_id, label FROM (SELECT *, {md5_rank()} AS r FROM cust) WHERE label = 1
 OR (label = 0 AND r <= (SELECT floor(count(*) * 1.5) FROM cust WHERE label = 1))"""
    o["stratified_split"] = c + f"SELECT row_id, label, CAST({md5_rank()} <= round(count(*) OVER (PARTITION BY label) * 0.8) AS INT) AS is_train FROM cust"
    o["stratified_kfold"] = c + f"SELECT row_id, label, CAST(({md5_rank()} - 1) % 5 AS INT) AS fold FROM cust"
    o["row_subsample"] = with_(DOCS) + f"SELECT row_id, n_chars FROM docs ORDER BY md5('42:' || row_id), row_id LIMIT 500"
    o["class_weights"] = c + f"SELECT label, count(*) AS n, {r6('(SELECT count(*) FROM cust) / (2.0 * count(*))', 'weight')} FROM cust GROUP BY label"
    # outliers
    o["failure_rescue"] = with_(DOCS, SCORED) + "SELECT row_id, label, score, is_outlier, keep FROM scored"
    o["outlier_audit"] = with_(DOCS, SCORED) + f""", a AS (SELECT count(*) FILTER (WHERE keep = 0) AS n_dropped, count(*) FILTER (WHERE keep = 0 AND label = 1) AS n_failures,
 avg(CAST(label AS DOUBLE)) AS br FROM scored)
SELECT n_dropped, n_failures, {r6('br', 'base_rate')}, {r6('CASE WHEN n_dropped > 0 THEN n_failures / n_dropped END', 'drop_rate')},
 CAST(coalesce(n_failures / n_dropped > 5 * br, FALSE) AS INT) AS warn FROM a"""
    # consensus
    ranks = with_(CUST, running("cust", CORE), KS, KW, MI) + """, tops AS (
 SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY stat DESC, feature) AS r FROM ksp) WHERE r <= 4
 UNION ALL SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY stat DESC, feature) AS r FROM kw) WHERE r <= 4
 UNION ALL SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY mi DESC, feature) AS r FROM mi) WHERE r <= 4)"""
    o["consensus_union"] = ranks + "SELECT DISTINCT feature FROM tops"
    o["consensus_vote"] = ranks + """, v AS (SELECT feature, count(*) AS votes FROM tops GROUP BY feature)
SELECT feature, votes, CAST(CASE WHEN max(votes) OVER () >= 2 THEN votes >= 2 ELSE row_number() OVER (ORDER BY votes DESC, feature) <= 4 END AS INT) AS selected FROM v"""
    o["selection_stability"] = with_(edges("lin", 1)) + f"SELECT src AS feature, count(DISTINCT run_id) AS n_folds, {r6('count(DISTINCT run_id) / (SELECT CAST(count(DISTINCT run_id) AS DOUBLE) FROM lin) * 100', 'pct')} FROM lin GROUP BY src ORDER BY n_folds DESC, feature LIMIT 20"
    # cost
    o["copula_domains"] = with_(CUST, """k AS (SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM cust)""") + """SELECT 0 AS made, label, count(*) AS n,
 count(*) AS ids, 0 AS negative, 0 AS fractions, 0 AS no_flag FROM cust GROUP BY label
UNION ALL SELECT 1, 1, CAST(floor(n0 * 0.9::DOUBLE) AS BIGINT) - n1, CAST(floor(n0 * 0.9::DOUBLE) AS BIGINT) - n1, 0, 0, 0 FROM k WHERE floor(n0 * 0.9::DOUBLE) > n1"""
    o["marginal_parameters"] = with_(CUST, "few AS (SELECT * FROM cust WHERE label = 1)", "tall AS (" + long("few", CORE) + ")") + f""",
mm AS (SELECT feature, avg(value) AS mean, var_pop(value) AS var, min(value) AS lo, max(value) AS hi FROM tall GROUP BY feature),
mz AS (SELECT *, (mean - lo) / (hi - lo) AS m, var / ((hi - lo) * (hi - lo)) AS v FROM mm WHERE hi > lo AND var > 0),
mk AS (SELECT *, m * (1 - m) / v - 1 AS size FROM mz WHERE abs(m * (1 - m) - v) >= 1e-9),
mc AS (SELECT feature, value, count(*) AS n FROM tall GROUP BY feature, value),
mr AS (SELECT feature, value, n, sum(n) OVER (PARTITION BY feature ORDER BY value) AS c, sum(n) OVER (PARTITION BY feature) AS t FROM mc),
md AS (SELECT r.feature, max(greatest(abs(c / t - (value - lo) / (hi - lo)), abs((c - n) / t - (value - lo) / (hi - lo)))) AS distance FROM mr r JOIN mk k ON r.feature = k.feature GROUP BY r.feature),
mp AS (SELECT feature, 'beta' AS family, NULL::DOUBLE AS d, m * size AS p, (1 - m) * size AS q FROM mk
 UNION ALL SELECT feature, 'gamma', NULL, (mean - lo) * (mean - lo) / var, var / (mean - lo) FROM mk
 UNION ALL SELECT feature, 'normal', NULL, mean, sqrt(var) FROM mk
 UNION ALL SELECT k.feature, 'uniform', md.distance, 0.0, 0.0 FROM mk k JOIN md ON md.feature = k.feature)
SELECT feature, family, {r6('d', 'distance')}, {r6('p', 'a')}, {r6('q', 'b')} FROM mp"""
    grown = with_(CUST, smote(CORE, 0.25))
    shown = "SELECT g.row_id, g.label, " + ", ".join(r6("g." + x, x) for x in CORE) + " FROM grown g"
    o["smote"] = grown + shown
    points_ = f", gp AS (SELECT row_id AS id, label, {cols(CORE)} FROM grown), "
    o["smote_enn"] = grown + points_ + neighbours("gp", CORE, 3, "gn") + f""", kept AS (SELECT n.id FROM gn n JOIN gp a ON a.id = n.id JOIN gp b ON b.id = n.nbr GROUP BY n.id HAVING bool_and(a.label = b.label))
{shown} JOIN kept ON kept.id = g.row_id"""
    o["smote_tomek"] = grown + points_ + neighbours("gp", CORE, 1, "gn") + f""", links AS (SELECT a.id, a.nbr FROM gn a JOIN gn b ON a.nbr = b.id AND b.nbr = a.id JOIN gp x ON x.id = a.id JOIN gp y ON y.id = a.nbr WHERE x.label <> y.label)
{shown} WHERE g.row_id NOT IN (SELECT id FROM links)"""
    o["age_adjusted_logit"] = logits([f for f in CORE if f != "aa_000"])
    o["univariate_age_logit"] = logits(["aa_000"], None)
    o["normalised_scores"] = f"SELECT c_custkey AS row_id, {r6('(c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer)', 'prob')} FROM customer"
    o["cost_curve"] = with_(DOCS, curve("docs", GRID_TUNE)) + f"SELECT {CURVE_COLS} FROM curve"
    o["cost_curve_items"] = with_("item AS (SELECT CAST(l_returnflag = 'R' AS INT) AS label, (l_extendedprice % 1000) / 1000 AS prob FROM lineitem)", curve("item", GRID_DENSE)) + f"SELECT {CURVE_COLS} FROM curve"
    best = lambda order: f"SELECT {CURVE_COLS} FROM (SELECT * FROM curve ORDER BY curve.cost, curve.threshold {order} LIMIT 1)"
    o["best_threshold_grid"] = with_(DOCS, curve("docs", GRID_TUNE)) + best("")
    o["best_threshold_dense"] = with_(DOCS, curve("docs", GRID_DENSE)) + best("")
    o["best_threshold_roc"] = with_(DOCS, curve("docs")) + f"""SELECT {CURVE_COLS} FROM (SELECT threshold, fp, fn, cost FROM curve
 UNION ALL SELECT 'infinity'::DOUBLE, 0, CAST(t1 AS BIGINT), CAST(500.0 * t1 AS DOUBLE) FROM tot ORDER BY cost, threshold DESC LIMIT 1)"""
    o["confusion_at"] = with_(DOCS, CONF) + "SELECT tn, fp, fn, tp FROM conf"
    o["metrics_at"] = with_(DOCS, METRICS) + f"SELECT {', '.join(r6('met.' + m, m) for m in ('auc', 'macro_f1', 'recall', 'precision'))}, fp, fn, cost, threshold FROM met"
    o["roc_curve"] = with_(DOCS, curve("docs")) + f"SELECT {r6('curve.threshold', 'threshold')}, {r6('fp / t0', 'fpr')}, {r6('tp / t1', 'tpr')} FROM curve"
    fs = ("auc", "cost", "f1")
    o["fold_summary"] = f"""WITH f AS (SELECT count(*) FILTER (WHERE c_acctbal > 0) / count(*) AS auc, CAST(count(*) FILTER (WHERE c_acctbal < 0) AS DOUBLE) AS cost,
 count(*) FILTER (WHERE c_mktsegment = 'BUILDING') / count(*) AS f1, min(abs(c_acctbal)) / 100 AS threshold, CAST(count(*) AS DOUBLE) AS fit_time, 0.0 AS pred_time
 FROM customer GROUP BY c_nationkey)
SELECT {', '.join(f'{r6(f"avg({m})", m + "_mean")}, {r6(f"stddev_pop({m})", m + "_std")}' for m in fs)}, {r6('median(threshold)', 'threshold')},
 {r6('avg(fit_time)', 'fit_time_mean')}, CAST({r6('avg(pred_time)', 'x').replace(' AS x', '')} AS DOUBLE) AS pred_time_mean FROM f"""
    runs = """runs AS (SELECT o_orderpriority AS model, CAST(c_nationkey AS VARCHAR) AS feature_set,
 round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS cost_mean, o_orderpriority || ' | ' || CAST(c_nationkey AS VARCHAR) AS run_name
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderpriority, c_nationkey),
lead AS (SELECT *, CAST(row_number() OVER (PARTITION BY feature_set ORDER BY cost_mean, run_name) AS INT) AS set_rank FROM runs)"""
    o["experiment_leaderboard"] = with_(runs) + "SELECT * FROM lead ORDER BY cost_mean, run_name LIMIT 80"
    o["best_per_feature_set"] = with_(runs) + "SELECT * FROM lead WHERE set_rank = 1"
    # explanation
    cr = with_(CUST, running("cust", CORE), KS, MI) + """, cr AS (SELECT k.feature, round(k.stat, 6) + 0.0 AS mean_abs_shap, round(m.mi, 6) + 0.0 AS pi_mean FROM ksp k JOIN mi m ON k.feature = m.feature),
crr AS (SELECT *, CAST(dense_rank() OVER (ORDER BY mean_abs_shap DESC) AS INT) AS shap_rank, CAST(dense_rank() OVER (ORDER BY pi_mean DESC) AS INT) AS pi_rank FROM cr)"""
    o["compare_ranks"] = cr + "SELECT feature, mean_abs_shap, shap_rank, pi_mean, pi_rank, CAST((shap_rank + pi_rank) / 2.0 AS DOUBLE) AS avg_rank FROM crr"
    o["rank_agreement"] = cr + f"SELECT {r6('corr(a, b)', 'rho')} FROM (SELECT {avg_rank('shap_rank')} AS a, {avg_rank('pi_rank')} AS b FROM crr)"
    vec = "vec AS (SELECT vec_id AS row_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v, embedding[1]::DOUBLE AS m FROM embeddings), named AS (SELECT *, 'e_' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature FROM vec)"
    o["shap_global_given_phi"] = with_(vec) + f"SELECT feature, {r6('avg(abs(v))', 'mean_abs_shap')} FROM named GROUP BY feature"
    o["shap_local_given_phi"] = with_(vec) + f"""SELECT row_id, {r6('1 / (1 + exp(-2 * m))', 'proba')}, feature, {r6('v', 'value')}, {r6('v', 'shap')} FROM (
 SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(v) DESC, feature) AS r FROM named WHERE row_id IN (
  SELECT vec_id FROM embeddings WHERE embedding[1] >= 0 ORDER BY embedding[1] DESC, vec_id LIMIT 7)) WHERE r <= 8"""
    # causal
    r_ = lambda a, b: f"(SELECT abs(corr({a}, {b})) FROM fs)"
    steps = ["fs AS (SELECT label, aa_000, " + ", ".join(f"{' + '.join(b)} AS {f}_total" for f, b in X.FAMILIES.items()) + " FROM cust)",
             "s0 AS (SELECT " + ", ".join(f"FALSE AS d{i}" for i in range(len(PRUNED))) + ")"]
    for i, a in enumerate(PRUNED):
        for j in range(i + 1, len(PRUNED)):
            b = PRUNED[j]
            hit = f"NOT d{i} AND NOT d{j} AND {r_(a, b)} > 0.8 AND {r_(a, 'label')} - {r_(b, 'label')}"
            flags = [f"d{k}" for k in range(len(PRUNED))]
            flags[i], flags[j] = f"d{i} OR ({hit} < -1e-12) AS d{i}", f"d{j} OR ({hit} >= -1e-12) AS d{j}"
            steps.append(f"s{len(steps) - 1} AS (SELECT {', '.join(flags)} FROM s{len(steps) - 2})")
    o["collinearity_prune"] = with_(CUST, *steps) + " UNION ALL ".join(
        f"SELECT '{x}' AS feature, {r6(f'(SELECT avg({x}) FROM fs)', 'mean', 4)} FROM s{len(steps) - 2} WHERE NOT d{i}" for i, x in enumerate(PRUNED)
    )
    tier = lambda x: f"CASE {x}.feature_group WHEN 'Global' THEN 0 WHEN 'Secondary' THEN 1 WHEN 'Diagnostic' THEN 2 ELSE 3 END"
    o["prior_matrix"] = with_(GROUPS) + f"""SELECT e.run_id, e.feature AS effect, c.feature AS cause, CASE WHEN c.feature = 'class' OR e.feature = 'aa_000'
 OR (e.feature = 'class' AND c.feature = 'aa_000') OR (e.feature NOT IN ('class', 'aa_000') AND c.feature NOT IN ('class', 'aa_000')
 AND e.feature <> c.feature AND {tier('c')} > {tier('e')}) THEN -1 ELSE 0 END AS forbidden FROM groups e JOIN groups c ON e.run_id = c.run_id"""
    o["contingency"] = with_(CUST, CODES, "codes_x AS (SELECT * FROM codes)") + contingency()
    o["contingency_by_run"] = with_(CUST, CODES, "codes_x AS (SELECT codes.*, CAST(c_nationkey AS BIGINT) AS run_id FROM codes JOIN customer ON row_id = c_custkey)") + contingency("run_id, ")
    o["chisq_ci"] = with_(CUST, CODES, "codes_x AS (SELECT * FROM codes)", CHI) + f"SELECT chi.test, x, y, z, {r6('chi.stat', 'stat')}, dof FROM chi JOIN (VALUES " + ", ".join(
        f"({t}, '{x}', '{y}', '{','.join(z)}')" for t, (x, y, z) in enumerate(TESTS)
    ) + ") names(test, x, y, z) ON chi.test = names.test"
    o["edge_cleanup"] = EDGE_BASE + "SELECT run_id, src, dst FROM clean"
    o["edge_strength_list"] = with_(edges("lin", 1)) + f"""SELECT run_id, src, dst, {r6('abs(weight)', 'strength')}, CASE WHEN src = 'aa_000' AND dst = 'class' THEN 'DIRECT TIME LINK (To Class)'
 WHEN dst = 'class' THEN '(To Class)' ELSE '' END AS mark FROM lin WHERE abs(weight) > 0.001"""
    rec = lambda *ctes: "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
    o["node_roles"] = rec(edges("lin", 1), CLEAN, reach("clean")) + """, par AS (SELECT run_id, dst AS node, count(*) AS k, max(CAST(src = 'aa_000' AS INT)) AS bt FROM clean GROUP BY run_id, dst)
SELECT n.run_id, n.node, CASE WHEN d.node IS NULL THEN 'Unconnected' WHEN coalesce(k, 0) = 0 OR (k = 1 AND bt = 1) THEN 'Physical Root' ELSE 'Mediator' END AS role
FROM nodes n LEFT JOIN dist d ON n.run_id = d.run_id AND n.node = d.node LEFT JOIN par p ON n.run_id = p.run_id AND n.node = p.node
WHERE n.node NOT IN ('class', 'aa_000')"""
    o["graph_structure"] = rec(edges("lin", 1), CLEAN, reach("clean")) + """SELECT d.run_id, d.node, CASE WHEN EXISTS (SELECT 1 FROM clean c WHERE c.run_id = d.run_id AND c.dst = d.node) THEN 'mediator' ELSE 'root' END AS kind,
 CAST(hops = 1 AS INT) AS is_parent FROM dist d WHERE d.node <> 'class'"""
    hyb = with_(edges("lin", 1), CLEAN, HYB)
    o["hybrid_graph"] = hyb + "SELECT run_id, src, dst, type, weight FROM hyb"
    o["hybrid_layers"] = hyb + """, l2 AS (SELECT DISTINCT run_id, dst AS node FROM hyb h WHERE src = 'aa_000' AND dst <> 'class'
 AND EXISTS (SELECT 1 FROM hyb g WHERE g.run_id = h.run_id AND g.src = h.dst AND g.dst <> 'class')),
l3 AS (SELECT DISTINCT h.run_id, h.dst AS node FROM hyb h JOIN l2 ON l2.run_id = h.run_id AND l2.node = h.src WHERE h.dst <> 'class'
 AND NOT EXISTS (SELECT 1 FROM l2 x WHERE x.run_id = h.run_id AND x.node = h.dst))
SELECT DISTINCT run_id, 'aa_000' AS node, 1 AS layer FROM hyb UNION ALL SELECT run_id, node, 2 FROM l2 UNION ALL SELECT run_id, node, 3 FROM l3
UNION ALL SELECT DISTINCT run_id, 'class', 4 FROM hyb"""
    o["path_depth"] = rec(edges("lin", 1), CLEAN, HYB, reach("hyb")) + """SELECT n.run_id, n.node, CAST(CASE WHEN n.node = 'class' THEN 10 WHEN hops IS NULL THEN 0 ELSE 9 - hops END AS INT) AS layer
FROM nodes n LEFT JOIN dist d ON n.run_id = d.run_id AND n.node = d.node"""
    chain = """WITH s AS (SELECT DISTINCT p_size AS size FROM part), r AS (SELECT 's' || size AS node, row_number() OVER (ORDER BY size) AS up,
 row_number() OVER (ORDER BY size DESC) AS hops FROM s)"""
    o["node_roles_chain"] = chain + " SELECT CAST(1 AS BIGINT) AS run_id, node, CASE WHEN up = 1 THEN 'Physical Root' ELSE 'Mediator' END AS role FROM r"
    o["path_depth_chain"] = chain + """ SELECT CAST(1 AS BIGINT) AS run_id, node, CAST(9 - hops AS INT) AS layer FROM r
 UNION ALL SELECT CAST(1 AS BIGINT), 'class', CAST(10 AS INT)"""
    wide = "WITH w AS (SELECT c_custkey % 2 * 3 AS a, c_custkey % 2 AS b, c_nationkey % 5 * 7 - 7 AS c FROM customer) "
    o["contingency_wide_codes"] = wide + " UNION ALL ".join(
        f"SELECT CAST({t} AS INT) AS test, CAST({z} AS BIGINT) AS z, CAST({x} AS INT) AS x, CAST({y} AS INT) AS y, count(*) AS n FROM w GROUP BY ALL"
        for t, (x, y, z) in enumerate([("a", "b", "0"), ("a", "c", "0"), ("b", "c", "a")]))
    gaps = ["aa_000", "ba_000", "na_mid", "na_low"]
    o["spearman_matrix_gaps"] = with_(CUST) + " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, {r6('corr(u, v)', 'rho')} FROM (SELECT {avg_rank(a)} AS u, {avg_rank(b)} AS v FROM cust
 WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for a in gaps for b in gaps)
    return o
