"""Compare registered queries with their SQL twins: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_integer_ratio"):
        v = float(v)
        return "nan" if math.isnan(v) else v
    return str(v)


def normalise(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else a short description; the values must match exactly."""
    a_names, a = normalise(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    b_names, b = normalise([d[0] for d in cur.description], cur.fetchall())
    if a_names != b_names:
        return f"columns {a_names} vs {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


def main():
    from __spark_entry__ import oracle_sql, queries
    from faultline.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark, con = local_session(cpus=8), connect(sf_dir)
    sqls, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        t = time.time()
        print(f'### {name}', file=sys.stderr, flush=True)
        try:
            if name in sqls:
                why = difference(fn(spark, sf_dir), con, sqls[name])
                status = "ok" if why is None else f"DIFF {why}"
            else:
                status = f"rows {fn(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001 - report every query
            status = "ERROR " + str(e).replace("\n", " ")[:600]
        failed += status.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - t:6.2f}s  {status}", flush=True)
    print("missing queries for:", sorted(set(sqls) - set(queries())), "failed:", failed)


if __name__ == "__main__":
    main()
