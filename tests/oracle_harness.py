"""Side-by-side check of registered Spark queries against their DuckDB oracle.

Runs each query in Spark and its oracle SQL in DuckDB on the same parquet
folder and compares column names, row count and the order-insensitive
multiset of rows (values normalised to text, with the Python type of each
value kept, so ``Decimal('1.50')`` and ``1.5`` do not compare equal).

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, float):
        return ("float", repr(v))
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, dt.datetime):
        return ("ts", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("date", v.isoformat())
    return (type(v).__name__, str(v))


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = con.sql(sql)
    d_cols = res.columns
    d_rows = res.fetchall()
    t2 = time.time()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark-only={sorted(set(s_cols) - set(d_cols))} "
                        f"duck-only={sorted(set(d_cols) - set(s_cols))}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        a, b = canon(s_cols, s_rows), canon(d_cols, d_rows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            problems.append(f"values differ, e.g. {diff}")
    return problems, len(s_rows), t1 - t0, t2 - t1


def main(argv):
    from fleetbook.session import build_session
    import __spark_entry__ as E

    sf_dir = argv[1] if len(argv) > 1 and "/" in argv[1] else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if "/" not in a]
    spark = build_session(cpus=8, shuffle_partitions=8)
    con = duck(sf_dir)
    qs, oq = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        if name not in oq:
            print(f"{name:28s} NO-ORACLE")
            continue
        try:
            problems, n, ts, td = compare(spark, con, name, qs[name], oq[name], sf_dir)
        except Exception as ex:  # report and go on
            problems, n, ts, td = [f"error: {str(ex)[:400]}"], -1, 0, 0
        bad += bool(problems)
        status = "OK " if not problems else "BAD"
        print(f"{name:28s} {status} rows={n:7d} spark={ts:5.2f}s duck={td:5.2f}s {'; '.join(problems)}",
              flush=True)
    missing = sorted(set(oq) - set(qs))
    if missing:
        print("oracle without query:", missing)
    print(f"{len(names or qs) - bad} ok, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
