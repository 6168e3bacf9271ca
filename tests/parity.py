"""Compare registered queries with their SQL on DuckDB: python tests/parity.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        out.append(tuple(_norm(row[i]) for i in order))
    return [columns[i] for i in order], sorted(out, key=repr)


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def duck(sf_dir):
    import duckdb

    from citeloom.sources.tables import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    start = time.time()
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return (bool(got), f"{len(got)} rows, no SQL", took)
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return (False, f"columns {got_cols} != {want_cols}", took)
    if got != want:
        extra = [r for r in got if r not in want][:2] if len(got) < 20000 else got[:1]
        lack = [r for r in want if r not in got][:2] if len(got) < 20000 else want[:1]
        return (False, f"rows {len(got)} vs {len(want)}; spark-only {extra}; sql-only {lack}", took)
    return (bool(got), f"{len(got)} rows", took)


def main(argv):
    import __spark_entry__ as entry

    from citeloom.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session(8)
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and name not in names:
            continue
        try:
            ok, note, took = compare(spark, con, name, query, sql.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:1200]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.2f}s {name}: {note}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
