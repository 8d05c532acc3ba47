"""Run catalogue queries in Spark and their SQL twins in DuckDB and compare them.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "\x00null"
    if isinstance(v, float):
        if math.isnan(v):
            return "\x00null"
        return repr(v + 0.0)   # exact: the driver hashes values, so no extra rounding here
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    srows = [r.asDict() for r in sdf.collect()]
    ts = time.time() - t
    scols = sdf.columns
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), secs=round(ts, 2), note="rows only")
    rel = con.sql(sql)
    dcols = rel.columns
    drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
    if sorted(scols) != sorted(dcols):
        return dict(name=name, ok=False, note=f"columns differ spark={scols} duck={dcols}")
    cols = sorted(scols)
    a = sorted(tuple(norm(r[c]) for c in cols) for r in srows)
    b = sorted(tuple(norm(r[c]) for c in cols) for r in drows)
    if len(a) != len(b):
        return dict(name=name, ok=False, note=f"rows spark={len(a)} duck={len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return dict(name=name, ok=not bad, rows=len(a), secs=round(ts, 2),
                note=(f"{len(bad)} differing rows, first: {bad[0]}" if bad else ""), cols=cols)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from facsimile.session import get_session
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sq = E.queries(), E.oracle_sql()
    results = []
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, sq.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = dict(name=name, ok=False, note=f"ERROR {type(e).__name__}: {str(e)[:300]}")
        results.append(r)
        print(f"{'PASS' if r['ok'] else ('ROWS' if r['ok'] is None else 'FAIL')} {name} "
              f"rows={r.get('rows')} secs={r.get('secs')} {r.get('note', '')[:600]}", flush=True)
    n_ok = sum(1 for r in results if r["ok"])
    print(f"{n_ok}/{len(results)} pass, {sum(1 for r in results if r['ok'] is None)} rows-only")


if __name__ == "__main__":
    main()
