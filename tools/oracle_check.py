"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Mirrors the driver's gate: sorted column names, row count, and an
order-insensitive comparison of all values.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(df) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False):
        out.append(tuple(norm(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spd = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return f"{name}: rows={len(spd)} (no oracle) spark={t1 - t0:.1f}s"
    dpd = con.execute(sql).df()
    if sorted(spd.columns) != sorted(dpd.columns):
        return f"{name}: COLUMNS DIFFER spark={sorted(spd.columns)} duck={sorted(dpd.columns)}"
    if len(spd) != len(dpd):
        return f"{name}: ROWCOUNT spark={len(spd)} duck={len(dpd)}"
    a, b = rows_of(spd), rows_of(dpd)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"{name}: VALUES DIFFER cols={sorted(spd.columns)} first={diff}"
    return f"{name}: OK rows={len(spd)} spark={t1 - t0:.1f}s"


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from tailorspark.session import get_session
    from tailorspark.plans.registry import all_queries, all_oracle_sql

    spark = get_session("local[8]")
    qs, sqls = all_queries(), all_oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        try:
            msg = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as e:  # report and continue
            msg = f"{name}: ERROR {type(e).__name__}: {str(e)[:400]}"
        if " OK " not in msg and "no oracle" not in msg:
            bad += 1
        print(msg, flush=True)
    print(f"done, {bad} problem(s)")


if __name__ == "__main__":
    main()
