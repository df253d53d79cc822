"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python scripts/oracle_check.py [sf_dir] [name-substring ...]
Compares row count, column names and an order-insensitive multiset of rows
(doubles at 6 decimals), as the driver's check does.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from varlens.plans.catalog import oracle_sql, queries  # noqa: E402
from varlens.session import build_session  # noqa: E402
from varlens.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    names = [n for n in sorted(qs) if not pats or any(p in n for p in pats)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {n}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in sqls:
            print(f"ROWS  {n}: {len(srows)} rows ({ts:.1f}s, no oracle)")
            continue
        try:
            cur = con.execute(sqls[n])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {n}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL  {n}: columns spark={scols} duckdb={dcols}")
            bad += 1
            continue
        a, b = rows_of(srows, scols), rows_of(drows, dcols)
        if a == b:
            print(f"OK    {n}: {len(a)} rows ({ts:.1f}s)")
        else:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"FAIL  {n}: rows spark={len(a)} duckdb={len(b)}; only spark {list(sa - sb)[:3]}; "
                  f"only duckdb {list(sb - sa)[:3]}")
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
