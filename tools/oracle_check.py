"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]

Comparison: same column names (order-insensitive), same row count and the
same multiset of rows after normalising values (floats rounded to 6 places,
timestamps to ISO strings, arrays to tuples). Prints one line per query.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

from plansight.plans import REGISTRY  # noqa: E402
from plansight.session import get_session  # noqa: E402
from plansight.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float | np.floating):
        if math.isnan(v):
            return None
        return round(float(v), 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, np.bool_):
        return bool(v)
    if isinstance(v, pd.Timestamp | dt.datetime):
        return pd.Timestamp(v).tz_localize(None).isoformat() if getattr(v, "tzinfo", None) else pd.Timestamp(v).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, np.ndarray | list | tuple):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if v is pd.NaT:
        return None
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = get_session("local[8]", 8)
    con = duck(a.sf)
    names = a.names or sorted(REGISTRY)
    bad = 0
    for name in names:
        spec = REGISTRY[name]
        t0 = time.time()
        try:
            sdf = spec.build(spark, a.sf)
            scols = sdf.columns
            srows = rows_of(scols, [tuple(r) for r in sdf.collect()])
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if not spec.oracle:
            print(f"rows-only  {name}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            res = con.execute(spec.oracle)
            dcols = [d[0] for d in res.description]
            drows = rows_of(dcols, res.fetchall())
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-DUCK  {name}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"COLS       {name}: spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
        elif srows != drows:
            bad += 1
            sset, dset = set(srows), set(drows)
            print(f"MISMATCH   {name}: spark={len(srows)} duck={len(drows)} rows; cols={sorted(scols)}")
            for r in list(sset - dset)[:3]:
                print("   spark-only", r)
            for r in list(dset - sset)[:3]:
                print("   duck-only ", r)
        else:
            print(f"ok         {name}: {len(srows)} rows ({ts:.1f}s)")
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
