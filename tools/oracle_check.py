"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, schema match and an order-insensitive
value-hash match (columns sorted by name, like the driver's compare).
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from paxcast.plans import registry  # noqa: E402
from paxcast.session import local_session  # noqa: E402
from paxcast.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if v != v:
            return "nan"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    registry.load_all()
    names = args or sorted(registry.QUERIES)
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = registry.QUERIES[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = registry.ORACLES.get(name)
        if sql is None:
            print(f"{name:32s} rows={len(srows):7d} (no oracle) spark={ts:.1f}s")
            continue
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} DUCKDB-ERROR {str(e)[:300]}")
            bad += 1
            continue
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        ok = hs == hd and sorted(scols) == sorted(dcols)
        bad += not ok
        print(f"{name:32s} rows={len(srows):7d}/{len(drows):7d} cols={'ok' if sorted(scols)==sorted(dcols) else 'DIFF'} "
              f"hash={'ok' if hs == hd else 'DIFF'} spark={ts:.1f}s")
        if not ok:
            if sorted(scols) != sorted(dcols):
                print("   spark cols", scols, "\n   duck cols ", dcols)
            sd = sorted(set(ls) - set(ld))[:3]
            dd = sorted(set(ld) - set(ls))[:3]
            print("   only spark:", sd, "\n   only duck: ", dd)
    print("FAILED" if bad else "ALL OK", bad)
    spark.stop()


if __name__ == "__main__":
    main()
