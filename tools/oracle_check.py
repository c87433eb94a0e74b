"""Local stand-in for the driver's correctness gate: Spark query vs DuckDB oracle SQL.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from gradebook.plans.catalog import load_all  # noqa: E402
from gradebook.session import local_session  # noqa: E402
from gradebook.sources.tables import TABLES, table_path  # noqa: E402


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v)
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def main() -> None:
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    reg = load_all()
    names = args or sorted(reg)
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
    bad = 0
    for name in names:
        q = reg[name]
        t0 = time.time()
        try:
            sdf = q.run(spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:800]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = q.oracle()
        if sql is None:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:800]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
            continue
        order = sorted(scols)
        si = [scols.index(c) for c in order]
        di = [dcols.index(c) for c in order]
        sset = sorted(tuple(norm(r[i]) for i in si) for r in srows)
        dset = sorted(tuple(norm(r[i]) for i in di) for r in drows)
        if sset == dset:
            print(f"OK   {name}: {len(srows)} rows {ts:.1f}s")
        else:
            bad += 1
            print(f"FAIL {name}: rows spark={len(sset)} duck={len(dset)}")
            sdiff = [r for r in sset if r not in set(dset)][:3]
            ddiff = [r for r in dset if r not in set(sset)][:3]
            print("   cols ", order)
            print("   spark-only", sdiff)
            print("   duck-only ", ddiff)
    print(f"{bad} failing of {len(names)}")


if __name__ == "__main__":
    main()
