"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
Compares row count, column names and the multiset of rows (floats compared
exactly and, separately, with a relative tolerance of 1e-9).
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fleetsight.session import get_session  # noqa: E402
from fleetsight.sources.tables import TABLE_NAMES  # noqa: E402


def norm(v, tol):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (2, "nan")
        return (2, f"{v:.9g}" if tol else repr(v))
    if isinstance(v, decimal.Decimal):
        return (2, f"{float(v):.9g}" if tol else str(v.normalize()) if v == v.to_integral() else str(v))
    if isinstance(v, int):
        return (2, f"{float(v):.9g}" if tol else str(v))
    if hasattr(v, "isoformat"):
        return (3, v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat())
    if isinstance(v, (list, tuple)):
        return (4, str([norm(x, tol) for x in v]))
    return (5, str(v))


def rows_of(columns, records, tol):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i], tol) for i in order) for r in records)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as entry

    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            cols = df.columns
            recs = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(recs)} rows ({dt:.1f}s, no SQL twin)")
            continue
        try:
            cur = con.execute(sqls[name])
            ocols = [d[0] for d in cur.description]
            orecs = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"FAIL {name}: columns differ\n  spark={sorted(cols)}\n  sql  ={sorted(ocols)}")
            bad += 1
            continue
        exact = rows_of(cols, recs, False) == rows_of(ocols, orecs, False)
        loose = rows_of(cols, recs, True) == rows_of(ocols, orecs, True)
        status = "OK  " if exact else ("LOOSE" if loose else "FAIL")
        if not loose:
            bad += 1
            a, b = rows_of(cols, recs, True), rows_of(ocols, orecs, True)
            sa, sb = set(a), set(b)
            print(f"FAIL {name}: rows spark={len(recs)} sql={len(orecs)}; cols={sorted(cols)}")
            print("   only spark:", [x for x in a if x not in sb][:3])
            print("   only sql  :", [x for x in b if x not in sa][:3])
        else:
            print(f"{status} {name}: {len(recs)} rows ({dt:.1f}s)")
    print(f"done: {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
