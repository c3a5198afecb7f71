"""Compare column types of each registered query with its SQL twin."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fleetsight.plans import registry  # noqa: E402
from fleetsight.session import get_session  # noqa: E402
from fleetsight.sources.tables import TABLE_NAMES  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "smallint": "SMALLINT",
                 "float": "FLOAT", "tinyint": "TINYINT", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def canon_spark(t: str) -> str:
    if t.startswith("decimal"):
        return t.upper().replace(" ", "")
    return SPARK_TO_DUCK.get(t, t.upper())


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_session("local[4]", 8)
    registry.load_all()
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in sorted(registry.ORACLE):
        df = registry.QUERIES[name](spark, sf)
        st = {n: canon_spark(t) for n, t in df.dtypes}
        desc = con.execute(f"DESCRIBE {registry.ORACLE[name]}").fetchall()
        dt = {r[0]: r[1].replace(" ", "") for r in desc}
        diffs = [(c, st[c], dt.get(c)) for c in st if st[c] != dt.get(c)]
        if diffs:
            bad += 1
            print(name, diffs)
    print("queries with type differences:", bad)


if __name__ == "__main__":
    main()
