"""Every registered query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

from conftest import SF_SMALL
from fleetsight.plans import registry
from fleetsight.sources.tables import TABLE_NAMES
from oracle_check import rows_of
from type_check import canon_spark

registry.load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    recs = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLE:
        assert len(cols) > 0
        return
    cur = con.execute(registry.ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orecs = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert rows_of(cols, recs, False) == rows_of(ocols, orecs, False)
    # column types agree too (Spark type names mapped to DuckDB's)
    otypes = {r[0]: r[1].replace(" ", "") for r in con.execute(f"DESCRIBE {registry.ORACLE[name]}").fetchall()}
    assert {n: canon_spark(t) for n, t in df.dtypes} == otypes
