"""The llm queries that have a DuckDB twin give its rows."""

import os
from pathlib import Path

import pytest

from broadsheet.llm import oracle, queries

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_rows_equal_the_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in sorted(DATA.glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = queries.queries()[name](spark, str(DATA))
    cur = con.execute(oracle.oracle_sql()[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == sorted(df.columns)
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    assert order([tuple(r[c] for c in theirs) for r in df.collect()]) == order(cur.fetchall())
