"""Every query with a DuckDB twin gives its rows; the others run and keep their invariants."""

import datetime
import decimal
import os
import re
from pathlib import Path

import pytest

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(DATA.glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 8) + 0.0
    if isinstance(v, datetime.datetime):
        return v.astimezone(datetime.UTC).replace(tzinfo=None) if v.tzinfo else v
    return v


def ordered(rows):
    return sorted(([plain(v) for v in r] for r in rows), key=lambda r: [(v is None, type(v).__name__ if not isinstance(v, int | float) else "", str(v)) for v in r])


def names():
    from broadsheet.plans import registry

    return sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", names())
def test_rows_equal_the_twins(spark, duck, name):
    from broadsheet.plans import registry

    df = registry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    cur = duck.execute(registry.oracle_sql()[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == cols
    want = [[r[theirs.index(c)] for c in cols] for r in cur.fetchall()]
    assert ordered([r[c] for c in cols] for r in df.collect()) == ordered(want)


@pytest.mark.parametrize("name", ["normalize_unicode", "seq_ratio", "kmeans", "map_projection", "sample_stratified_cluster", "train_test_split", "largest_component", "merge_groups", "fix_content", "llm_ads", "class_tfidf", "top_terms_topic"])
def test_rows_only_queries_run(spark, name):
    from broadsheet.plans import registry

    assert registry.queries()[name](spark, str(DATA)).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in e.queries())
