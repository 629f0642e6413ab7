"""Every query with an SQL twin gives the same rows on the smallest test tables."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as E

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def rows(frame):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = E.queries()[name](spark, str(DATA)).toPandas(), con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert E.entry(spark).count() > 0
