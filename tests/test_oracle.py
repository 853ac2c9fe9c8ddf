"""Every query that SQL can express, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from synblock.plans import catalogue

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(rows):
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(value(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, str(FOLDER))
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(want.fetchall())
