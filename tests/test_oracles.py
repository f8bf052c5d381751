"""Every query of the core that has SQL gives what DuckDB gives on the smallest data."""

import math
from pathlib import Path

import duckdb
import pytest

from folioscope.plans.registry import collected

DATA = Path("/root/testdata/sf0.001")
ORACLES = collected("ORACLES")


def same(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value if isinstance(value, (bool, int)) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    ours = collected("QUERIES")[name](spark, str(DATA))
    columns = sorted(ours.columns)
    theirs = duck.sql(ORACLES[name])
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted((tuple(same(r[c]) for c in columns) for r in ours.collect()), key=key) == sorted((tuple(same(r[i]) for i in at) for r in theirs.fetchall()), key=key)
