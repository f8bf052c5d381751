from pathlib import Path

import duckdb
import pytest

from folioscope.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    theirs = con.sql(ORACLES[name])
    ours = QUERIES[name](spark, str(DATA)).select(*theirs.columns).collect()
    key = lambda row: tuple(str(v) for v in row)
    near = lambda row: tuple(pytest.approx(v, abs=2e-6) if isinstance(v, float) else v for v in row)
    assert [tuple(r) for r in sorted(ours, key=key)] == [near(r) for r in sorted(theirs.fetchall(), key=key)]


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.count() == df.distinct().count() > 0
