import duckdb
import pytest

from tessellar.plans import codec, raster

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


QUERIES, SQL = raster.QUERIES | codec.QUERIES, raster.oracle_sql() | codec.oracle_sql()


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, oracle, name):
    want = oracle.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert set(got.columns) == set(columns)
    rows = sorted(map(str, map(tuple, got.select(*columns).collect())))
    assert rows and rows == sorted(map(str, want.fetchall()))
