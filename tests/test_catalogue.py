"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from evispan import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    got, order = df.collect(), sorted(df.columns)
    if name in catalogue.oracle_sql():
        cur = duck.execute(catalogue.oracle_sql()[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == order
        want = [dict(zip(cols, r)) for r in cur.fetchall()]
        key = lambda r: repr([r[c] for c in order])
        assert sorted(map(key, (r.asDict() for r in got))) == sorted(map(key, want))
