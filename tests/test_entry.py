import duckdb
import pytest

import __spark_entry__ as E
from snapfeed.sources.tables import TABLES
from tools.oracle_check import norm

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and df.columns == ["host", "n_items", "n_distinct_items"]


def test_every_query_has_an_oracle():
    assert set(E._QUERIES) <= set(E.oracle_sql()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E._QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    got = sorted((tuple(norm(x) for x in r) for r in sdf.collect()), key=repr)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == sorted(sdf.columns)
    idx = [ocols.index(c) for c in sdf.columns]
    exp = sorted((tuple(norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert got == exp
