import duckdb
import pytest

from snapfeed.llm import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(llm, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = registry.QUERIES[name](llm, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
