"""Every query with SQL equals DuckDB on the smallest tables."""

import duckdb
import pytest

from cinetide import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(name, spark, small, duck):
    df = Q.QUERIES[name](spark, small)
    if name not in Q.ORACLES:
        assert df.count() > 0
        return
    relation = duck.sql(Q.ORACLES[name])
    assert sorted(relation.columns) == sorted(df.columns)
    want = sorted(map(str, relation.fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(relation.columns).collect()) == want
