"""The registered SQL equals the queries on the smallest tables."""

import duckdb
import pytest

from cinetide.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(name, spark, small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    relation = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, small)
    assert sorted(relation.columns) == sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(relation.columns).collect()) == sorted(map(str, relation.fetchall()))
