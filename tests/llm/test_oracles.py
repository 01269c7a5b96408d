"""Queries of this subpackage against their oracle SQL, value by value."""

import duckdb
import pytest

from sweepline.llm import queries
from tests.llm.helpers import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    said = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(said.columns) == sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*said.columns).collect()), key=str)
    assert rows == sorted(said.fetchall(), key=str)
    assert len(rows) > 20
