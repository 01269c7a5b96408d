"""Every registered query against its oracle SQL, value by value."""

import duckdb
import pytest

from sweepline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "as_tuple") or (isinstance(v, int) and not isinstance(v, bool)):
        return float(v)
    return v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str)
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    said = oracle.sql(registry.ORACLE_SQL[name])
    assert sorted(said.columns) == names
    at = [said.columns.index(n) for n in names]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in said.fetchall()), key=str)
