import os

import duckdb
import pytest

import __spark_entry__ as entry
from plyset.llm import registry

DATA = "/root/testdata/sf0.001"


def test_all_twelve_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert [n for k in range(1, 13) for n in names if n.startswith(f"op{k}_")] == list(registry.QUERIES)
    assert len(registry.QUERIES) == 12 and "pipeline" in names
    assert all(isinstance(sql, str) for sql in registry.ORACLE_SQL.values()) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    told = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in told.description]
    df = registry.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, told.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())
