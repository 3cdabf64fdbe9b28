"""Queries of the operators against the SQL that gives the same rows, over the smallest tables."""

import os

import pytest

from patternloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    result = con.execute(queries.ORACLE_SQL[name])
    assert sorted(c[0] for c in result.description) == sorted(df.columns)
    want = sorted(result.fetchall())
    got = sorted(tuple(r[c[0]] for c in result.description) for r in df.collect())
    assert got == want
