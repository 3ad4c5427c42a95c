"""Corpus queries against their SQL in DuckDB, on whole small tables."""

import os

import duckdb
import pytest

from gradewell.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return [names[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLE_SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in found.description], found.fetchall())
