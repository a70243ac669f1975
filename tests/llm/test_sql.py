"""Queries of this subpackage that SQL can express give the rows of that SQL."""

import os

import duckdb
import pytest

from cmdlake.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in sorted(os.listdir(DIR)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    got = queries.queries()[name](spark, DIR)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, (tuple(r[i] for i in order) for r in want.fetchall()))) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
