"""Every registered query with SQL gives the rows of that SQL."""

import os

import duckdb
import pytest

from cmdlake.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(DIR)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    got, want = registry.queries()[name](spark, DIR).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # engines differ only in how a null or a timestamp is held
        if str(want[c].dtype).startswith("datetime"):
            got[c], want[c] = got[c].astype("datetime64[us]"), want[c].astype("datetime64[us]")
    assert rows(got) == rows(want)
