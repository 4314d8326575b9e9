"""Every registered query that has a SQL statement agrees with it on the smallest data set."""

import os

import duckdb
import pytest

from checks.compare import TABLES, rows_of
from checks.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    want_cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(want_cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want_cols, cur.fetchall())
