"""Every query with SQL gives what DuckDB gives for it; the others run."""

import os

import duckdb
import pytest

import __spark_entry__
from glyphlake import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def comparable(value):
    return float(value) if hasattr(value, "as_tuple") else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, connection, name):
    got = plans.queries()[name](spark, SF)
    rows = got.collect()
    if name in plans.oracle_sql():
        want = connection.sql(plans.oracle_sql()[name])
        assert sorted(got.columns) == sorted(want.columns)
        order = sorted(got.columns)
        left = sorted(repr([comparable(r[c]) for c in order]) for r in rows)
        right = sorted(repr([comparable(r[want.columns.index(c)]) for c in order]) for r in want.fetchall())
        assert left == right


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
