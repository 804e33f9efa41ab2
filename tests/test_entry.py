"""The driver's contract: the flagship runs, queries with SQL agree with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from burstline import queries as engine

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[:4] == ["session_id", "event_number", "start_time", "end_time"]


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_against_sql(spark, con, name):
    ours = engine.QUERIES[name](spark, SF)
    theirs = con.sql(engine.ORACLE_SQL[name])
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    pick = lambda columns, data: sorted((tuple(_plain(r[columns.index(c)]) for c in order) for r in data), key=repr)
    assert pick(ours.columns, [tuple(r) for r in ours.collect()]) == pick(theirs.columns, theirs.fetchall())
