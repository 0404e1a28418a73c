"""Every query runs on the smallest tables, and those with SQL give the same rows there."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import cell

from strandloom.plans import catalogue


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in sorted(os.listdir(small)):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, con, name):
    df = catalogue.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(cell(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql is not None:
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols
        assert got == sorted((tuple(cell(v) for v in r) for r in rel.select(*cols).fetchall()), key=repr)


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.queries()) <= set(e.queries())
