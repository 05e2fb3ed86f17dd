"""Every query runs; every check but the listed ones has SQL; queries equal their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
import check
from resultloom import registry

ROWS_ONLY: set = set()
QUERIES = registry.queries()


def test_registry():
    assert set(QUERIES) - set(registry.oracle_sql()) == ROWS_ONLY
    assert set(QUERIES) <= set(entry_point.queries())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0 and "tier" in df.columns


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, folder, con, name):
    out = check.compare(spark, name, QUERIES[name], registry.oracle_sql().get(name), folder, con)
    assert out.startswith(("ok  ", "rows only")), out
