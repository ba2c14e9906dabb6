"""Every registered query against its SQL twin on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from gaugeline.queries.registry import QUERIES

DIRECTORY = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    return compare.connect(DIRECTORY)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    columns, rows = compare.spark_rows(entry.queries()[name](spark, DIRECTORY))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    assert (columns, rows) == compare.duck_rows(duck, sql)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 8 and {r["status"] for r in rows} == {"ok"}
