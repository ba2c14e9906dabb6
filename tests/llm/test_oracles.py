"""Queries with an SQL twin against it on two sizes."""

import compare
import pytest

from gaugeline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name, size):
    directory = f"/root/testdata/{size}"
    columns, rows = compare.spark_rows(QUERIES[name](spark, directory))
    assert (columns, rows) == compare.duck_rows(compare.connect(directory), ORACLES[name])
