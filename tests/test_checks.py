"""Every registered query gives the rows of its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, name):
    ok, message = compare(spark, name, queries()[name], oracle_sql().get(name), FOLDER)
    assert ok, message
    assert "TYPES" not in message, message


def test_entry(spark):
    df = entry(spark)
    assert df.columns and df.count() > 0
