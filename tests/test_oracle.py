"""Every registered query against the same query in DuckDB."""

import pytest

import __spark_entry__ as registered
from compare import duck, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(registered.share_queries()) == set(registered.share_sql())


@pytest.mark.parametrize("key", list(registered.share_queries()))
def test_query(spark, con, key):
    columns, rows = spark_rows(registered.share_queries()[key](spark, SF))
    expected_columns, expected = duck_rows(con, registered.share_sql()[key])
    assert columns == expected_columns
    assert rows == expected


def test_entry(spark):
    assert registered.entry(spark).columns == ["bucket_start", "cnt", "sumdif"]
