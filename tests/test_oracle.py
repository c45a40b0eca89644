"""Every registered query against its DuckDB statement on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect

FOLDER = os.environ.get("ITEMLAKE_TEST_DATA", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ok, message = compare(spark, duck, FOLDER, name, QUERIES[name], SQL.get(name))
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["paper_id", "question_id"]
