import os

import pytest

import __spark_entry__ as entry
from oracle import connect, differences

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, connection, name):
    assert differences(entry.queries()[name](spark, FOLDER), connection, entry.oracle_sql()[name]) == []


def test_flagship_query(spark):
    assert entry.entry(spark).count() == 8
