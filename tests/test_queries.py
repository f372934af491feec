import os

import pytest

import __spark_entry__ as se

SF_DIR = os.environ.get("SERIESMITH_TEST_DIR", "/root/testdata/sf0.001")
WITH_SQL = sorted(se.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    from check import connect

    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(se.oracle_sql()) <= set(se.queries())


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, duck, name):
    from check import compare

    ok, note = compare(spark, duck, name, SF_DIR)
    assert ok, note


def test_flagship(spark):
    assert se.entry(spark).count() > 0
