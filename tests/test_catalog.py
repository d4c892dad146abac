"""Every registered query with SQL gives what that SQL gives, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_sql import difference, duck

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck("0.001")


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf, con, name):
    got = queries()[name](spark, sf).toPandas()
    assert difference(got, con.sql(oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry(spark).count() == 7
