"""Every query against its SQL on the smallest tables."""

import pytest

from glimmerline.catalog import ORACLE, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="session")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, data, con, name):
    assert compare(spark, con, data, name, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0


def test_entry(spark, data):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).columns[0] == "finding_id"
