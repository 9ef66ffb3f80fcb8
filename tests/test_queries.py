"""Every query against its SQL, and those without SQL for rows."""

import pytest

from lectern.plans.registry import ORACLES, QUERIES
from tests.oracle import DATA, duck, same


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, con, name):
    same(con, QUERIES[name](spark, DATA), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
