"""Every core query against its SQL on the smallest tables; those without SQL must run."""

import pytest

from quirefold.plans import core
from tests.oracle import connect, same

WITH_SQL = sorted(core.oracle_sql())


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, data, con, name):
    same(core.queries()[name](spark, data), con, core.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(WITH_SQL)))
def test_runs(spark, data, name):
    df = core.queries()[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
