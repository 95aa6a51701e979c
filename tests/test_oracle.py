"""Every registered query of the engine's own operators against its SQL."""

import pytest

from tests.oracle import differences, views
from tributary.plans.registry import oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    assert differences(queries()[name](spark, sf), con, oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf, name):
    df = queries()[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).limit(1).count() == 1
