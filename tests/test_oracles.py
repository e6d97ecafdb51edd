"""Every registered query against its SQL, on the smallest tables."""

import pytest

from tamarisk import queries as reference

QUERIES, SQL = reference.queries(), reference.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(same, name):
    same(QUERIES[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 1


def test_entry_point(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
