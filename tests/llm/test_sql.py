import pytest

from tamarisk.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(same, name):
    same(llm.queries()[name], SQL[name])
