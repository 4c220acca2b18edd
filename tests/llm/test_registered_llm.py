"""Queries with SQL against it, on the smallest files."""

import pytest

import __spark_entry__ as registered
from footfall.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, differences
from tests.llm.conftest import SMALL

NAMES = [q.__name__ for q in QUERIES]


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_all_are_registered():
    assert [n.split("_")[0] for n in NAMES] == [f"op{i}" for i in range(1, 14)]
    assert {*NAMES, "pipeline"} <= set(registered.queries())
    assert set(ORACLE_SQL) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, connection, name):
    assert differences(registered.queries()[name](spark, SMALL), connection, ORACLE_SQL[name]) == []
