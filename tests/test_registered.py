"""Every registered query against its SQL, on the smallest files."""

import pytest

import __spark_entry__ as registered
from footfall.plans.oracle import ORACLE_SQL as LIBRARY_SQL
from footfall.plans.queries import QUERIES as LIBRARY_QUERIES
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
ORACLE = LIBRARY_SQL
QUERIES = {q.__name__: registered.queries()[q.__name__] for q in LIBRARY_QUERIES}


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql_but_clustering():
    assert set(QUERIES) - set(ORACLE) == {"fit_segments", "k_sweep", "segmentation_report"}
    assert not set(ORACLE) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, FOLDER), connection, ORACLE[name]) == []


def test_entry(spark):
    rows = registered.entry(spark).collect()
    assert [r["month"] for r in rows] == sorted(r["month"] for r in rows)
    assert rows[0]["mom_growth_pct"] is None and len(rows) > 12
