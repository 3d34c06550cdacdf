"""Every registered query against its independent SQL, and the driver contract."""

import pytest

import __spark_entry__ as entry_module
from checks.compare import connect, differences
from checks.oracle import ORACLE
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql_without_cross_join_or_python(spark, connection, name):
    df = entry_module.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "NestedLoop", "ArrowEvalPython", "BatchEvalPython"):
        assert word not in plan
    assert differences(df, connection, entry_module.oracle_sql()[name]) == []


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 30 and df.columns[0] == "zone_id"
