"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from catalog import CATALOG
from check_queries import compare, duck
from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SMALL, name)
    assert ok, note


def test_contract(spark):
    assert contract.entry(spark).count() == 3
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", [n for n in CATALOG if not n.startswith(("s0", "s1", "st1", "f12", "j14", "a27", "a3", "a4", "d10", "a22", "j11"))])
def test_no_cross_join(spark, name):
    plan = CATALOG[name][0](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
