"""Every registered query against its SQL, on the smallest of the given tables."""

import os

import pytest
from oracle import compare, duck

import __spark_entry__ as registry

FOLDER = os.environ.get("TERRIER_TEST_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, FOLDER)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) is None


def test_plans_have_no_cross_join_and_no_python_outside_simplify(spark):
    for name in ("level_region", "iqr_filter", "point_in_zone", "tile_assign", "region_lookup"):
        plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "Python" not in plan and "Arrow" not in plan, name


def test_entry(spark):
    assert registry.entry(spark).count() > 0
