"""Every named query against its SQL, and the shape of its physical plan."""

import pytest

from noticelake.plans import streams  # noqa: F401  (registers its queries)
from noticelake.plans.catalog import CATALOG, oracle_sql, queries
from tests.check import compare, duck

ALL_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, con, sf, name):
    df = queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in ALL_PAIRS if op in plan]
    assert compare(con, df, oracle_sql().get(name)) is None


def test_only_the_needed_columns_are_read(spark, sf):
    plan = queries()["district_pages"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert "o_totalprice" not in plan and "c_mktsegment" not in plan


@pytest.mark.parametrize("name", ["unsent_matches", "facets", "trailing_yield"])
def test_top_k_is_pruned_before_the_shuffle(spark, sf, name):
    plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
