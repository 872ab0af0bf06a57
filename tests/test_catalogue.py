"""Each query of the catalogue against its SQL, and the shape of plans that matter at scale."""

import pytest
from compare import assert_same

import recordspark.plans.stores  # noqa: F401  adds its queries
from recordspark.plans.catalogue import ORACLE, QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(name, spark, duck, data):
    df = QUERIES[name](spark, data)
    assert_same(df, duck.execute(ORACLE[name]))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_document_filters_reach_the_scan(spark, data):
    p = plan(QUERIES["where_eq_range"](spark, data))
    assert "EqualTo(o_orderstatus,O)" in p and "GreaterThanOrEqual(o_totalprice,1000.0)" in p
    assert "LessThan(o_totalprice,50000.0)" in p


def test_columns_are_pruned(spark, data):
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan(QUERIES["get_all_keys"](spark, data))


def test_top_k_is_not_a_full_sort(spark, data):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_k"](spark, data))
    assert "TakeOrderedAndProject" in plan(QUERIES["limit_offset"](spark, data))


def test_versions_are_limited_before_the_shuffle(spark, data):
    assert plan(QUERIES["lww_dedup"](spark, data)).count("WindowGroupLimit") >= 2


def test_ranges_are_broadcast_only_when_few(spark, data):
    assert "BroadcastNestedLoopJoin" in plan(QUERIES["range_tombstone"](spark, data))
    assert "BroadcastNestedLoopJoin BuildRight, LeftAnti" not in plan(QUERIES["range_tombstone_many"](spark, data))
