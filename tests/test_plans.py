"""Shapes of the physical plans that the scaling rests on."""

import re

import pytest

from riffle.plans import queries

SF_DIR = "/root/testdata/sf0.001"


def plan_of(spark, name):
    """Physical plan, with automatic broadcasts off as they would be for large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return queries.registered()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def count(plan, operator):
    return len(re.findall(rf"^[\s:+|-]*(?:\*\(\d+\) )?{operator}\b", plan, re.M))


@pytest.mark.parametrize("name", ["clean_readings_latest", "conflict_filter", "current_levels", "current_levels_networks"])
def test_history_is_reduced_by_hash_aggregates_alone(spark, name):
    plan = plan_of(spark, name)
    assert count(plan, "HashAggregate") > 0
    for operator in ("SortAggregate", "Window", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert count(plan, operator) == 0, operator


@pytest.mark.parametrize("name", sorted(queries.registered()))
def test_no_query_uses_a_cross_join_or_python(spark, name):
    plan = plan_of(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert operator not in plan, operator


def test_series_windows_run_per_network_and_month(spark):
    plan = plan_of(spark, "level_ranges_networks")
    windows = re.findall(r"Window \[.*", plan)
    assert len(windows) == 2
    assert "hashpartitioning(network_id" in plan and "REPARTITION_BY_COL" in plan
    # Rows are spread by network and month; only the carry rows come together per network.
    assert re.search(r"Exchange hashpartitioning\(network_id#\w+, time_block#\w+", plan)


def test_both_readers_of_the_clean_readings_share_a_shuffle(spark):
    df = queries.level_ranges_networks(spark, SF_DIR)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = plan_of(spark, "lookback_24h")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in plan and "LessThanOrEqual(ts,2024-01-25T00:00)" in plan
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "props" not in schema and "value" not in schema


def test_views_pivot_only_the_gauges_they_need(spark):
    plan = plan_of(spark, "forecast_view")
    # Staircase needs gauges 2 and 3, The Canyon 4 and 5, and its maximum series also 6.
    assert set(re.findall(r"AS (?:flow_cfs|stage_ft)_(\d+)#", plan)) == {"2", "3", "4", "5", "6"}


def test_network_tables_are_not_put_in_total_order(spark):
    total = r"Sort \[.*\], true"
    assert not re.search(total, plan_of(spark, "current_levels_networks"))
    assert re.search(total, plan_of(spark, "current_levels"))
