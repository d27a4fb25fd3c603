"""Physical-plan properties the design relies on (checked on the driver's sf0.001 tables)."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def qs():
    return E.queries()


@pytest.mark.parametrize("name", ["asof_nearest", "create_features", "detect_join_key", "rolling_folds",
                                  "roads_with_traffic", "crowd_flow_map", "topk_series"])
def test_no_cartesian_or_nested_loop(spark, qs, name):
    plan = plan_text(qs[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_filter_and_projection_reach_the_scan(spark, qs):
    plan = plan_text(qs["filter_sensors"](spark, SF))
    assert re.search(r"PushedFilters: \[In\(user_id", plan)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan


def test_lag_windows_partition_by_bucket_not_sensor_alone(spark, qs):
    plan = plan_text(qs["lag_features"](spark, SF))
    lag_windows = [ln for ln in plan.splitlines() if "Window [" in ln and "lag(" in ln]
    assert lag_windows
    for ln in lag_windows:
        partition_spec = ln.rsplit("], [", 2)[-2]
        assert "_bucket" in partition_spec, ln
    # the only window keyed by sensor alone is the prefix sum over per-(sensor, day) counts
    for ln in plan.splitlines():
        if "Window [" in ln and "lag(" not in ln and "row_number" not in ln:
            assert "sum(_n" in ln, ln


def test_tail_n_limits_before_the_shuffle(spark, qs):
    plan = plan_text(qs["tail_n_per_key"](spark, SF))
    # a partial WindowGroupLimit sits below the exchange, a final one above it
    assert plan.count("WindowGroupLimit") >= 2


def test_latest_per_key_is_an_aggregate(spark, qs):
    plan = plan_text(qs["latest_per_key"](spark, SF))
    assert "max_by" in plan and "Window" not in plan


def test_flagship_uses_no_python(spark):
    plan = plan_text(E.entry(spark))
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
