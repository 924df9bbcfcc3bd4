"""Shape of the physical plans: no cross joins, no whole-table single task, Python only where state needs it."""

import pytest

import __spark_entry__ as entry
from clipledger import catalog

STREAMED = set(catalog.streams())
PYTHON = {
    "ttl_dedup", "inflight_dedup", "rate_limit_user", "rate_limit_channel", "admission_cascade", "admission_funnel",
    "resolver_cache_labels", "cache_hit_rates", "progress_debounce",
}
TOP_N = {"dedup_store_prune", "dedup_store_remainder"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - STREAMED))
def test_plan(spark, small, name):
    plan = plan_of(entry.queries()[name](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if "MapInArrow" in plan or "Python" in plan:
        assert name in PYTHON
    for line in plan.splitlines():
        if "Exchange SinglePartition" in line:
            # one partial row per task, or the k first rows of each
            below = plan[plan.index(line):]
            assert "partial_" in below or name in TOP_N


def test_limits_reach_the_map_side(spark, small):
    assert "WindowGroupLimit" in plan_of(entry.queries()["log_tail"](spark, small))


def test_scans_are_pruned(spark, small):
    plan = plan_of(entry.queries()["stage_averages"](spark, small))
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,error))" in plan
    plan = plan_of(entry.queries()["strategy_outcome"](spark, small))
    assert "l_comment" not in plan and "l_shipdate" not in plan
