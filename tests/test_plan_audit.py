"""Every registered query: no cross joins, no Python evaluation, no unbounded single-task step."""

import pytest

from cuebook.plans.catalog import all_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_plan_is_scale_safe(spark, name):
    df = all_queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("MemorySink", "MemoryPlan", "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in plan, (name, bad)
    # A single-partition exchange is only allowed above an aggregate or a top-k (bounded rows),
    # or over the per-partition offset tables (bounded by the partition count).
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = "\n".join(lines[i + 1:i + 4])
            assert any(k in below for k in ("HashAggregate", "TakeOrderedAndProject", "GlobalLimit",
                                            "LocalLimit", "ObjectHashAggregate", "SortAggregate",
                                            "Scan ExistingRDD")), (name, below)
