"""Physical plans: no nested loops, early rank limits, pruned scans, pushed filters."""

import pytest

from worldstate.plans import QUERIES


def plan_of(spark, name, folder):
    return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["zone_assign_many_zones", "entities_near", "containing_field", "focus_chunks", "chunk_contents", "players_per_zone", "diff_tables",
     "overload_report", "overload_with_transfers_due", "overload_messages", "zone_assign", "plan_transfers"],
)
def test_no_nested_loops(spark, small, name):
    plan = plan_of(spark, name, small)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["latest_state", "tick_sample", "keep_last_messages", "retry_schedule"])
def test_rank_limits_apply_before_the_shuffle(spark, small, name):
    plan = plan_of(spark, name, small)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scan_reads_needed_columns_only(spark, small):
    plan = plan_of(spark, "local_remote", small)
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "value" not in scan.split("Batched")[0] and "ts#" not in scan.split("Batched")[0]


def test_filters_reach_the_scan(spark, small):
    from worldstate.operators.store import find_by_id

    customers = spark.read.parquet(f"{small}/customer.parquet").withColumnRenamed("c_name", "uid")
    plan = find_by_id(customers, "x")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_name), EqualTo(c_name,x)]" in plan


def test_one_shuffle_for_a_chain_of_scans(spark, small):
    plan = plan_of(spark, "membership_intervals", small)
    assert plan.count("Exchange hashpartitioning") == 1
