"""What the physical plans must, and must not, contain."""

import re

import pytest

from conftest import SF_DIR
from tallyloom.checks.order_bill import order_bill
from tallyloom.checks.registry import MONTH, REPORTS, all_queries
from tallyloom.sources.bill import read_bill
from tallyloom.sources.conform import conform

QUERIES = all_queries()


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(conf):
    """Plan as for tables too large to broadcast."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_no_python_no_forced_broadcast(spark, large, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text
    assert "Broadcast" not in text or name in MEASURED
    assert "SinglePartition" not in text or name in SINGLE_TASK


# Reports whose last step brings together one row per task, or the top rows.
SINGLE_TASK = {
    f"{name}{suffix}"
    for name in (
        "grand_total", "reconcile", "unattributed_share", "top_resources", "amortized_total",
    )
    for suffix in ("", "_month")
} | {"column_profile", "conformed_profile", "preview"}


# Joins that broadcast a side, after its rows and size were measured.
MEASURED = {"usage_in_terms", "usage_in_terms_month"}
# Reports that set lines or sums in order of time, or join them; see their own tests.
OVER_TIME = {
    "cost_by_tag_as_of", "usage_in_terms", "running_costs", "month_over_month", "usage_spans",
    "idle_gaps",
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A bill table, whose reports need no joins."""
    path = str(tmp_path_factory.mktemp("bill"))
    conform(order_bill(spark, SF_DIR, period=MONTH)).write.mode("append").partitionBy(
        "billing_period"
    ).parquet(path)
    return read_bill(spark, path)


@pytest.mark.parametrize("name", sorted(set(REPORTS) - {"shared_resources"} - OVER_TIME))
def test_groups_are_summed_before_they_are_shuffled(stored, large, name):
    """Right below every shuffle by group lies an aggregate within the task."""
    text = plan(REPORTS[name][0](stored, None))
    lines = text.split("\n")
    dealt = [n for n, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert dealt or "SinglePartition" in text
    for n in dealt:
        assert re.search(r"HashAggregate\(keys=\[.*functions=\[(partial_|merge_|\])", lines[n + 1])
    assert "partial_sum" in text and "Join" not in text
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text


@pytest.mark.parametrize("name", ["shared_resources", "shared_resources_month"])
def test_shared_resources_reads_the_bill_once(spark, large, name):
    frame = QUERIES[name](spark, SF_DIR)
    frame.collect()
    final = plan(frame).split("Initial Plan")[0]
    assert "ReusedExchange" in final
    assert "hashpartitioning(resource_id#" in final and ", salt#" in final


def test_top_resources_keeps_n_rows_per_task(spark):
    assert "TakeOrderedAndProject(limit=20" in plan(QUERIES["top_resources"](spark, SF_DIR))


def test_month_reaches_the_scan(spark):
    text = plan(QUERIES["cost_by_service_month"](spark, SF_DIR))
    assert "GreaterThanOrEqual(l_shipdate," in text and "LessThan(l_shipdate," in text
    assert MONTH in text


@pytest.mark.parametrize(
    "name, tables",
    [
        ("grand_total", {"lineitem"}),
        ("unattributed_share", {"lineitem"}),
        ("cost_by_service", {"lineitem", "part"}),
        ("cost_by_principal", {"lineitem", "orders"}),
        ("cost_by_resource", {"lineitem", "part", "supplier", "nation"}),
    ],
)
def test_only_tables_that_are_needed_are_joined(spark, name, tables):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert set(re.findall(r"/(\w+)\.parquet", text)) == tables


def test_grand_total_reads_two_columns(spark):
    text = plan(QUERIES["grand_total"](spark, SF_DIR))
    assert "ReadSchema: struct<l_linenumber:int,l_extendedprice:double>" in text
