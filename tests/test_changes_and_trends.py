"""Changes between deliveries, subtotals, running costs and spans, on bills by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bills import bill, rows
from tallyloom.plans.changes import line_changes, refresh_changes
from tallyloom.plans.spans import idle_gaps, usage_spans
from tallyloom.plans.subtotals import rolled_up, subtotals
from tallyloom.plans.trends import month_over_month, running_costs

LINES = "identity_line_item_id string, line_item_unblended_cost double, tags map<string,string>"


def at(day, hour=0, month=6):
    return dt.datetime(2026, month, day, hour, tzinfo=dt.timezone.utc)


def test_changes_are_those_of_multisets(spark):
    old = [("same", 1.0, {"a": "1", "b": "2"}), ("dearer", 2.0, None), ("gone", 3.0, {}), ("copies", 5.0, None),
           ("copies", 5.0, None), ("copies", 5.0, None), (None, 7.0, None), (None, 7.0, None), (None, 8.0, None)]
    new = [("same", 1.0, {"b": "2", "a": "1"}), ("dearer", 2.5, None), ("new", 4.0, None), ("copies", 5.0, None),
           ("copies", 5.0, {"t": ""}), (None, 7.0, None), (None, 9.0, None), ("none", None, None)]
    old, new = (spark.createDataFrame(lines, LINES) for lines in (old, new))
    found = {(r.line_id, r.kind): (r.old_lines, r.new_lines, float(r.old_cost), float(r.new_cost)) for r in line_changes(old, new).where("line_id IS NOT NULL").collect()}
    assert found == {
        ("dearer", "changed"): (1, 1, 2.0, 2.5), ("gone", "removed"): (1, 0, 3.0, 0.0),
        ("new", "added"): (0, 1, 0.0, 4.0), ("copies", "changed"): (2, 1, 10.0, 5.0), ("none", "added"): (0, 1, 0.0, 0.0),
    }
    report = {row.kind: tuple(row)[1:] for row in refresh_changes(old, new).collect()}
    assert report == {
        "added": (0, 3, 0.0, 13.0, 13.0), "changed": (3, 2, 12.0, 7.5, -4.5),
        "removed": (3, 0, 18.0, 0.0, -18.0), "same": (3, 3, 13.0, 13.0, 0.0),
    }
    assert sum(row[-1] for row in report.values()) == 33.5 - 43.0
    same = refresh_changes(old, old).collect()
    assert [(row.kind, row.old_lines, row.difference_usd) for row in same] == [
        ("added", 0, 0.0), ("changed", 0, 0.0), ("removed", 0, 0.0), ("same", 9, 0.0),
    ]
    assert line_changes(old.limit(0), new.limit(0)).isEmpty()


def test_subtotals_multiply_groups_not_lines(spark):
    lines = bill(spark, *({"service": s, "region": r, "cost": c} for s, r, c in [("a", "x", 1.0), ("a", None, 2.0), ("b", "x", 4.0), ("a", "x", 8.0)]))
    dims = {"service": F.col("line_item_product_code"), "region": F.col("product_region_code")}
    frame = subtotals(lines, dims)
    assert rows(frame) == [
        (0, "a", "x", 9.0, 2), (0, "b", "x", 4.0, 1), (0, "a", None, 2.0, 1), (1, "a", None, 11.0, 3),
        (1, "b", None, 4.0, 1), (2, None, "x", 13.0, 3), (2, None, None, 2.0, 1), (3, None, None, 15.0, 4),
    ]
    plan = subtotals(lines, dims)._jdf.queryExecution().executedPlan().toString()
    # From the top: sums of sets, Expand, and below it both steps of the sums of lines.
    above, below = plan.split("Expand", 1)
    assert below.count("partial_sum") >= 1 and "Exchange hashpartitioning" in below and "Expand" not in below
    rolled = subtotals(lines, dims, sets=rolled_up(dims), sort=False)
    assert sorted(row.level for row in rolled.collect()) == [0, 0, 0, 1, 1, 3]
    assert rows(subtotals(lines, dims, where=[F.lit(False)])) == []


def test_days_without_charge_cost_nothing(spark, conf):
    conf("spark.sql.session.timeZone", "America/Los_Angeles")
    lines = bill(
        spark,
        {"resource": "r", "start": at(1, 23), "cost": 1.0}, {"resource": "r", "start": at(1, 1), "cost": 2.0},
        {"resource": "r", "start": at(4), "cost": 4.0}, {"resource": "r", "start": at(10), "cost": 8.0},
        {"resource": "s", "start": at(2), "cost": -1.0}, {"resource": "", "start": at(2)}, {"resource": "t"},
    )
    found = {(r.resource_id, r.usage_date.day): (r.cost_usd, r.cost_7_days_usd, r.cost_30_days_usd) for r in running_costs(lines).collect()}
    assert [key for key in found] == [("r", day) for day in range(1, 11)] + [("s", 2)]
    assert found["r", 1] == (3.0, 3.0, 3.0) and found["r", 3] == (0.0, 3.0, 3.0)
    assert found["r", 7] == (0.0, 7.0, 7.0) and found["r", 8] == (0.0, 4.0, 7.0)
    assert found["r", 10] == (8.0, 12.0, 15.0) and found["s", 2] == (-1.0, -1.0, -1.0)


def test_windows_run_over_sums(spark):
    plan = running_costs(bill(spark, {"resource": "r", "start": at(1)}))._jdf.queryExecution().executedPlan().toString()
    lines = [line.strip(" :+-*()0123456789") for line in plan.splitlines()]
    first_sum = next(n for n, line in enumerate(lines) if "partial_sum" in line)
    assert all(n < first_sum for n, line in enumerate(lines) if line.startswith("Window"))


def test_months_without_charge_cost_nothing(spark):
    lines = bill(spark, {"period": "2025-12", "cost": 2.0}, {"period": "2026-03", "cost": 6.0}, {"period": "2026-04", "cost": 3.0}, {"period": "2026-01", "service": None})
    found = rows(month_over_month(lines, {"service": F.col("line_item_product_code")}))
    assert found == [
        ("svc", "2025-12", 2.0, None, None, None), ("svc", "2026-01", 0.0, 2.0, -2.0, -1.0),
        ("svc", "2026-02", 0.0, 0.0, 0.0, None), ("svc", "2026-03", 6.0, 0.0, 6.0, None),
        ("svc", "2026-04", 3.0, 6.0, -3.0, -0.5), (None, "2026-01", 1.0, None, None, None),
    ]


@pytest.mark.parametrize("stretch", [3600, 86_400, 10**8])
def test_spans_merge_uses_that_overlap_or_touch(spark, stretch):
    uses = [("r", at(1, 0), at(1, 2)), ("r", at(1, 1), at(3, 0)), ("r", at(1, 2), at(1, 3)), ("r", at(2, 5), at(2, 6)),
            ("r", at(3, 0), at(3, 1)), ("r", at(3, 4), at(3, 5)), ("r", at(3, 5), at(3, 5)), ("s", at(1), at(2)),
            ("", at(1), at(9)), (None, at(1), at(9)), ("t", None, at(9)), ("t", at(9), at(8))]
    lines = spark.createDataFrame(uses, "line_item_resource_id string, line_item_usage_start_date timestamp, line_item_usage_end_date timestamp")
    plain = lambda moment: moment.replace(tzinfo=None)
    assert rows(usage_spans(lines, stretch_seconds=stretch)) == [
        ("r", plain(at(1)), plain(at(3, 5)), 2, 50.0, 3.0), ("s", plain(at(1)), plain(at(2)), 1, 24.0, 0.0),
    ]
    assert rows(idle_gaps(lines, stretch_seconds=stretch)) == [("r", plain(at(3, 1)), plain(at(3, 4)), 3.0)]
