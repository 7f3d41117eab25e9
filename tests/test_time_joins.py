"""As-of and interval joins against all pairs."""

import datetime as dt
import random

import pytest

from tallyloom.checks.order_bill import BILL_COLUMNS, order_bill
from tallyloom.operators.as_of import as_of
from tallyloom.operators.intervals import in_terms, overlapping
from tallyloom.plans.commitments import usage_in_terms
from tallyloom.plans.tags_as_of import tagged_as_of
from conftest import SF_DIR

START = dt.datetime(2026, 1, 30)


def moment(draw, days=5):
    return draw.choice([None] + [START + dt.timedelta(minutes=draw.randint(-60 * 24 * days, 60 * 24 * days))] * 9)


def plan_of(frame):
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, kind, strict):
    draw = random.Random(1)
    keys = ["hot"] * 6 + ["b", "c", None, ""]
    rows = [(n, draw.choice(keys), moment(draw)) for n in range(400)]
    events = [(draw.choice(keys), moment(draw), draw.choice(["x", "y", None]), n) for n in range(60)]
    rows += [(1000 + n, key, at) for n, (key, at, _, _) in enumerate(events)]  # at the same time
    events += [(key, at, "tie", -1) for key, at, _, _ in events[:20]]

    def latest(key, at):
        if key is None or at is None:
            return None
        before = [e for e in events if e[0] == key and e[1] is not None and (e[1] < at or not strict and e[1] == at)]
        best = max(before, key=lambda e: (e[1], e[2] is not None, e[2] or "", e[3]), default=None)
        return best and best[1:]

    left = spark.createDataFrame(rows, f"n int, `the key` string, time {kind}")
    right = spark.createDataFrame(events, f"`the key` string, at {kind}, value string, number int")
    for stretch in (600, 86_400, 10**7):
        found = as_of(left, right, ["the key"], "time", ["value", "number"], "at", strict, stretch)
        assert found.columns == ["n", "the key", "time", "as_of"]
        got = {row.n: row.as_of and tuple(row.as_of) for row in found.collect()}
        assert got == {n: latest(key, at) for n, key, at in rows}
    assert as_of(left, right.limit(0), ["the key"], "time", ["value"], "at").where("as_of IS NOT NULL").isEmpty()
    assert as_of(left.limit(0), right, ["the key"], "time", ["value"], "at").isEmpty()


def test_as_of_sets_a_hot_key_in_order_by_stretches(spark):
    bill = order_bill(spark, SF_DIR, BILL_COLUMNS)
    plan = plan_of(tagged_as_of(bill, "user_project"))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan
    windows = [part for part in plan.split("\n\n") if " Window\n" in part]
    assert windows and all("_stretch" in part for part in windows)


def pairs_of(frame, left, right):
    return sorted((row[left].n, row[right].m) for row in frame.collect())


def spans(draw, n, longest):
    found = []
    for number in range(n):
        start = moment(draw, 40)
        length = dt.timedelta(minutes=draw.choice([-5, 0, 1, 59, 60, 61, longest, draw.randint(0, longest)]))
        found.append((number, draw.choice("ab"), start, start and draw.choice([start + length] * 9 + [None])))
    return found


def test_rows_in_terms_and_overlapping_spans(spark):
    draw = random.Random(2)
    rows = [(n, draw.choice(["a", "b", None]), moment(draw, 40)) for n in range(200)]
    terms, others = spans(draw, 60, 60 * 24 * 60), spans(draw, 60, 60 * 24)
    rows += [(1000 + n, key, at) for n, key, *both in terms for at in both]
    left = spark.createDataFrame(rows, "n int, key string, at timestamp")
    right = spark.createDataFrame(terms + terms[:3], "m int, key string, start timestamp, end timestamp")
    wanted = sorted(
        (n, m) for n, key, at in rows for m, other, start, end in terms + terms[:3]
        if key == other and at and start and end and start <= at < end
    )
    for small in (0, 20_000):
        found = in_terms(left, right, ["key"], "at", "start", "end", small)
        assert pairs_of(found, "row", "term") == wanted and wanted
    no_key = in_terms(left, right, [], "at", "start", "end")
    assert no_key.count() > found.count()
    assert in_terms(left, right.limit(0), ["key"], "at", "start", "end").isEmpty()
    short = spark.createDataFrame(others, "n int, key string, begins timestamp, ends timestamp")
    wanted = sorted(
        (n, m) for n, key, a, b in others for m, other, start, end in terms
        if key == other and a and b and start and end and a < b and start < end and a < end and start < b
    )
    once = spark.createDataFrame(terms, right.schema)
    for small in (0, 20_000):
        found = overlapping(short, once, ["key"], "begins", "ends", "start", "end", small)
        assert pairs_of(found, "left", "right") == wanted and wanted


def test_commitments_are_joined_by_equal_cells(spark):
    columns = (
        "line_item_product_code", "line_item_usage_type", "line_item_line_item_type",
        "line_item_usage_start_date", "line_item_unblended_cost", "savings_plan_savings_plan_a_r_n",
        "savings_plan_start_time", "savings_plan_end_time",
    )
    bill = order_bill(spark, SF_DIR, columns)
    by_broadcast = usage_in_terms(bill)
    by_salt = usage_in_terms(bill, small_rows=0)
    for frame in (by_broadcast, by_salt):
        plan = plan_of(frame)
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "_salt" in plan_of(by_salt) and by_salt.collect() == by_broadcast.collect()
