"""Estimates from merged sketches against exact figures, within the stated bounds."""

import random

import pytest

from pyspark.sql import functions as F

from tallyloom.plans.sketches import (
    COUNT_BOUND,
    DISTINCT_BOUND,
    RANK_BOUND,
    TRACKED,
    estimates,
    frequent_payers,
    merged,
    monthly_sketches,
)

SCHEMA = "billing_period string, line_item_resource_id string, line_item_iam_principal string, line_item_unblended_cost double"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    draw = random.Random(5)
    rows = []
    for n in range(40_000):
        month = f"2026-{1 + n % 4:02d}"
        payer = f"p{min(int(draw.expovariate(1 / 400)), 3000)}" if n % 5 else draw.choice(["", None])
        rows.append((month, draw.choice(["", None] + [f"r{draw.randint(0, 30_000)}"] * 6), payer, draw.lognormvariate(0, 2)))
    rows.append(("2026-01", None, None, None))
    bill = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path_factory.mktemp("sketches") / "months")
    monthly_sketches(bill).write.parquet(path)
    return rows, spark.read.parquet(path)


def test_months_merge_into_a_year(stored):
    rows, months = stored
    assert months.count() == 4
    row = estimates(merged(months), (0.01, 0.5, 0.99)).first()
    assert row.lines == len(rows) and row.months == "all"
    resources = len({row[1] for row in rows if row[1]})
    assert abs(row.distinct_estimate - resources) <= DISTINCT_BOUND * resources
    costs = [row[3] for row in rows if row[3] is not None]
    for share, value in zip((0.01, 0.5, 0.99), row.quantile_estimates):
        assert abs(sum(cost <= value for cost in costs) / len(costs) - share) <= RANK_BOUND
    by_half = merged(months, (F.col("billing_period") > "2026-02").cast("string"), "late")
    assert sorted((row.late, row.lines) for row in estimates(by_half).collect()) == [("false", 20_001), ("true", 20_000)]


def test_frequent_payers_are_within_the_bound(stored):
    rows, months = stored
    exact = {}
    for row in rows:
        if row[2]:
            exact[row[2]] = exact.get(row[2], 0) + 1
    assert len(exact) > TRACKED
    found = frequent_payers(merged(months), 5).collect()
    slack = COUNT_BOUND * len(rows)
    assert len(found) == 5 and all(abs(row.lines - exact[row.iam_principal]) <= slack for row in found)
    best = sorted(exact.values(), reverse=True)
    assert min(exact[row.iam_principal] for row in found) >= best[4] - 2 * slack


def test_nothing_to_sketch(spark):
    empty = monthly_sketches(spark.createDataFrame([], SCHEMA))
    assert empty.isEmpty() and merged(empty, F.lit("x")).isEmpty()
    blank = monthly_sketches(spark.createDataFrame([("2026-01", "", None, 1.0)], SCHEMA))
    row = estimates(blank).first()
    assert (row.lines, row.cost_usd, row.distinct_estimate) == (1, 1.0, 0)
    assert frequent_payers(blank).isEmpty()
