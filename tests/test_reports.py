"""Edge cases and invariants of the reports on bills written out by hand."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bills import bill, rows
from tallyloom.plans import adjust, rank, reconcile, reports
from tallyloom.operators.cost_report import cost_report, grouped_totals
from tallyloom.operators.sql import sql_report
from tallyloom.functions.amounts import cost
from tallyloom.functions.amounts import lines as count_lines


@pytest.fixture(scope="module")
def golden(spark):
    """A bill with the published totals; 'res/rest' carries the remainder."""
    return bill(
        spark,
        {"resource": "", "type": "SavingsPlanRecurringFee", "cost": 14475.58},
        {"resource": None, "type": "Usage", "cost": 2661.78},
        {"resource": "", "type": "BundledDiscount", "cost": -35.77},
        {"resource": None, "type": "SavingsPlanNegation", "cost": -2568.41},
        {"resource": "res/rest", "type": "Usage", "cost": 15293.83},
    )


@pytest.fixture(scope="module")
def blanks(spark):
    """Every kind of missing resource, principal, region and tag."""
    lines, n = [], 0
    for resource in ("r1", "", None):
        for principal in ("p1", "", None):
            for tags in ({"user_owner": "o1"}, {"user_owner": ""}, {"other": "x"}, {}, None):
                n += 1
                lines.append(
                    {
                        "resource": resource,
                        "principal": principal,
                        "region": ("eu", "", None)[n % 3],
                        "resource_tags": tags,
                        "cost": float(2**n) * (-1) ** n,
                    }
                )
    return bill(spark, *lines)


def test_published_reconciliation(golden):
    row = reconcile.reconcile(golden, "2026-06").first()
    assert row.grand_total_usd == row.report_total_usd == 29827.01
    assert row.difference_usd == 0.0
    assert row.raw_line_items == row.report_lines == 5


def test_published_share(golden):
    row = reconcile.unattributed_share(golden, "2026-06").first()
    assert row.grand_total_usd == 29827.01
    assert row.unattributed_usd == 14533.18
    assert row.attributed_usd == 15293.83
    assert round(row.unattributed_share, 3) == 0.487


def test_published_no_resource_types(golden):
    assert rows(reconcile.no_resource_by_type(golden)) == [
        ("SavingsPlanRecurringFee", False, 14475.58),
        ("Usage", False, 2661.78),
        ("BundledDiscount", False, -35.77),
        ("SavingsPlanNegation", False, -2568.41),
        (None, True, 14533.18),
    ]


def test_savings_plan_net(golden):
    assert rows(adjust.savings_plan_net(golden)) == [
        ("2026-06", 14475.58, -2568.41, 0.0, 11907.17)
    ]


def total(frame):
    return sum(Decimal(str(row.cost_usd)) for row in frame.collect())


def test_reports_that_add_up_to_the_bill(blanks):
    grand = reports.grand_total(blanks).first()
    assert grand.raw_line_items == 45
    for report in (
        reports.panorama(blanks),
        reports.panorama_short(blanks),
        reports.cost_by_service(blanks),
        reports.cost_by_tag(blanks, "user_owner"),
        reports.cost_by_tag_principal(blanks, "user_owner"),
        reconcile.dimension_coverage(blanks),
    ):
        assert total(report) == Decimal(str(grand.grand_total_usd))


def test_with_and_without_resource_add_up(blanks):
    grand = Decimal(str(reports.grand_total(blanks).first().grand_total_usd))
    with_resource = total(reports.cost_by_resource(blanks))
    assert with_resource + total(reports.no_resource_cost(blanks)) == grand
    assert with_resource == total(reports.cost_by_resource_any_principal(blanks))


def test_coverage_counts_every_line(blanks):
    found = reconcile.dimension_coverage(blanks).collect()
    assert len(found) == 8
    assert sum(row.lines for row in found) == 45
    lines = {(r.has_resource, r.has_principal, r.has_tag): r.lines for r in found}
    assert lines[(True, True, True)] == 3 and lines[(False, False, False)] == 8


def test_reconcile_notices_a_filter(blanks):
    filtered = reconcile.reconcile(
        blanks,
        dims={"resource_id": F.col("line_item_resource_id")},
        where=[F.col("line_item_resource_id") != ""],
    )
    assert filtered.first().report_lines == 15
    with pytest.raises(AssertionError, match="differs"):
        reconcile.assert_reconciled(filtered)
    reconcile.assert_reconciled(reconcile.reconcile(blanks))


def test_reconcile_notices_lost_lines_without_cost(spark):
    free = bill(spark, {"resource": "r", "cost": 5.0}, {"resource": None, "cost": 0.0})
    result = reconcile.reconcile(
        free,
        dims={"resource_id": F.col("line_item_resource_id")},
        where=[F.col("line_item_resource_id") != ""],
    )
    with pytest.raises(AssertionError, match="1 of 2 lines"):
        reconcile.assert_reconciled(result)


def test_difference_is_exact(spark):
    """A millionth of a millionth is seen, and groups are not rounded first."""
    lines = [{"resource": f"r{i}", "cost": 4e-7} for i in range(50)]
    full = bill(spark, *lines, {"resource": None, "cost": 1e-12})
    exact = reconcile.reconcile(full)
    assert exact.first().difference_usd == 0.0
    filtered = reconcile.reconcile(
        full,
        dims={"resource_id": F.col("line_item_resource_id")},
        where=[F.col("line_item_resource_id").isNotNull()],
    )
    assert filtered.first().difference_usd == -1e-12


def test_reconcile_of_a_month_without_lines(blanks):
    empty = reconcile.reconcile(blanks, "2030-01")
    row = empty.first()
    assert row.grand_total_usd is None and row.raw_line_items == 0
    reconcile.assert_reconciled(empty)


def test_placeholders(spark):
    one = bill(spark, {"resource": "", "principal": None, "region": "", "cost": 2.0})
    assert rows(reports.panorama(one)) == [
        ("(no resource id)", "(no principal)", "svc", "Usage", "-", "-", "-", "-", "-", 2.0)
    ]
    assert rows(reports.cost_by_tag_principal(one, "user_owner")) == [
        ("(untagged)", "(no principal)", 2.0, 1)
    ]


def test_raw_tag_keeps_null_and_blank_apart(blanks):
    values = {row.tag_value for row in reports.cost_by_tag(blanks, "user_owner").collect()}
    assert values == {"o1", "", None}


def test_tag_column_is_a_parameter(spark):
    both = bill(spark, {"tags": {"Project": "x"}, "resource_tags": {"user_project": "y"}})
    frame = reports.cost_by_tag(both, "Project", tags_column="tags", tag_name="project_tag")
    assert frame.columns == ["project_tag", "cost_usd"]
    assert rows(frame) == [("x", 1.0)]


def test_principal_filters(blanks):
    strict = reports.cost_by_resource_principal(blanks)
    assert [(r.resource_id, r.iam_principal) for r in strict.collect()] == [("r1", "p1")]
    loose = reports.principal_cost_any_resource(blanks)
    assert {r.resource_id for r in loose.collect()} == {"r1", "", None}


def test_distinct_resources_count_blank_once_and_null_never(blanks):
    assert reports.cost_by_principal(blanks).first().distinct_resources == 2


def test_exploded_tags_count_lines_several_times(spark):
    tagged = bill(
        spark,
        {"resource": "r", "cost": 10.0, "resource_tags": {"a": "1", "b": ""}},
        {"resource": "r", "cost": 5.0, "resource_tags": {"a": "1"}},
        {"resource": "r", "cost": 99.0, "resource_tags": {}},
        {"resource": "r", "cost": 99.0},
        {"resource": "", "cost": 7.0, "resource_tags": {"a": "1"}},
    )
    assert rows(reports.tag_keys(tagged)) == [("a", 3, 22.0), ("b", 1, 10.0)]
    assert rows(reports.tag_total(tagged)) == [
        ("r", "(no principal)", "a", "1", 15.0),
        ("r", "(no principal)", "b", "", 10.0),
    ]


def test_usage_date_is_utc_in_any_session_zone(spark, conf):
    conf("spark.sql.session.timeZone", "UTC")
    late = bill(
        spark,
        {"resource": "r", "start": dt.datetime(2026, 6, 1, 23, 59, tzinfo=dt.timezone.utc)},
        {"resource": "r", "start": dt.datetime(1969, 12, 31, 0, 1, tzinfo=dt.timezone.utc)},
    ).cache()
    late.count()
    for zone in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
        conf("spark.sql.session.timeZone", zone)
        days = [row.usage_date for row in reports.cost_by_resource_day(late).collect()]
        assert days == [dt.date(1969, 12, 31), dt.date(2026, 6, 1)]
    late.unpersist()


def test_nulls_come_last(spark):
    lines = bill(
        spark,
        {"resource": "b", "region": None},
        {"resource": "b", "region": "x"},
        {"resource": "a", "region": None},
        {"resource": "c", "cost": None},
    )
    found = [(r.resource_id, r.region) for r in reports.cost_by_resource(lines).collect()]
    assert found == [("a", None), ("b", "x"), ("b", None), ("c", None)]


def test_periods(spark):
    months = bill(
        spark, *({"period": f"2026-0{n}", "cost": float(10**n)} for n in range(1, 5))
    )
    sums = {
        "2026-02": 100.0,
        ("2026-02", "2026-03"): 1100.0,
        None: 11110.0,
    }
    for period, wanted in sums.items():
        assert reports.grand_total(months, period).first().grand_total_usd == wanted
    for wrong in ("2026-13", "2026-6", "202606", ("2026-01", "x")):
        with pytest.raises(ValueError):
            reports.grand_total(months, wrong)


def test_amortised_amounts(spark):
    lines = bill(
        spark,
        {"type": "Usage", "cost": 1.0, "sp_cost": 50.0, "ri_cost": 60.0},
        {"type": "SavingsPlanCoveredUsage", "cost": 10.0, "sp_cost": 7.0},
        {"type": "DiscountedUsage", "cost": 0.0, "ri_cost": 3.0},
        {"type": "SavingsPlanRecurringFee", "cost": 100.0},
        {"type": None, "cost": 2.0},
    )
    by_type = {r.charge_type: r.amortized_usd for r in adjust.amortized_cost(lines).collect()}
    assert by_type == {
        "Usage": 1.0,
        "SavingsPlanCoveredUsage": 7.0,
        "DiscountedUsage": 3.0,
        "SavingsPlanRecurringFee": 100.0,
        None: 2.0,
    }
    rules = {**adjust.AMORTIZED_RULES, "SavingsPlanRecurringFee": None}
    total_row = adjust.amortized_cost(lines, dims={"service": F.lit("all")}, rules=rules)
    assert rows(total_row) == [("all", 113.0, 13.0)]


def test_top_resources_rank_ties_by_name(spark):
    lines = bill(spark, *({"resource": r, "cost": c} for r, c in
                          [("b", 5.0), ("a", 5.0), ("c", 9.0), ("d", 1.0), ("", 99.0)]))
    assert [(r.rank, r.resource_id) for r in rank.top_resources(lines, 3).collect()] == [
        (1, "c"), (2, "a"), (3, "b"),
    ]


def test_shared_resources(spark):
    lines = bill(
        spark,
        {"resource": "r", "principal": "p", "cost": 1.0},
        {"resource": "r", "principal": "p", "cost": 2.0, "service": "other"},
        {"resource": "r", "principal": "q", "cost": 1.0},
        {"resource": "alone", "principal": "p", "cost": 8.0},
        {"resource": "zero", "principal": "p", "cost": 4.0},
        {"resource": "zero", "principal": "q", "cost": -4.0},
        {"resource": "r", "principal": "", "cost": 50.0},
    )
    assert rows(rank.shared_resources(lines)) == [
        ("zero", "p", 4.0, 0.0, 2, None),
        ("r", "p", 3.0, 4.0, 2, 0.75),
        ("r", "q", 1.0, 4.0, 2, 0.25),
        ("zero", "q", -4.0, 0.0, 2, None),
    ]


def test_shared_resources_with_one_hot_resource(spark, conf):
    """A third of all lines on one resource: its rows go to many tasks."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    lines = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .otherwise(F.concat(F.lit("r"), F.col("id") % 2000))
        .alias("line_item_resource_id"),
        F.concat(F.lit("p"), F.col("id")).alias("line_item_iam_principal"),
        F.lit(0.01).alias("line_item_unblended_cost"),
        F.lit("2026-06").alias("billing_period"),
    )
    frame = rank.shared_resources(lines, sort=False)
    hot = frame.where("resource_id = 'hot'").collect()
    assert len(hot) == 10000
    assert {row.principals for row in hot} == {10000}
    assert {row.resource_cost_usd for row in hot} == {100.0}
    assert sum(row.cost_share for row in hot) == pytest.approx(1.0)
    assert frame.count() == 30000
    spread = frame.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert max(row.n for row in spread) < 10000


def test_unsorted_totals_stay_exact(golden):
    totals = grouped_totals(golden, {"t": F.col("line_item_line_item_type")}, {"c": cost()})
    assert totals.schema["c"].dataType.simpleString() == "decimal(38,12)"


def test_free_sql(spark, blanks):
    found = sql_report(
        blanks,
        "SELECT tag_key, count(*) AS n FROM {bill} "
        "LATERAL VIEW explode(resource_tags) t AS tag_key, tag_value "
        "GROUP BY 1 ORDER BY 1",
    )
    assert rows(found) == [("other", 9), ("user_owner", 18)]


def test_free_sql_leaves_the_views_of_the_session_alone(spark, blanks):
    spark.range(3).createOrReplaceTempView("bill")
    before = {table.name for table in spark.catalog.listTables()}
    for name in ("bill", "lines"):
        found = sql_report(blanks, f"SELECT count(*) AS n FROM {{{name}}}", name=name)
        assert found.first().n == blanks.count()
    assert spark.table("bill").count() == 3
    assert {table.name for table in spark.catalog.listTables()} == before
    spark.catalog.dropTempView("bill")


def test_no_dimensions_give_one_total(golden):
    total = grand_total_of(golden)
    assert rows(adjust.amortized_cost(golden, dims={}, rules={})) == [(total, total)]
    found = reconcile.reconcile(golden, dims={}).first()
    assert (found.report_groups, found.report_total_usd) == (1, total)
    assert rows(cost_report(golden, {})) == [(total,)]


def grand_total_of(lines):
    return reports.grand_total(lines).first().grand_total_usd


def test_report_of_own_measures_is_sorted_by_the_first(golden):
    found = cost_report(
        golden, {"t": F.col("line_item_line_item_type")}, {"n": count_lines(), "c": cost()}
    )
    counts = [row.n for row in found.collect()]
    assert counts == sorted(counts, reverse=True)


def test_rules_may_combine_columns(spark):
    columns = {
        "savings_plan_total_commitment_to_date": [None, 10.0, 7.0],
        "savings_plan_used_commitment": [1.0, 4.0, None],
    }
    lines = bill(spark, *({"type": "SavingsPlanRecurringFee", "resource": str(n)} for n in range(3)))
    for name, values in columns.items():
        value = F.element_at(F.array(*map(F.lit, values)), F.col("line_item_resource_id").cast("int") + 1)
        lines = lines.withColumn(name, value)
    rules = {"SavingsPlanRecurringFee": adjust.unused_commitment()}
    found = adjust.amortized_cost(lines, dims={"r": F.col("line_item_resource_id")}, rules=rules)
    assert {r.r: r.amortized_usd for r in found.collect()} == {"0": -1.0, "1": 6.0, "2": 7.0}
