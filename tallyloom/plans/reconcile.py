"""Proving reports against the bill, and what has no owner."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.amounts import as_double, as_usd, cost, lines, share_of
from tallyloom.functions.columns import has_tags, is_blank, is_filled
from tallyloom.operators.cost_report import (
    Dims,
    by_cost,
    cost_report,
    grouped_totals,
    shown,
)
from tallyloom.plans.reports import panorama_dims
from tallyloom.sources.bill import Period

_COST_AND_LINES = ("cost", "lines")


def reconcile(
    bill: DataFrame,
    period: Period = None,
    dims: Dims | None = None,
    where: Sequence[Column] = (),
) -> DataFrame:
    """Compare a report with the bill it was made from: one row.

    The report is the panorama, unless other ``dims`` and ``where`` are given.
    Its groups and the bill are summed independently, as exact decimals, so a
    difference of 0 means equal to the last digit, and equal line counts mean
    that every line is in exactly one group.

    Both sides end in one row each; a union and a sum put them side by side.
    """
    measures = dict(zip(_COST_AND_LINES, (cost(), lines())))
    if dims is None:
        dims = panorama_dims()
    groups = grouped_totals(bill, dims, measures, period, where)
    of_report = groups.agg(
        F.sum("cost").alias("report_total"),
        F.sum("lines").alias("report_lines"),
        F.count("*").alias("report_groups"),
    ).withColumn("signed", F.col("report_total"))
    of_bill = (
        grouped_totals(bill, {}, measures, period)
        .withColumnsRenamed({"cost": "grand_total", "lines": "raw_line_items"})
        .withColumn("signed", -F.col("grand_total"))
    )
    both = of_report.unionByName(of_bill, allowMissingColumns=True)
    return both.agg(
        as_usd(F.sum("report_total")).alias("report_total_usd"),
        as_usd(F.sum("grand_total")).alias("grand_total_usd"),
        as_double(F.sum("signed")).alias("difference_usd"),
        F.sum("report_groups").alias("report_groups"),
        F.sum("report_lines").alias("report_lines"),
        F.sum("raw_line_items").alias("raw_line_items"),
    )


def assert_reconciled(result: DataFrame, tolerance: Decimal | float = 0) -> None:
    """Raise unless a ``reconcile`` result shows no cost or line lost.

    Runs the job, which returns one row.
    """
    row = result.first()
    difference = row.difference_usd or 0.0
    if abs(difference) > tolerance:
        raise AssertionError(
            f"report differs from the bill by {difference}: "
            f"{row.report_total_usd} against {row.grand_total_usd}"
        )
    if (row.report_lines or 0) != row.raw_line_items:
        raise AssertionError(
            f"report covers {row.report_lines} of {row.raw_line_items} lines"
        )


def unattributed_share(bill: DataFrame, period: Period = None) -> DataFrame:
    """Cost with and without a resource id, and the share without: one row.

    Credits and negations count with their sign, on both sides of the share.
    """
    blank = is_blank(F.col("line_item_resource_id"))
    halves = grouped_totals(bill, {"blank": blank}, {"cost": cost()}, period)
    totals = halves.agg(
        as_usd(F.sum("cost")).alias("grand_total_usd"),
        as_usd(F.sum(F.when(F.col("blank"), 0).otherwise(F.col("cost")))).alias(
            "attributed_usd"
        ),
        as_usd(F.sum(F.when(F.col("blank"), F.col("cost")).otherwise(0))).alias(
            "unattributed_usd"
        ),
    )
    share = share_of(F.col("unattributed_usd"), F.col("grand_total_usd"))
    return totals.withColumn("unattributed_share", share)


def no_resource_by_type(
    bill: DataFrame, period: Period = None, sort: bool = True
) -> DataFrame:
    """Cost without resource id by charge type, and a last row with the total.

    The total row has ``is_total`` set and no charge type. The rollup runs over
    the sums per charge type, not over the bill.
    """
    measures = {"cost_usd": cost()}
    by_type = grouped_totals(
        bill,
        {"charge_type": F.col("line_item_line_item_type")},
        measures,
        period,
        where=[is_blank(F.col("line_item_resource_id"))],
    )
    report = shown(
        by_type.rollup("charge_type").agg(
            F.sum("cost_usd").alias("cost_usd"),
            (F.grouping("charge_type") == 1).alias("is_total"),
        ),
        measures,
    ).select("charge_type", "is_total", "cost_usd")
    if not sort:
        return report
    return report.orderBy("is_total", *by_cost(["charge_type"]))


def dimension_coverage(
    bill: DataFrame,
    period: Period = None,
    tags_column: str = "resource_tags",
    sort: bool = True,
) -> DataFrame:
    """Lines and cost by which of resource, principal and tags a line has.

    At most eight rows; a combination without lines has no row.
    """
    dims = {
        "has_resource": is_filled(F.col("line_item_resource_id")),
        "has_principal": is_filled(F.col("line_item_iam_principal")),
        "has_tag": has_tags(F.col(tags_column)),
    }
    measures = {"lines": lines(), "cost_usd": cost()}
    return cost_report(bill, dims, measures, period, sort=sort)
