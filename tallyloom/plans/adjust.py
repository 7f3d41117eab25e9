"""Costs seen otherwise than as billed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.amounts import as_usd, cost
from tallyloom.operators.cost_report import Dims, cost_report, grouped_totals
from tallyloom.sources.bill import Period
from tallyloom.sources.bill_schema import PARTITION_COLUMN

# Charge types and cost columns of the bill format.
SAVINGS_PLAN_PARTS = {
    "recurring_fee_usd": "SavingsPlanRecurringFee",
    "negation_usd": "SavingsPlanNegation",
    "covered_usage_usd": "SavingsPlanCoveredUsage",
}
Rules = Mapping[str, str | Column | None]
AMORTIZED_RULES: Rules = {
    "SavingsPlanCoveredUsage": "savings_plan_savings_plan_effective_cost",
    "DiscountedUsage": "reservation_effective_cost",
}


def savings_plan_net(
    bill: DataFrame, period: Period = None, sort: bool = True
) -> DataFrame:
    """Net cost of savings plans per month: fee, negation and covered usage.

    The fee has no resource, the covered usage has one, and the negation takes
    back its list price; only the three together are what the plan cost. The
    parts are taken from the sums per month and charge type.
    """
    charge_type = F.col("line_item_line_item_type")
    by_type = grouped_totals(
        bill,
        {PARTITION_COLUMN: F.col(PARTITION_COLUMN), "charge_type": charge_type},
        {"cost": cost()},
        period,
        where=[charge_type.isin(*SAVINGS_PLAN_PARTS.values())],
    )
    parts = {
        name: as_usd(F.sum(F.when(F.col("charge_type") == part, F.col("cost")).otherwise(0)))
        for name, part in SAVINGS_PLAN_PARTS.items()
    }
    report = by_type.groupBy(PARTITION_COLUMN).agg(
        *(total.alias(name) for name, total in parts.items()),
        as_usd(F.sum("cost")).alias("net_usd"),
    )
    return report.orderBy(F.asc_nulls_last(PARTITION_COLUMN)) if sort else report


def unused_commitment() -> Column:
    """The part of a savings plan's commitment that was not used."""
    used = F.coalesce("savings_plan_used_commitment", F.lit(0.0))
    return sum_of("savings_plan_total_commitment_to_date") - used


def sum_of(*columns: str) -> Column:
    """Sum of columns of a line; a NULL counts as nothing."""
    total = F.lit(0.0)
    for column in columns:
        total = total + F.coalesce(column, F.lit(0.0))
    return total


def amortized_amount(rules: Rules = AMORTIZED_RULES) -> Column:
    """Cost of a line by its charge type.

    ``rules`` maps a charge type to its amortised cost: the name of a column, an
    expression of several, or ``None`` if such lines shall cost nothing. Types
    without a rule keep the unblended cost.
    """
    amount = F.col("line_item_unblended_cost")
    for kind, rule in rules.items():
        amortized = F.lit(0.0) if rule is None else F.col(rule) if isinstance(rule, str) else rule
        amount = F.when(
            F.col("line_item_line_item_type") == kind, amortized
        ).otherwise(amount)
    return amount


def amortized_cost(
    bill: DataFrame,
    period: Period = None,
    dims: Dims | None = None,
    rules: Rules = AMORTIZED_RULES,
    sort: bool = True,
) -> DataFrame:
    """Billed and amortised cost, by service and charge type unless told otherwise.

    With the default rules the recurring fee is still counted beside the usage
    it pays for. This is a view of usage: its total is *not* the bill.
    """
    if dims is None:
        dims = {
            "service": F.col("line_item_product_code"),
            "charge_type": F.col("line_item_line_item_type"),
        }
    measures = {"cost_usd": cost(), "amortized_usd": cost(amortized_amount(rules))}
    return cost_report(bill, dims, measures, period, sort=sort)
