"""Charges against the terms of commitments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.amounts import cost, lines
from tallyloom.functions.columns import filled, quoted, utc_time
from tallyloom.operators.cost_report import cost_report
from tallyloom.operators.intervals import SMALL_ROWS, in_terms
from tallyloom.sources.bill import Period, for_period
from tallyloom.sources.conform import utc_instant

_SAME_USE = ("line_item_product_code", "line_item_usage_type")
_START = "line_item_usage_start_date"
_COST = "line_item_unblended_cost"
_TYPE = "line_item_line_item_type"


@dataclass(frozen=True)
class Commitment:
    """Columns that name a commitment and its term, and the charges it is about."""

    name: str
    start: str
    end: str
    fee: str
    usage: tuple[str, ...]


SAVINGS_PLAN = Commitment(
    "savings_plan_savings_plan_a_r_n",
    "savings_plan_start_time",
    "savings_plan_end_time",
    "SavingsPlanRecurringFee",
    ("Usage", "SavingsPlanCoveredUsage"),
)
RESERVATION = Commitment(
    "reservation_reservation_a_r_n",
    "reservation_start_time",
    "reservation_end_time",
    "RIFee",
    ("Usage", "DiscountedUsage"),
)


def terms(bill: DataFrame, kind: Commitment = SAVINGS_PLAN, period: Period = None) -> DataFrame:
    """The terms that fees are paid for, each once: commitment, use, begin and end.

    Begin and end are texts on the bill, such as 2026-06-01T00:00:00Z, and taken as
    ``conform`` takes instants: without a zone they are UTC, and blank ones are none.
    """
    paid = for_period(bill, period).where((F.col(_TYPE) == kind.fee) & filled(F.col(kind.name)))
    return paid.select(
        F.col(kind.name).alias("commitment"),
        *_SAME_USE,
        *(
            F.expr(utc_instant(quoted(name), T.StringType())).alias(shown)
            for name, shown in ((kind.start, "term_start"), (kind.end, "term_end"))
        ),
    ).distinct()


def usage_in_terms(
    bill: DataFrame,
    kind: Commitment = SAVINGS_PLAN,
    period: Period = None,
    small_rows: int = SMALL_ROWS,
    sort: bool = True,
) -> DataFrame:
    """For each term: lines and cost of the usage it might have covered.

    That is usage of the same service and usage type which begins within the term.
    A line within several terms counts in each, so the costs do not add up to the
    bill. Terms without such usage have no row.
    """
    used = for_period(bill, period).where(F.col(_TYPE).isin(*kind.usage))
    used = used.select(*_SAME_USE, _START, _COST)
    pairs = in_terms(
        used, terms(bill, kind, period), _SAME_USE, _START, "term_start", "term_end", small_rows
    )
    dims = {
        "commitment": F.col("term.commitment"),
        "service": F.col(f"term.{_SAME_USE[0]}"),
        "usage_type": F.col(f"term.{_SAME_USE[1]}"),
        "term_start": utc_time("unix_micros(term.term_start)"),
        "term_end": utc_time("unix_micros(term.term_end)"),
    }
    measures = {"cost_usd": cost(F.col(f"row.{_COST}")), "lines": lines()}
    return cost_report(pairs, dims, measures, sort=sort)
