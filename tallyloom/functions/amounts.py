"""Exact sums of amounts that are stored as doubles.

A sum of doubles depends on the order of its terms, and with it on how many
tasks ran. Each amount is therefore summed as decimal(28,12): the total is
decimal(38,12) and the same on any number of executors, so that two reports can
be compared to the last digit. Only a finished report turns the totals back into
doubles, money rounded to six digits. Six digits would be too few per line:
many charges are smaller than a millionth each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_AMOUNT = "decimal(28,12)"
TOTAL_AMOUNT = "decimal(38,12)"
SHOWN_MONEY = "decimal(28,6)"


def exact_sum(amount: Column) -> Column:
    """Sum of decimals, the same in any order and on any number of tasks.

    An amount that is no such decimal (NaN, infinite, 1e16 or more) fails the job. A
    session without ANSI mode would make it NULL, and with it leave it out of every
    sum alike, so that no comparison of sums could tell.
    """
    exact = amount.cast(LINE_AMOUNT)
    refused = F.raise_error(F.concat(F.lit("cannot be summed: "), amount.cast("string")))
    lost = exact.isNull() & amount.isNotNull()
    return F.sum(F.when(lost, refused.cast(LINE_AMOUNT)).otherwise(exact)).cast(TOTAL_AMOUNT)


def as_usd(total: Column) -> Column:
    return total.cast(SHOWN_MONEY).cast("double")


def as_double(total: Column) -> Column:
    return total.cast("double")


def share_of(part: Column, whole: Column) -> Column:
    """``part / whole`` of two shown amounts; NULL if the whole is zero."""
    return part / F.nullif(whole, F.lit(0.0))


@dataclass(frozen=True)
class Measure:
    """An aggregate, and the form in which a finished report shows it."""

    total: Column
    shown: Callable[[Column], Column] = lambda total: total


def cost(amount: Column | None = None) -> Measure:
    """Sum of an amount of money, the unblended cost by default."""
    if amount is None:
        amount = F.col("line_item_unblended_cost")
    return Measure(exact_sum(amount), as_usd)


def usage_amount() -> Measure:
    return Measure(exact_sum(F.col("line_item_usage_amount")), as_double)


def lines() -> Measure:
    return Measure(F.count("*"))


def distinct_resources() -> Measure:
    """Exact number of resource ids; NULL does not count, a blank id counts once."""
    return Measure(F.count_distinct(F.col("line_item_resource_id")))
