"""Which billing months, or other partition values, a bill holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.bill import check_range, for_period
from tallyloom.sources.bill_schema import PARTITION_COLUMN


def expected_periods(bill: DataFrame, first: str, last: str) -> DataFrame:
    """All months from ``first`` to ``last``, both included."""
    start, stop = (
        F.to_date(F.lit(month + "-01")) for month in check_range(first, last)
    )
    month = F.explode(F.sequence(start, stop, F.expr("INTERVAL 1 MONTH")))
    return (
        bill.sparkSession.range(1)
        .select(month.alias("month"))
        .select(F.date_format("month", "yyyy-MM").alias(PARTITION_COLUMN))
    )


def missing_periods(bill: DataFrame, first: str, last: str) -> DataFrame:
    """Expected months for which the bill has no line, in order.

    Only the months from ``first`` to ``last`` are scanned. The distinct ones are
    found within each task first; what meets the expected months in the anti join
    is a handful of rows.
    """
    present = for_period(bill, (first, last)).select(PARTITION_COLUMN).distinct()
    gaps = expected_periods(bill, first, last).join(present, PARTITION_COLUMN, "left_anti")
    return gaps.orderBy(PARTITION_COLUMN)


def partition_values(
    bill: DataFrame,
    columns: Sequence[str] = (PARTITION_COLUMN,),
    limit: int | None = None,
) -> DataFrame:
    """Distinct values of the partition columns in order; all, unless ``limit`` is given."""
    values = bill.select(*columns).distinct().orderBy(*columns)
    return values if limit is None else values.limit(limit)
