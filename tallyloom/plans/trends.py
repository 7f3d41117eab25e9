"""Costs over time: running sums of days, and month over month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.amounts import as_usd, cost, share_of
from tallyloom.functions.columns import filled, utc_date
from tallyloom.operators.cost_report import grouped_totals
from tallyloom.sources.bill import Period
from tallyloom.sources.bill_schema import PARTITION_COLUMN

_RESOURCE = "line_item_resource_id"
_START = "line_item_usage_start_date"
RUNNING_DAYS = (7, 30)


def running_costs(
    bill: DataFrame,
    period: Period = None,
    days: tuple[int, ...] = RUNNING_DAYS,
    by: Column | None = None,
    name: str = "resource_id",
    sort: bool = True,
) -> DataFrame:
    """Cost of each day, and of the last 7 and 30 days up to it, by resource.

    Every day between a resource's first and last charge has a row; one without a
    charge costs nothing. ``by`` is another value to go by, called ``name``; lines
    where it is NULL or blank are left out. Days are UTC days.

    Lines are summed to days first. The windows run over days, at most one row for
    each, however many lines a resource has.
    """
    key = F.col(_RESOURCE) if by is None else by
    measures = {"cost_usd": cost()}
    # UTC days of a period may reach beyond it, so the lines are chosen by month only.
    daily = grouped_totals(
        bill, {name: key, "usage_date": utc_date(bill, _START)}, measures, period, where=[filled(key)]
    ).where(F.col("usage_date").isNotNull())
    day = F.unix_date("usage_date")
    # A day and the days after it without a charge, up to the next that has one.
    after = F.lead("usage_date").over(W.partitionBy(name).orderBy("usage_date"))
    until = F.coalesce(F.date_sub(after, 1), F.col("usage_date"))
    calendar = daily.withColumn("until", until)
    calendar = calendar.withColumn("day", F.explode(F.sequence("usage_date", "until")))
    dense = calendar.select(
        name,
        F.col("day").alias("usage_date"),
        F.when(F.col("day") == F.col("usage_date"), F.col("cost_usd"))
        .otherwise(F.lit(0).cast("decimal(38,12)"))
        .alias("cost_usd"),
    )
    within = W.partitionBy(name).orderBy(day)
    running = {
        f"cost_{n}_days_usd": F.sum("cost_usd").over(within.rangeBetween(1 - n, 0)) for n in days
    }
    found = dense.select(name, "usage_date", "cost_usd", *(c.alias(n) for n, c in running.items()))
    report = found.withColumns({n: as_usd(F.col(n)) for n in ("cost_usd", *running)})
    return report.orderBy(name, "usage_date") if sort else report


def month_over_month(
    bill: DataFrame,
    dims: dict[str, Column],
    period: Period = None,
    sort: bool = True,
) -> DataFrame:
    """Cost of each month and of the month before, by the given dimensions.

    Every month between a group's first and last charge has a row, and a month
    without a charge costs nothing. ``change_usd`` is the difference to the month
    before and ``change_share`` its part of that month's cost; both are NULL in a
    group's first month, the share also where the month before cost nothing.
    """
    measures = {"cost_usd": cost()}
    names = list(dims)
    monthly = grouped_totals(bill, {**dims, PARTITION_COLUMN: F.col(PARTITION_COLUMN)}, measures, period)
    first = F.to_date(F.concat(PARTITION_COLUMN, F.lit("-01")))
    group = W.partitionBy(*names).orderBy("month")
    after = F.lead("month").over(group)
    until = F.coalesce(F.add_months(after, -1), F.col("month"))
    dense = (
        monthly.withColumn("month", first)
        .withColumn("until", until)
        .withColumn("each", F.explode(F.sequence("month", "until", F.expr("INTERVAL 1 MONTH"))))
        .select(
            *names,
            F.col("each").alias("month"),
            F.when(F.col("each") == F.col("month"), F.col("cost_usd"))
            .otherwise(F.lit(0).cast("decimal(38,12)"))
            .alias("cost_usd"),
        )
    )
    before = dense.withColumn("before_usd", F.lag("cost_usd").over(group))
    before = before.withColumn("change_usd", F.col("cost_usd") - F.col("before_usd"))
    money = ("cost_usd", "before_usd", "change_usd")
    report = before.withColumns({name: as_usd(F.col(name)) for name in money}).select(
        *names,
        F.date_format("month", "yyyy-MM").alias(PARTITION_COLUMN),
        *money,
        share_of(F.col("change_usd"), F.col("before_usd")).alias("change_share"),
    )
    if not sort:
        return report
    return report.orderBy(*(F.asc_nulls_last(name) for name in names), PARTITION_COLUMN)
