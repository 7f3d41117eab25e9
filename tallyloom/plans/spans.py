"""When resources were in use, and when they were not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import filled, steps_of, utc_micros, utc_time
from tallyloom.operators.as_of import STRETCH_SECONDS
from tallyloom.sources.bill import Period, for_period

_RESOURCE = "line_item_resource_id"
_START, _END = "line_item_usage_start_date", "line_item_usage_end_date"
_HOUR = 3_600_000_000


def _uses(bill: DataFrame, period: Period, stretch_seconds: int) -> DataFrame:
    """Each beginning of use of a resource once, with the latest end of those lines."""
    lines = for_period(bill, period).where(filled(F.col(_RESOURCE)))
    return (
        lines.select(
            F.col(_RESOURCE).alias("resource_id"),
            utc_micros(lines, _START).alias("begin"),
            utc_micros(lines, _END).alias("end"),
        )
        .where("begin < end")
        .groupBy("resource_id", "begin")
        .agg(F.max("end").alias("end"))
        .withColumn("stretch", steps_of("begin", f"{1_000_000 * stretch_seconds}L"))
    )


def _with_end_before(uses: DataFrame) -> DataFrame:
    """Uses with ``before``: the latest end of all that began earlier.

    The running maximum is taken within stretches of time, and the maximum of each
    stretch is carried on to later ones in a pass over a row per stretch. So a
    resource with a third of all lines is as many groups as it has stretches.
    """
    stretch = W.partitionBy("resource_id", "stretch").orderBy("begin")
    here = F.max("end").over(stretch.rowsBetween(W.unboundedPreceding, -1))
    earlier = W.partitionBy("resource_id").orderBy("stretch")
    carried = (
        uses.groupBy("resource_id", "stretch")
        .agg(F.max("end").alias("latest"))
        .select(
            "resource_id",
            "stretch",
            F.max("latest").over(earlier.rowsBetween(W.unboundedPreceding, -1)).alias("carried"),
        )
    )
    return (
        uses.withColumn("here", here)
        .join(carried, ["resource_id", "stretch"])
        .withColumn("before", F.greatest("here", "carried"))
    )


def idle_gaps(
    bill: DataFrame, period: Period = None, stretch_seconds: int = STRETCH_SECONDS, sort: bool = True
) -> DataFrame:
    """Times between two uses of a resource: resource_id, idle_from, idle_until (UTC), idle_hours.

    A use goes from the start of a line up to, but not with, its end; uses that touch
    leave no gap. Lines without resource, time or length are left out.
    """
    uses = _with_end_before(_uses(bill, period, stretch_seconds))
    gaps = uses.where("begin > before").select(
        "resource_id",
        utc_time("before").alias("idle_from"),
        utc_time("begin").alias("idle_until"),
        ((F.col("begin") - F.col("before")) / _HOUR).alias("idle_hours"),
    )
    return gaps.orderBy("resource_id", "idle_from") if sort else gaps


def usage_spans(
    bill: DataFrame, period: Period = None, stretch_seconds: int = STRETCH_SECONDS, sort: bool = True
) -> DataFrame:
    """Per resource: first and last use, spans of unbroken use, hours used and idle.

    Overlapping and touching uses are one span. Times are in UTC.
    Columns: resource_id, first_use, last_use, spans, hours_used, hours_idle.
    """
    uses = _with_end_before(_uses(bill, period, stretch_seconds))
    gap = F.when(F.col("begin") > F.col("before"), F.col("begin") - F.col("before")).otherwise(0)
    whole = uses.groupBy("resource_id").agg(
        F.min("begin").alias("first"),
        F.max("end").alias("last"),
        (F.count_if(F.col("begin") > F.col("before")) + 1).alias("spans"),
        F.sum(gap).alias("idle"),
    )
    report = whole.select(
        "resource_id",
        utc_time("first").alias("first_use"),
        utc_time("last").alias("last_use"),
        "spans",
        ((F.col("last") - F.col("first") - F.col("idle")) / _HOUR).alias("hours_used"),
        (F.col("idle") / _HOUR).alias("hours_idle"),
    )
    return report.orderBy(F.desc("hours_idle"), "resource_id") if sort else report
