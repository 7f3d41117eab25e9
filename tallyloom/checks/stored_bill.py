"""Queries that write the order bill to the shared folder first, as a bill is kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.checks.order_bill import BILL_COLUMNS, order_bill
from tallyloom.functions.amounts import as_usd, cost, lines
from tallyloom.operators.cost_report import cost_report
from tallyloom.plans.changes import line_changes, refresh_changes
from tallyloom.plans.reports import panorama
from tallyloom.plans.sketches import (
    DISTINCT_BOUND,
    RANK_BOUND,
    estimates,
    frequent_payers,
    merged,
    monthly_sketches,
)
from tallyloom.sources.bill import read_bill
from tallyloom.sources.bill_schema import BILL_SCHEMA, PARTITION_COLUMN
from tallyloom.sources.refresh import refresh_months
from tallyloom.sources.report_files import read_report, write_report
from tallyloom.sources.shared import shared_folder
from tallyloom.streaming.bill_stream import LINE_ID, add_up, bill_stream, report_so_far

MONTH = "1997-06"
_COST = "line_item_unblended_cost"
_SERVICE = "line_item_product_code"
_TYPE = "line_item_line_item_type"
_START = "line_item_usage_start_date"
#: Months after which the next delivery of the stream begins.
CUTS = ("1996-12", "1999-05")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _schema(*names: str) -> T.StructType:
    return T.StructType([field for field in BILL_SCHEMA if field.name in (*names, PARTITION_COLUMN)])


def refreshed_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and lines by month and service, after a month was loaded three times.

    At first it has usage only, then all but credits; the third is the second one
    again by its id, with other lines, and must not count.
    """
    columns = (PARTITION_COLUMN, _COST, _SERVICE, _TYPE)
    schema = _schema(_COST, _SERVICE, _TYPE)
    path = new_folder(spark, "refreshed")
    bill = order_bill(spark, sf_dir, columns)
    month = order_bill(spark, sf_dir, columns, MONTH).where(F.col(PARTITION_COLUMN) == MONTH)
    early = (F.col(PARTITION_COLUMN) != MONTH) | (F.col(_TYPE) == "Usage")
    refresh_months(spark, bill.where(early), path, "whole-bill", schema)
    refresh_months(spark, month.where(F.col(_TYPE) != "Credit"), path, "month-2", schema)
    refresh_months(spark, month.where(F.col(_TYPE) == "Tax"), path, "month-2", schema)
    dims = {PARTITION_COLUMN: F.col(PARTITION_COLUMN), "service": F.col(_SERVICE)}
    stored = read_bill(spark, path, schema)
    return cost_report(stored, dims, {"cost_usd": cost(), "lines": lines()})


def stored_panorama(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panorama of a stored month, written as a CSV report and read again."""
    path = new_folder(spark, "panorama")
    refresh_months(spark, order_bill(spark, sf_dir, BILL_COLUMNS), f"{path}/bill", "whole-bill")
    report = panorama(read_bill(spark, f"{path}/bill", period=MONTH), MONTH)
    write_report(report, f"{path}/report")
    return read_report(spark, f"{path}/report", report.schema)


def streamed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and lines by service and charge type, from three deliveries of files.

    Of the last month of a delivery, some lines come with the next one, and some
    come with both.
    """
    columns = (PARTITION_COLUMN, _COST, _SERVICE, _TYPE, _START, LINE_ID)
    schema = T.StructType(
        [
            T.StructField(name, T.TimestampNTZType() if name == _START else BILL_SCHEMA[name].dataType)
            for name in columns
        ]
    )
    path = new_folder(spark, "streamed")
    bill = order_bill(spark, sf_dir, columns)
    month = F.col(PARTITION_COLUMN)
    number = sum(((month > cut).cast("int") for cut in CUTS), F.lit(0))
    on_edge = month.isin(*CUTS)
    number = number + (on_edge & (F.col(_TYPE) == "DiscountedUsage")).cast("int")
    again = on_edge & (F.col(_TYPE) == "Usage")
    dims = T.StructType([T.StructField("service", T.StringType()), T.StructField("charge_type", T.StringType())])
    for delivery in range(len(CUTS) + 1):
        came = (number == delivery) | (again & (number == delivery - 1))
        bill.where(came).write.mode("append").parquet(f"{path}/files")
        add_up(
            bill_stream(spark, f"{path}/files", schema),
            lambda frame: {"service": F.col(_SERVICE), "charge_type": F.col(_TYPE)},
            f"{path}/totals",
        )
    return report_so_far(spark, f"{path}/totals", dims)


def _deliveries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The bill as it was, and as it was delivered again.

    Taxes are gone, credits are new, discounted usage costs a unit of usage more, and
    of fees there are two of each.
    """
    columns = (LINE_ID, _COST, _TYPE, _SERVICE, "line_item_usage_amount", "resource_tags")
    bill = order_bill(spark, sf_dir, columns)
    old = bill.where(F.col(_TYPE) != "Credit")
    dearer = F.when(F.col(_TYPE) == "DiscountedUsage", F.col(_COST) + F.col("line_item_usage_amount"))
    new = bill.where(F.col(_TYPE) != "Tax").withColumn(_COST, F.coalesce(dearer, _COST))
    return old, new.unionAll(new.where(F.col(_TYPE) == "SavingsPlanRecurringFee"))


def changes_of_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh_changes(*_deliveries(spark, sf_dir))


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that differ, with costs as they are shown."""
    found = line_changes(*_deliveries(spark, sf_dir))
    shown = {f"{side}_cost": as_usd(F.col(f"{side}_cost")) for side in ("old", "new")}
    return found.withColumns(shown)


def _stored_sketches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The bill, and the sketches of its years, merged from stored ones of its months."""
    path = new_folder(spark, "sketches")
    bill = order_bill(spark, sf_dir, (PARTITION_COLUMN, _COST, LINE_ID, "line_item_iam_principal"))
    monthly_sketches(bill, counted=F.col(LINE_ID)).write.parquet(path)
    return bill, merged(spark.read.parquet(path), F.substring(PARTITION_COLUMN, 1, 4), "year")


def sketched_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, cost and different lines of each year; whether estimates are within bounds.

    The exact figures come from the lines, the estimates from sketches of months.
    """
    bill, years = _stored_sketches(spark, sf_dir)
    asked = (0.1, 0.5, 0.9)
    found = estimates(years, asked)
    lines = bill.withColumn("year", F.substring(PARTITION_COLUMN, 1, 4))
    below = [
        F.count_if(F.col(_COST) <= F.col("quantile_estimates")[n]).alias(f"below_{n}")
        for n in range(len(asked))
    ]
    exact = (
        lines.join(found.select("year", "quantile_estimates"), "year")
        .groupBy("year")
        .agg(F.count_distinct(LINE_ID).alias("distinct_lines"), *below)
    )
    off = F.abs(F.col("distinct_estimate") - F.col("distinct_lines"))
    ranks_off = [F.abs(F.col(f"below_{n}") / F.col("lines") - share) for n, share in enumerate(asked)]
    return found.join(exact, "year").select(
        "year",
        "lines",
        "cost_usd",
        "distinct_lines",
        (off <= DISTINCT_BOUND * F.col("distinct_lines")).alias("distinct_within"),
        (F.greatest(*ranks_off) <= RANK_BOUND).alias("ranks_within"),
    ).orderBy("year")


def sketched_payers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent principals of each year, from sketches of months."""
    return frequent_payers(_stored_sketches(spark, sf_dir)[1])


STORED_QUERIES = {
    "sketched_years": sketched_years,
    "sketched_payers": sketched_payers,
    "refreshed_months": refreshed_months,
    "stored_panorama_month": stored_panorama,
    "streamed_cost": streamed_cost,
    "changes_of_refresh": changes_of_refresh,
    "changed_lines": changed_lines,
}
