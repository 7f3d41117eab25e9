"""Reading the bill and choosing its billing months."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources.bill_schema import BILL_SCHEMA, PARTITION_COLUMN

Period = str | tuple[str, str] | None

_MONTH = re.compile(r"\d{4}-(0[1-9]|1[0-2])")


def read_bill(
    spark: SparkSession,
    path: str,
    schema: T.StructType = BILL_SCHEMA,
    period: Period = None,
) -> DataFrame:
    """Scan a bill laid out as ``<path>/BILLING_PERIOD=YYYY-MM/*.parquet``.

    Months come from the directories, so a month that lands later is seen by the
    next read without any repair of a catalog. The directory name may be in
    upper or lower case. Columns a file does not have are NULL; a file whose
    types differ from the declared ones fails the read (see ``conform``).

    With a ``period`` only the directories of its months are listed, and months
    that do not exist have no rows. Without one the files of all months are
    listed, whatever ``for_period`` chooses of them later.
    """
    if period is None:
        return spark.read.schema(schema).parquet(path)
    chosen = _month_paths(spark, path, months_of(period))
    if not chosen:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", path)
    return reader.parquet(*chosen)


def read_bill_table(
    spark: SparkSession,
    table: str,
    schema: T.StructType = BILL_SCHEMA,
    period: Period = None,
) -> DataFrame:
    """A bill that the catalog knows by name, with the declared columns.

    Its directories are pruned by ``period`` as those of ``read_bill``, if the table is
    partitioned by the billing month. Columns it does not have are NULL; what it has
    besides is left out. A table must be told of a month that landed outside of it
    (``MSCK REPAIR TABLE``); a path needs no such step.
    """
    bill = for_period(spark.table(table), period)
    found = {name.lower(): name for name in bill.columns}
    return bill.select(
        *(
            F.col(f"`{found[field.name.lower()]}`").alias(field.name)
            if field.name.lower() in found
            else F.lit(None).cast(field.dataType).alias(field.name)
            for field in schema
        )
    )


def _month_paths(spark: SparkSession, path: str, months: list[str]) -> list[str]:
    """Directories of the months that exist, under either spelling."""
    names = (PARTITION_COLUMN.upper(), PARTITION_COLUMN)
    wanted = [f"{path.rstrip('/')}/{name}={month}" for month in months for name in names]
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = jvm_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [one for one in wanted if files.exists(jvm_path(one))]


def check_month(month: str) -> str:
    """Return ``month`` if it has the form YYYY-MM, else raise ``ValueError``."""
    if not _MONTH.fullmatch(month):
        raise ValueError(f"billing month must look like 2026-06, got {month!r}")
    return month


def check_range(first: str, last: str) -> tuple[str, str]:
    """Return both months if they are in order, else raise ``ValueError``."""
    if check_month(first) > check_month(last):
        raise ValueError(f"range of months is reversed: {first} is after {last}")
    return first, last


def months_of(period: str | tuple[str, str]) -> list[str]:
    """All months of a period, in order."""
    if isinstance(period, str):
        return [check_month(period)]
    first, last = check_range(*period)
    year, month = map(int, first.split("-"))
    found = []
    while (name := f"{year:04d}-{month:02d}") <= last:
        found.append(name)
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return found


def for_period(bill: DataFrame, period: Period) -> DataFrame:
    """Keep one month, an inclusive range of months, or (``None``) everything.

    The predicate is on the bare partition column, so only the directories of
    the chosen months are read. A range whose first month is after its last raises
    ``ValueError``.
    """
    if period is None:
        return bill
    month = F.col(PARTITION_COLUMN)
    if isinstance(period, str):
        return bill.where(month == check_month(period))
    first, last = check_range(*period)
    return bill.where((month >= first) & (month <= last))
