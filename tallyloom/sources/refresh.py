"""Loading and refreshing months of a stored bill.

The month that is still open is delivered several times a day, whole each time. A
load goes through three steps, and each leaves a sign in the bill's folder:

1. staging: the delivered lines are written beside the bill, by month, and read
   once to count them (``_staged/<load>``: lines and exact cost of each month);
2. publishing: the staged months take the place of the stored ones by a dynamic
   partition overwrite, which touches no other month; staged files hold one month
   each, so their lines are written again as they lie, without a shuffle;
3. the months are read back and compared with what was staged, and the load is
   entered as finished (``_finished/<load>``).

Whatever step a load is broken off in, the bill can be put right: before step 1 is
done nothing of the bill has changed, and after it everything needed is staged, so
publishing is simply done again. A load that is finished is not done twice. Folders
that begin with ``_`` are not seen by readers of the bill.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.amounts import TOTAL_AMOUNT, exact_sum
from tallyloom.sources.bill import read_bill
from tallyloom.sources.bill_schema import BILL_SCHEMA, PARTITION_COLUMN
from tallyloom.sources.conform import conform
from tallyloom.sources.shared import parquet_or_none

#: The month as it is spelt in the names of directories.
MONTH_FOLDER = PARTITION_COLUMN.upper()
_LOAD = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*")
_CONTROL = (
    f"load_id string, {PARTITION_COLUMN} string, raw_line_items long, cost {TOTAL_AMOUNT}, "
    "staged_at timestamp"
)
#: Months of which a task holds a file open; lines of more are sorted by month first.
OPEN_MONTHS = 32
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
_COST = "line_item_unblended_cost"
_SAME = ["raw_line_items", "cost"]


@dataclass(frozen=True)
class _Load:
    """Where a load leaves its signs."""

    path: str
    load_id: str

    def __post_init__(self) -> None:
        if not _LOAD.fullmatch(self.load_id):
            raise ValueError(f"load id must be letters, digits, dots and dashes, got {self.load_id!r}")

    def at(self, step: str) -> str:
        return f"{self.path.rstrip('/')}/_{step}/load={self.load_id}"


def _controls(lines: DataFrame) -> DataFrame:
    """Lines and exact cost of each month: one row per month, counted where the lines are."""
    return lines.groupBy(PARTITION_COLUMN).agg(
        F.count("*").alias("raw_line_items"), exact_sum(F.col(_COST)).alias("cost")
    )


def _signs(spark: SparkSession, path: str, step: str) -> DataFrame:
    found = parquet_or_none(spark, f"{path.rstrip('/')}/_{step}", _CONTROL)
    if found is None:
        return spark.createDataFrame([], _CONTROL)
    return found.select("load_id", PARTITION_COLUMN, *_SAME, "staged_at")


def loads(spark: SparkSession, path: str) -> DataFrame:
    """Staged loads of a bill: lines and cost by month, and whether they are finished."""
    finished = _signs(spark, path, "finished").select("load_id").distinct()
    return (
        _signs(spark, path, "staged")
        .join(finished.withColumn("finished", F.lit(True)), "load_id", "left")
        .na.fill(False, ["finished"])
        .orderBy("staged_at", "load_id", PARTITION_COLUMN)
    )


def _check_months(lines: DataFrame) -> None:
    month = F.col(PARTITION_COLUMN)
    wrong = lines.where(month.isNull() | ~month.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"))
    first = wrong.select(month).first()
    if first is not None:
        raise ValueError(f"billing month of a line must look like 2026-06, got {first[0]!r}")


@contextmanager
def _files_open(spark: SparkSession) -> Iterator[None]:
    """Lets a task write several months side by side, unless the session says how many."""
    before = spark.conf.get(_OPEN_FILES, None)
    if int(before or 0) > 0:
        yield
        return
    spark.conf.set(_OPEN_FILES, str(OPEN_MONTHS))
    try:
        yield
    finally:
        spark.conf.unset(_OPEN_FILES) if before is None else spark.conf.set(_OPEN_FILES, before)


def _write_months(lines: DataFrame, path: str, dynamic: bool) -> None:
    """One directory per month, and there a file for each task that has lines of it.

    Nothing is shuffled, and nothing sorted while a task has few months.
    """
    months = lines.withColumnRenamed(PARTITION_COLUMN, MONTH_FOLDER)
    mode = "dynamic" if dynamic else "static"
    writer = months.write.mode("overwrite").option("partitionOverwriteMode", mode)
    with _files_open(lines.sparkSession):
        writer.partitionBy(MONTH_FOLDER).parquet(path)


def stage_load(
    spark: SparkSession, bill: DataFrame, path: str, load_id: str, schema: T.StructType = BILL_SCHEMA
) -> None:
    """Step 1: writes the delivered lines beside the bill; a second try starts anew.

    The lines are brought to the declared schema first (``conform``). A month that is
    NULL or of another form raises ``ValueError``, and nothing is staged. Lines of a
    month are brought together by the one shuffle of a load, and a large month is cut
    into files of the advised size; columns that were not delivered are added after it.
    """
    load = _Load(path, load_id)
    names = {name.lower() for name in (*bill.columns, PARTITION_COLUMN)}
    delivered = T.StructType([field for field in schema if field.name.lower() in names])
    lines = conform(bill, delivered)
    _check_months(lines)
    by_month = lines.hint("rebalance", PARTITION_COLUMN)
    _write_months(conform(by_month, schema), load.at("staging"), dynamic=False)
    staged = read_bill(spark, load.at("staging"), schema)
    signs = _controls(staged).select(
        F.lit(load_id).alias("load_id"), PARTITION_COLUMN, *_SAME, F.current_timestamp().alias("staged_at")
    )
    signs.coalesce(1).write.mode("overwrite").parquet(load.at("staged"))


def publish_load(
    spark: SparkSession, path: str, load_id: str, schema: T.StructType = BILL_SCHEMA
) -> None:
    """Steps 2 and 3, as often as it takes: the staged months replace the stored ones.

    Raises ``RuntimeError`` if a month read back is not what was staged. The staged
    lines are given up once the load is finished.
    """
    load = _Load(path, load_id)
    staged = _signs(spark, path, "staged").where(F.col("load_id") == load_id).collect()
    if not staged:
        raise ValueError(f"load {load_id} is not staged")
    months = sorted(row[PARTITION_COLUMN] for row in staged)
    lines = read_bill(spark, load.at("staging"), schema)
    _write_months(lines, path, dynamic=True)
    stored = read_bill(spark, path, schema, (months[0], months[-1]))
    found = {
        row[PARTITION_COLUMN]: tuple(row[name] for name in _SAME)
        for row in _controls(stored.where(F.col(PARTITION_COLUMN).isin(months))).collect()
    }
    wanted = {row[PARTITION_COLUMN]: tuple(row[name] for name in _SAME) for row in staged}
    if found != wanted:
        raise RuntimeError(f"load {load_id} is not whole: staged {wanted}, stored {found}")
    spark.createDataFrame(staged, _CONTROL).coalesce(1).write.mode("overwrite").parquet(load.at("finished"))
    nothing = spark.createDataFrame([], schema).drop(PARTITION_COLUMN)
    nothing.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(load.at("staging"))


def finish_loads(spark: SparkSession, path: str, schema: T.StructType = BILL_SCHEMA) -> list[str]:
    """Publishes the loads that were broken off after staging, oldest first; their ids."""
    waiting = loads(spark, path).where(~F.col("finished"))
    rows = waiting.groupBy("load_id").agg(F.min("staged_at").alias("at")).orderBy("at", "load_id").collect()
    for row in rows:
        publish_load(spark, path, row.load_id, schema)
    return [row.load_id for row in rows]


def refresh_months(
    spark: SparkSession, bill: DataFrame, path: str, load_id: str, schema: T.StructType = BILL_SCHEMA
) -> bool:
    """Loads the months of a delivery in place of what is stored of them.

    The delivery is whole for every month that it has; other months, and their files,
    stay as they are. True if the load was done now, false if a load of this id is
    finished already. Loads that were broken off are finished first, so that an
    older delivery never replaces a newer one. A delivery without lines changes
    nothing. One load at a time may be written to a bill.
    """
    finish_loads(spark, path, schema)
    if not loads(spark, path).where((F.col("load_id") == load_id) & F.col("finished")).isEmpty():
        return False
    stage_load(spark, bill, path, load_id, schema)
    if _signs(spark, path, "staged").where(F.col("load_id") == load_id).isEmpty():
        return True
    publish_load(spark, path, load_id, schema)
    return True
