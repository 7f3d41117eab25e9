"""Writing reports to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_FORMATS = ("csv", "parquet")
NULL_MARK = "\\N"


def _csv_options(null_value: str) -> dict[str, str]:
    return {"header": "true", "escape": '"', "nullValue": null_value}


def read_report(
    spark: SparkSession, path: str, schema: T.StructType, null_value: str = NULL_MARK
) -> DataFrame:
    """A report written as CSV, with its NULLs and blanks as they were."""
    return spark.read.options(**_csv_options(null_value)).schema(schema).csv(path)


def write_report(
    report: DataFrame,
    path: str,
    fmt: str = "csv",
    mode: str = "errorifexists",
    null_value: str = NULL_MARK,
) -> None:
    """Write a report as CSV with a header line, or as Parquet.

    In CSV a NULL is written as ``null_value`` and a blank value as a quoted empty
    field, so the two stay apart. Read it with ``read_report``, or with the same
    ``nullValue`` and an escape of ``"``.

    Every task writes its own file. A sorted report is range-partitioned by its
    sort keys, so reading the files in name order gives the sorted report and no
    task ever holds more than its range.
    """
    if fmt not in _FORMATS:
        raise ValueError(f"format must be one of {_FORMATS}, got {fmt!r}")
    writer = report.write.mode(mode)
    if fmt == "csv":
        writer.options(**_csv_options(null_value)).csv(path)
    else:
        writer.parquet(path)
