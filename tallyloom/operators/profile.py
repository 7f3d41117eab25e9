"""Looking at a bill before using it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.columns import literal, quoted
from tallyloom.sources.bill_schema import PARTITION_COLUMN


def preview(bill: DataFrame, n: int = 10, order: Sequence[Column] | None = None) -> DataFrame:
    """``n`` rows: any, or the first in an order.

    Without an order Spark stops scanning once it has them. With one, each task
    keeps its own first ``n``.
    """
    return (bill if order is None else bill.orderBy(*order)).limit(n)


def row_order(bill: DataFrame) -> list[Column]:
    """All columns in turn, NULLs first; a map as its entries in order.

    Rows that are equal in this order do not differ.
    """
    return [
        F.asc_nulls_first(
            F.array_sort(F.map_entries(field.name))
            if isinstance(field.dataType, T.MapType)
            else F.col(field.name)
        )
        for field in bill.schema
    ]


def _counts(field: T.StructField) -> Iterator[str]:
    name = quoted(field.name)
    yield f"count({name}) AS {quoted('filled_' + field.name)}"
    if isinstance(field.dataType, T.StringType):
        yield f"count_if({name} = '') AS {quoted('blank_' + field.name)}"


def _profile_row(field: T.StructField, partition_columns: Sequence[str]) -> str:
    is_string = isinstance(field.dataType, T.StringType)
    return f"""named_struct(
        'column_name', {literal(field.name)},
        'data_type', {literal(field.dataType.simpleString())},
        'is_partition', {field.name in partition_columns},
        'row_count', row_count,
        'null_count', row_count - {quoted('filled_' + field.name)},
        'blank_count', {quoted('blank_' + field.name) if is_string else '0L'})"""


def _profile(
    bill: DataFrame, fields: Sequence[T.StructField], partition_columns: Sequence[str]
) -> DataFrame:
    counts = bill.selectExpr(
        "count(*) AS row_count", *(c for field in fields for c in _counts(field))
    )
    rows = ", ".join(_profile_row(field, partition_columns) for field in fields)
    return counts.selectExpr(f"inline(array({rows}))")


def column_profile(
    bill: DataFrame,
    partition_columns: Sequence[str] = (PARTITION_COLUMN,),
    columns_per_pass: int = 48,
) -> DataFrame:
    """One row per column: type, partition flag, rows, NULLs and blanks.

    ``blank_count`` counts empty strings; it is 0 for other types. Shows at a
    glance whether the export carries resource ids, principals and tags at all.

    Each pass reads its own columns and counts them in one aggregate. More than
    100 columns read or counts made in one pass would switch off the vectorised
    Parquet reader and code generation, hence several passes of less than half
    as many columns; no column is read twice.
    """
    fields = list(bill.schema)
    passes = (
        _profile(bill, fields[at : at + columns_per_pass], partition_columns)
        for at in range(0, len(fields), columns_per_pass)
    )
    return reduce(DataFrame.unionByName, passes)
