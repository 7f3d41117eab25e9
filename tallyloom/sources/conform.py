"""Bringing a bill whose files drifted back to the declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyloom.functions.columns import quoted
from tallyloom.sources.bill_schema import BILL_SCHEMA


def _by_lower_name(schema: T.StructType) -> dict[str, T.StructField]:
    return {field.name.lower(): field for field in schema}


def _same_but_for_case(schema: T.StructType) -> dict[str, list[T.StructField]]:
    """Columns whose names differ in case only, by their name in lower case."""
    found: dict[str, list[T.StructField]] = {}
    for field in schema:
        found.setdefault(field.name.lower(), []).append(field)
    return {name: fields for name, fields in found.items() if len(fields) > 1}


def utc_instant(value: str, kind: T.DataType) -> str:
    """SQL for a value as an instant, in UTC where it names no zone itself.

    A cast alone would take values without zone to be of the session's zone, and
    with it move their days. So they are counted from 1970, as numbers. A text that
    is blank is no instant.
    """
    if isinstance(kind, T.TimestampNTZType):
        return f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', {value}))"
    if isinstance(kind, T.DateType):
        return f"timestamp_seconds(86400L * unix_date({value}))"
    if not isinstance(kind, T.StringType):
        return f"CAST({value} AS TIMESTAMP)"
    # After the date: a zone has a letter or a sign, a time has neither.
    text = f"nullif(trim({value}), '')"
    return f"""CASE
        WHEN {text} RLIKE '^[^ T]+[ T].*[A-Za-z+-]' THEN CAST({text} AS TIMESTAMP)
        WHEN {text} RLIKE '[ T]' THEN CAST({text} || 'Z' AS TIMESTAMP)
        ELSE timestamp_seconds(86400L * unix_date(CAST({text} AS DATE))) END"""


def conform(bill: DataFrame, schema: T.StructType = BILL_SCHEMA) -> DataFrame:
    """Order and cast the columns as declared; add missing ones as NULL.

    For bills read without a schema. Columns which are not declared are left
    out; ``schema_drift`` names them. A value that cannot be cast fails the job
    under ANSI mode rather than turning into NULL. Timestamps and texts without a
    zone are taken as UTC, whatever the session's zone; a blank text is NULL as a time. Declared columns that are
    there twice, their names differing in case only, raise ``ValueError``.
    """
    found = _by_lower_name(bill.schema)
    twice = _same_but_for_case(bill.schema).keys() & _by_lower_name(schema).keys()
    if twice:
        raise ValueError(f"columns are there twice but for case: {sorted(twice)}")

    def declared(field: T.StructField) -> str:
        source = found.get(field.name.lower())
        value = "NULL" if source is None else quoted(source.name)
        if source is not None and isinstance(field.dataType, T.TimestampType):
            return f"{utc_instant(value, source.dataType)} AS {quoted(field.name)}"
        return f"CAST({value} AS {field.dataType.simpleString()}) AS {quoted(field.name)}"

    return bill.selectExpr(*map(declared, schema))


def schema_drift(bill: DataFrame, schema: T.StructType = BILL_SCHEMA) -> DataFrame:
    """One row per column that is missing, undeclared, of another type, or twice.

    ``duplicate`` are columns whose names differ in case only, a row for each. Compares the two schemas only; no data is read.
    """
    found, declared = _by_lower_name(bill.schema), _by_lower_name(schema)
    rows = []
    for name, field in declared.items():
        wanted = field.dataType.simpleString()
        if name not in found:
            rows.append((field.name, "missing", wanted, None))
        elif found[name].dataType != field.dataType:
            rows.append((field.name, "type", wanted, found[name].dataType.simpleString()))
    for name, field in found.items():
        if name not in declared:
            rows.append((field.name, "undeclared", None, field.dataType.simpleString()))
    for fields in _same_but_for_case(bill.schema).values():
        for field in fields:
            rows.append((field.name, "duplicate", None, field.dataType.simpleString()))
    return bill.sparkSession.createDataFrame(
        rows, "column_name string, drift string, declared_type string, found_type string"
    )
