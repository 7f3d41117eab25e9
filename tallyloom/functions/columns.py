"""Row-level expressions on bill columns.

A missing dimension value is either NULL or the empty string; every function
here says which of the two it looks at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column name for use in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string constant for use in SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def filled(value: Column) -> Column:
    """Filter for rows with a value; NULL as well as ``''`` do not pass."""
    return value != ""


def is_blank(value: Column) -> Column:
    """True for NULL and ``''``, else false."""
    return value.isNull() | (value == "")


def is_filled(value: Column) -> Column:
    """False for NULL and ``''``, else true: fit to be grouped by."""
    return ~is_blank(value)


def or_placeholder(value: Column, placeholder: str) -> Column:
    """The value, or ``placeholder`` where it is NULL or ``''``."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(placeholder))


def tag(tags: Column, key: str) -> Column:
    """Value of one tag; NULL if the map is NULL or lacks the key."""
    return tags[key]


def has_tags(tags: Column) -> Column:
    """True if the map holds at least one key; false for a NULL or empty map."""
    return F.coalesce(F.size(tags) > 0, F.lit(False))


def utc_date(bill: DataFrame, name: str) -> Column:
    """Calendar day in UTC of a timestamp column, whatever the session zone.

    A timestamp without zone is taken as UTC already. One with zone is an
    instant, so its day is counted from the epoch.
    """
    moment = F.col(name)
    if bill.schema[name].dataType == T.TimestampNTZType():
        return F.to_date(moment)
    return F.date_from_unix_date(F.floor(F.unix_seconds(moment) / 86_400).cast("int"))


def utc_micros(frame: DataFrame, name: str) -> Column:
    """Microseconds since 1970 in UTC of a timestamp column, with or without zone."""
    if frame.schema[name].dataType == T.TimestampNTZType():
        since = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', {quoted(name)})"
        return F.expr(since)
    return F.unix_micros(F.col(quoted(name)))


def utc_time(micros: str) -> Column:
    """Timestamp without zone, in UTC, of microseconds since 1970 (SQL for a long)."""
    return F.expr(f"timestampadd(MICROSECOND, {micros}, TIMESTAMP_NTZ'1970-01-01')")


def steps_of(value: str, width: str) -> Column:
    """Number of whole steps of a width, rounded down; both are SQL for longs."""
    return F.expr(f"({value} - pmod({value}, {width})) div {width}")
