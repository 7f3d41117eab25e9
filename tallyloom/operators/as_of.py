"""As-of join: what was last known at the time of a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import quoted, steps_of, utc_micros

#: A key's rows are set in order by stretches of so many seconds, each by itself.
STRETCH_SECONDS = 86_400
#: Rows that can't meet an event are spread over so many groups.
SPREAD = 1024


def as_of(
    rows: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    time: str,
    values: Sequence[str],
    event_time: str | None = None,
    strict: bool = False,
    stretch_seconds: int = STRETCH_SECONDS,
) -> DataFrame:
    """Every row with the latest event of its key at or before it.

    ``rows`` keep their columns and get a struct ``as_of`` of the event's time, as
    ``at``, and its ``values``; NULL where no event of the key came before. With
    ``strict`` the event must be earlier than the row. Of events of one key at one
    time the greatest counts, by the values in their order, NULL smallest; the values
    of the event that counts may be NULL. Rows and events whose key or time is NULL
    meet nothing; such rows stay. Times are timestamps, with or without zone.

    Rows and events are laid on one line of time and cut into stretches. They are set
    in order within key and stretch only; the last event of each stretch is carried
    on by a pass over one row per key and stretch. So a key with a third of all rows
    is as many groups as it has stretches. Nothing is collected, and the rows are
    shuffled once.
    """
    keys = list(by)
    at = event_time or time
    names = [F.col(quoted(name)) for name in keys]
    known = _known(events, keys, at, values)
    usable = utc_micros(rows, time).isNotNull()
    for name in names:
        usable &= name.isNotNull()
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")
    asked = rows.select(
        *(name.alias(f"_key{number}") for number, name in enumerate(names)),
        utc_micros(rows, time).alias("_micros"),
        F.when(usable, F.lit(-1)).otherwise(spread).alias("_spread"),
        F.lit(None).cast(known.schema["_event"].dataType).alias("_event"),
        F.struct(*(F.col(quoted(name)) for name in rows.columns)).alias("_row"),
    )
    stretch = steps_of("_micros", f"{1_000_000 * stretch_seconds}L").alias("_stretch")
    events_too = known.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType))
    line = asked.unionByName(events_too).select("*", stretch)
    group = [*(f"_key{number}" for number in range(len(keys))), "_spread", "_stretch"]
    # At one time an event comes before a row, with ``strict`` after it.
    order = F.col("_event").isNull() if not strict else F.col("_event").isNotNull()
    within = W.partitionBy(*group).orderBy("_micros", order)
    so_far = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    here = line.withColumn("_here", F.last("_event", ignorenulls=True).over(so_far))
    before = _carried_on(asked.unionByName(events_too).drop("_row").select("*", stretch), group)
    met = here.where("_row IS NOT NULL").join(before, group, "left")
    return met.select(
        *(F.col(f"_row.{quoted(name)}").alias(name) for name in rows.columns),
        F.coalesce("_here", "_before").alias("as_of"),
    )


def _known(events: DataFrame, keys: list[str], at: str, values: Sequence[str]) -> DataFrame:
    """One event per key and time; copies are taken together where they are read."""
    event = F.struct(F.col(quoted(at)).alias("at"), *(F.col(quoted(name)) for name in values))
    found = events.select(
        *(F.col(quoted(name)).alias(f"_key{number}") for number, name in enumerate(keys)),
        utc_micros(events, at).alias("_micros"),
        event.alias("_event"),
    ).dropna(subset=[*(f"_key{number}" for number in range(len(keys))), "_micros"])
    group = [name for name in found.columns if name != "_event"]
    latest = found.groupBy(*group).agg(F.max("_event").alias("_event"))
    return latest.withColumn("_spread", F.lit(-1))


def _carried_on(line: DataFrame, group: list[str]) -> DataFrame:
    """For each key and stretch: the last event of an earlier stretch, as ``_before``."""
    # Greatest by time first: the event's time is the first field of the struct.
    last = line.where("_spread = -1").groupBy(*group).agg(F.max("_event").alias("_last"))
    earlier = W.partitionBy(*group[:-1]).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    before = F.last("_last", ignorenulls=True).over(earlier)
    return last.select(*group, before.alias("_before")).where("_before IS NOT NULL")
