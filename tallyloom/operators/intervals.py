"""Joins by time: rows within terms, and overlapping spans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import quoted, steps_of, utc_micros
from tallyloom.sources.shared import stored

#: Cells of the lowest level, in seconds; each level has cells of twice the length.
FINEST_SECONDS = 3600
_CELL = f"shiftleft({1_000_000 * FINEST_SECONDS}L, _level)"
#: Cells of terms are broadcast up to so many rows and characters of JSON, as measured.
SMALL_ROWS = 20_000
SMALL_CHARS = 8_000_000
SALTS = 16


def _cells(terms: DataFrame, start: str, end: str) -> DataFrame:
    """Each term with the cells of its level, ``_level`` and ``_cell``: two at most.

    The cells of a term's level are at least as long as the term. Terms without
    length, or with a NULL at either side, hold no time and are left out.
    """
    first, last = utc_micros(terms, start), utc_micros(terms, end) - 1
    spans = terms.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    finest = 1_000_000 * FINEST_SECONDS
    units = (F.col("_last") - F.col("_first") + finest) / finest
    level = F.greatest(F.ceil(F.log2(units)), F.lit(0)).cast("int")
    cells = F.sequence(steps_of("_first", _CELL), steps_of("_last", _CELL))
    return spans.withColumn("_level", level).withColumn("_cell", F.explode(cells))


def in_terms(
    rows: DataFrame,
    terms: DataFrame,
    by: Sequence[str],
    time: str,
    start: str,
    end: str,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Each row with each term of its key that holds its time, as structs ``row``, ``term``.

    A term holds the times from ``start`` up to, but not with, ``end``. A pair comes
    once for each copy of the row and of the term. NULL keys and times meet nothing.

    A term lies in one or two cells of a grid of its own length; a row is looked up
    in one cell of each grid that terms use. So the join is one by equal cells, and
    no more than about half of what meets in a cell is in vain. Few terms, as
    measured in rows and characters, are broadcast; else rows of one cell are spread
    over ``SALTS`` tasks, and its terms sent to each.
    """
    keys = [f"_key{number}" for number in range(len(by))]

    def keyed(frame: DataFrame, *columns: Column | str) -> DataFrame:
        named = [F.col(quoted(name)).alias(key) for name, key in zip(by, keys)]
        return frame.select(*named, *columns).dropna(subset=keys) if keys else frame.select(*columns)

    struct = F.struct(*(F.col(quoted(name)) for name in terms.columns)).alias("term")
    cells = stored(keyed(_cells(terms, start, end), "_level", "_cell", "_first", "_last", struct))
    facts = cells.agg(
        F.count("*").alias("n"),
        F.sum(F.length(F.to_json(F.struct("*")))).alias("chars"),
        F.collect_set("_level").alias("levels"),  # some thirty at most
    ).first()
    found_row = F.struct(*(F.col(quoted(name)) for name in rows.columns)).alias("row")
    asked = keyed(rows, utc_micros(rows, time).alias("_micros"), found_row).where("_micros IS NOT NULL")
    levels = F.array(*map(F.lit, sorted(facts["levels"]))).cast("array<int>")
    asked = asked.withColumn("_level", F.explode(levels)).withColumn(
        "_cell", steps_of("_micros", _CELL)
    )
    on = [*keys, "_level", "_cell"]
    if facts["n"] <= small_rows and (facts["chars"] or 0) <= SMALL_CHARS:
        met = asked.join(F.broadcast(cells), on)
    else:
        salt = F.pmod(F.xxhash64("_micros", F.monotonically_increasing_id()), F.lit(SALTS))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        met = asked.withColumn("_salt", salt).join(cells.withColumn("_salt", every), [*on, "_salt"])
    return met.where("_micros BETWEEN _first AND _last").select("row", "term")


def overlapping(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    start: str,
    end: str,
    right_start: str | None = None,
    right_end: str | None = None,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Each pair of spans of one key that share some time, once, as ``left`` and ``right``.

    Spans go from ``start`` up to, but not with, ``end``; those without length share
    nothing. Of two spans that overlap, either the left one begins within the right
    one, or the right one begins within the left one and later: two joins by
    ``in_terms`` that have no pair in common.
    """
    right_start, right_end = right_start or start, right_end or end

    def long(frame: DataFrame, first: str, last: str) -> DataFrame:
        return frame.where(F.col(quoted(first)) < F.col(quoted(last)))

    left, right = long(left, start, end), long(right, right_start, right_end)
    begins_within = in_terms(left, right, by, start, right_start, right_end, small_rows).select(
        F.col("row").alias("left"), F.col("term").alias("right")
    )
    begins_later = (
        in_terms(right, left, by, right_start, start, end, small_rows)
        .select(F.col("term").alias("left"), F.col("row").alias("right"))
        .where(F.col(f"right.{quoted(right_start)}") > F.col(f"left.{quoted(start)}"))
    )
    return reduce(DataFrame.unionAll, [begins_within, begins_later])
