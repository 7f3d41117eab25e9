"""What changed between two deliveries of a bill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.amounts import LINE_AMOUNT, TOTAL_AMOUNT, as_usd
from tallyloom.functions.columns import quoted

LINE_ID = "identity_line_item_id"
_COST = "line_item_unblended_cost"
#: A cost times a number of copies of its line must fit in a decimal of 38 digits.
_COPIES = "decimal(9,0)"
_KINDS = ("added", "removed", "changed", "same")


def _content(lines: DataFrame, columns: Sequence[str]) -> Column:
    """A hash of what a line says; maps are compared entry by entry, in order."""
    parts = []
    for name in columns:
        value = F.col(quoted(name))
        if isinstance(lines.schema[name].dataType, T.MapType):
            value = F.array_sort(F.map_entries(value))
        # NULL is told from any value by a mark of its own.
        parts += [value.isNull(), value]
    return F.xxhash64(*parts)


def line_changes(
    old: DataFrame, new: DataFrame, line_id: str = LINE_ID, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per line id that is not the same in both deliveries.

    Columns: the id, ``kind`` (added, removed, changed), lines and exact cost in the
    old and in the new delivery, without copies that both have. Deliveries are
    multisets: of a line that is there three times and then twice, one is removed.
    Lines without an id are told apart by what they say, so they are added or removed
    only. ``columns`` are those compared, by default all that both have.
    """
    return _by_line(old, new, line_id, columns).where("kind <> 'same'")


def _by_line(old: DataFrame, new: DataFrame, line_id: str, columns: Sequence[str] | None) -> DataFrame:
    if columns is None:
        columns = [name for name in old.columns if name in set(new.columns)]

    def marked(lines: DataFrame, is_new: int) -> DataFrame:
        return lines.select(
            F.col(line_id).alias("line_id"),
            _content(lines, columns).alias("content"),
            F.coalesce(F.col(_COST).cast(LINE_AMOUNT), F.lit(0)).cast(LINE_AMOUNT).alias("cost"),
            F.lit(1 - is_new).alias("in_old"),
            F.lit(is_new).alias("in_new"),
        )

    # Copies are counted in the tasks that read them, ids are spread evenly: no task
    # is given a large group, whichever line is repeated however often.
    copies = (
        marked(old, 0)
        .unionAll(marked(new, 1))
        .groupBy("line_id", "content", "cost")
        .agg(F.sum("in_old").alias("in_old"), F.sum("in_new").alias("in_new"))
    )
    both = F.least("in_old", "in_new")
    copies = copies.select(
        "line_id",
        F.when(F.col("line_id").isNull(), F.col("content")).alias("content"),
        "cost",
        both.cast(_COPIES).alias("same"),
        (F.col("in_old") - both).cast(_COPIES).alias("gone"),
        (F.col("in_new") - both).cast(_COPIES).alias("come"),
        "in_old",
        "in_new",
    )

    def total(number: str) -> Column:
        return F.sum((F.col("cost") * F.col(number)).cast(TOTAL_AMOUNT)).cast(TOTAL_AMOUNT)

    by_id = copies.groupBy("line_id", "content").agg(
        *(F.sum(name).cast("long").alias(f"{name}_lines") for name in ("same", "gone", "come")),
        *(total(name).alias(f"{name}_cost") for name in ("same", "gone", "come")),
        (F.sum("in_old") > 0).alias("was"),
        (F.sum("in_new") > 0).alias("is"),
    )
    moved = (F.col("gone_lines") + F.col("come_lines")) > 0
    # An id may have copies that stay beside others that change: a row of each kind.
    kind = (
        F.when(F.col("line_id").isNull() & (F.col("gone_lines") > 0), "removed")
        .when(F.col("line_id").isNull(), "added")
        .when(F.col("was") & F.col("is"), "changed")
        .when(F.col("is"), "added")
        .otherwise("removed")
    )
    zero = F.lit(0).cast("long")
    differing = F.struct(
        kind.alias("kind"),
        F.col("gone_lines").alias("old_lines"),
        F.col("come_lines").alias("new_lines"),
        F.col("gone_cost").alias("old_cost"),
        F.col("come_cost").alias("new_cost"),
    )
    equal = F.struct(
        F.lit("same").alias("kind"),
        F.col("same_lines").alias("old_lines"),
        F.col("same_lines").alias("new_lines"),
        F.col("same_cost").alias("old_cost"),
        F.col("same_cost").alias("new_cost"),
    )
    parts = F.filter(
        F.array(F.when(moved, differing), F.when(F.col("same_lines") > zero, equal)),
        lambda part: part.isNotNull(),
    )
    return by_id.select("line_id", F.explode(parts).alias("part")).select("line_id", "part.*")


def refresh_changes(
    old: DataFrame, new: DataFrame, line_id: str = LINE_ID, columns: Sequence[str] | None = None
) -> DataFrame:
    """Lines and cost added, removed, changed and left the same: one row of each kind.

    The four differences add up to the difference of the two grand totals, to the
    last digit.
    """
    totals = _by_line(old, new, line_id, columns).groupBy("kind").agg(
        *(F.sum(name).alias(name) for name in ("old_lines", "new_lines")),
        *(F.sum(name).cast(TOTAL_AMOUNT).alias(name) for name in ("old_cost", "new_cost")),
    )
    kinds = old.sparkSession.createDataFrame([(kind,) for kind in _KINDS], "kind string")
    found = kinds.join(totals, "kind", "left").na.fill(0)
    old_cost, new_cost = F.coalesce("old_cost", F.lit(0)), F.coalesce("new_cost", F.lit(0))
    return found.select(
        "kind",
        "old_lines",
        "new_lines",
        as_usd(old_cost).alias("old_cost_usd"),
        as_usd(new_cost).alias("new_cost_usd"),
        as_usd(new_cost - old_cost).alias("difference_usd"),
    ).orderBy("kind")
