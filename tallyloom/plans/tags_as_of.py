"""Costs by the tag that a resource had when it was used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.amounts import cost, lines
from tallyloom.functions.columns import filled, is_blank, tag
from tallyloom.operators.as_of import STRETCH_SECONDS, as_of
from tallyloom.operators.cost_report import cost_report
from tallyloom.sources.bill import Period, for_period

OWN, EARLIER, NONE = "own", "earlier", "none"
_RESOURCE = "line_item_resource_id"
_START = "line_item_usage_start_date"
_COST = "line_item_unblended_cost"


def tagged_as_of(
    bill: DataFrame,
    key: str,
    period: Period = None,
    tags_column: str = "resource_tags",
    stretch_seconds: int = STRETCH_SECONDS,
) -> DataFrame:
    """Lines with ``tag_value`` and ``tag_from``: their own tag, or an earlier one.

    A line without the tag (NULL and blank alike) takes that of the latest line of
    its resource which has it and was used no later; of several at that time the
    greatest. ``tag_from`` is ``own``, ``earlier`` or ``none``. Lines without a
    resource have their own tag or none. Columns: resource, time, cost, and these.
    Tags from before the period are not looked for.
    """
    value = tag(F.col(tags_column), key)
    own = F.when(filled(value), value)
    resource = F.when(~is_blank(F.col(_RESOURCE)), F.col(_RESOURCE))
    named = for_period(bill, period).select(
        resource.alias("resource_id"), _START, _COST, own.alias("own_tag")
    )
    tagged = named.where(F.col("own_tag").isNotNull())
    found = as_of(
        named, tagged, ["resource_id"], _START, ["own_tag"], stretch_seconds=stretch_seconds
    )
    earlier = F.col("as_of.own_tag")
    source = F.when(F.col("own_tag").isNotNull(), OWN).when(earlier.isNotNull(), EARLIER).otherwise(NONE)
    return found.select(
        "resource_id",
        _START,
        _COST,
        F.coalesce("own_tag", earlier).alias("tag_value"),
        source.alias("tag_from"),
    )


def cost_by_tag_as_of(
    bill: DataFrame,
    key: str,
    period: Period = None,
    tags_column: str = "resource_tags",
    sort: bool = True,
) -> DataFrame:
    """Cost and lines by tag value and where the tag is from (``tagged_as_of``)."""
    found = tagged_as_of(bill, key, period, tags_column)
    dims = {"tag_value": F.col("tag_value"), "tag_from": F.col("tag_from")}
    return cost_report(found, dims, {"cost_usd": cost(), "lines": lines()}, sort=sort)
