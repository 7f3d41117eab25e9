"""All subtotals of a report in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.amounts import Measure, cost, lines
from tallyloom.functions.columns import quoted
from tallyloom.operators.cost_report import Dims, by_cost, grouped_totals, shown
from tallyloom.sources.bill import Period


def subtotals(
    bill: DataFrame,
    dims: Dims,
    period: Period = None,
    sets: Sequence[Sequence[str]] | None = None,
    where: Sequence[Column] = (),
    sort: bool = True,
) -> DataFrame:
    """Costs by several sets of the dimensions: every combination, or those of ``sets``.

    A row has NULL in the dimensions it sums over; as a dimension may itself be NULL,
    ``level`` tells which they are: a bit for each dimension, the last one lowest, 1
    where it is summed over. Level 0 is the report by all dimensions; the highest is
    the grand total. A bill without lines has no row.

    The lines are summed to one row per full group first, and only those rows are
    multiplied by the number of sets.
    """
    measures = {"cost_usd": cost(), "lines": lines()}
    groups = grouped_totals(bill, dims, measures, period, where)
    names = list(dims)
    sums = {name: Measure(F.sum(name), measure.shown) for name, measure in measures.items()}
    totals = [measure.total.alias(name) for name, measure in sums.items()]
    columns = [F.col(quoted(name)) for name in names]
    if sets is None:
        grouped = groups.cube(*columns)
    else:
        chosen = [[F.col(quoted(name)) for name in one] for one in sets]
        grouped = groups.groupingSets(chosen, *columns)
    found = grouped.agg(F.grouping_id().alias("level"), *totals)
    report = shown(found.select("level", *columns, *sums), sums)
    return report.orderBy("level", *by_cost(names)) if sort else report


def rolled_up(names: Sequence[str]) -> list[list[str]]:
    """Sets for totals within totals: all dimensions, all but the last, and so on."""
    return reduce(lambda sets, _: [*sets, sets[-1][:-1]], names, [list(names)])
