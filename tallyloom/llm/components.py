"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import attach, stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it can reach, per linked node.

    Reads columns ``a`` and ``b`` (long). Nodes carry the smallest root known.
    In each round a root joins the smallest root next to any of its nodes, and so
    do they, to the end, until nothing changes. A node needs its own links only;
    what is gathered per root is a minimum, taken within each task before the
    shuffle, and handed back by ``attach``, so that one component may hold most of
    the nodes. A path is followed in steps that double, so rounds and steps grow
    with the logarithm of the number of nodes.

    Repeated links and links of a node with itself change nothing; no link gives
    no row.
    """
    arcs = stored(
        links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    roots = stored(
        arcs.groupBy(F.col("a").alias("node")).agg(
            F.least("node", F.min("b")).alias("root")
        )
    )
    while True:
        around = (
            arcs.join(roots.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        hooks = stored(
            roots.join(around, "node")
            .groupBy("root")
            .agg(F.min(F.least("root", "near")).alias("up"))
        )
        hooks = _followed(hooks)
        moved = stored(
            attach(roots, hooks, "root", F.col("node")).select(
                "node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")
            )
        )
        roots = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return roots


def _followed(hooks: DataFrame) -> DataFrame:
    """``root`` and ``up``, now the end of the path that begins with the given ``up``."""
    while True:
        above = hooks.select(F.col("root").alias("up"), F.col("up").alias("above"))
        further = stored(
            attach(hooks, above, "up", F.col("root")).select(
                "root",
                F.coalesce("above", "up").alias("up"),
                F.coalesce(F.col("above") != F.col("up"), F.lit(False)).alias("moved"),
            )
        )
        hooks = further.drop("moved")
        if further.where("moved").isEmpty():
            return hooks
