"""Small helpers of the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows of a few numbers each may be broadcast.
SMALL_ROWS = 20_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def found_by_workers(spark: SparkSession) -> None:
    """Lets Python workers of a local session look for the package where it lies."""
    home = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.setdefault("PYTHONPATH", home)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine has none (tests), a temporary folder is set. On a
    cluster that would be another folder on each machine: it raises ``ValueError``.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def stored(frame: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def doc_key(column: str) -> Column:
    """The doc_id as a long that is never NULL, to join and order by."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def text_hash(column: str) -> Column:
    """Tells rows with the same doc_id apart; NULL counts as an empty text."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where a column of ``rows`` has them already."""
    taken = {name.lower() for name in rows.columns}
    found = []
    for name in names:
        while name in taken:
            name += "_"
        found.append(name)
    return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def attach(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    salt: Column,
    small_rows: int = SMALL_ROWS,
    salts: int = 64,
) -> DataFrame:
    """Left join of ``facts`` (one row per ``key``, of a few numbers) to ``rows``.

    ``facts`` must be stored, since its rows are counted. Up to ``small_rows`` of
    them are broadcast. More are joined by key and salt, so that a key with a
    third of all rows is spread over ``salts`` tasks. A NULL key finds nothing.
    """
    if facts.count() <= small_rows:
        return rows.join(F.broadcast(facts), key, "left")
    salted = rows.withColumn("_salt", F.pmod(F.hash(salt), F.lit(salts)))
    spread = facts.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(spread, [key, "_salt"], "left").drop("_salt")
