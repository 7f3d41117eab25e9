"""Removing repeated passages of lines (operator 9).

Every three consecutive lines are hashed together. Of a window that occurs more
than once anywhere, only the first occurrence stays; the lines that later ones
cover are merged per document and removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import doc_key, fresh, let, read_table, stored, text_hash

WINDOW = 3

_PLACE = ("_id", "_hash", "pos")


def lines_of(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """Every window: its document, the position of its first line, its hash."""

    def joined(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - width)
        hashed: Callable[[Column], Column] = lambda at: F.xxhash64(
            *(hashes[at + line] for line in range(width))
        )
        return F.when(F.size(hashes) >= width, F.transform(starts, hashed))

    of_lines = F.transform(lines_of("text"), lambda line: F.xxhash64(F.trim(line)))
    return docs.select(
        doc_key("doc_id").alias("_id"),
        text_hash("text").alias("_hash"),
        F.posexplode(let(of_lines, joined)).alias("pos", "window"),
    )


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents with ``text`` rid of repeated windows, ``n_lines`` and ``n_removed``.

    Reads ``doc_id`` and ``text``; all columns are kept, and ``n_lines`` (lines
    before) and ``n_removed`` replace any of that name. Lines are compared without
    blanks at their ends. Occurrences are ordered by doc_id (NULL first), hash of
    the text, and position; a window repeated within one document counts too. A
    removed line always has an equal one that stays.

    Rows with the same doc_id and text count as one document and come out alike.
    A text of fewer than ``width`` lines is left as it is; NULL stays NULL, with 0
    lines. An empty table gives an empty one. A window as frequent as a third of
    all is counted within each task first, and the join that finds its later
    occurrences is one that Spark splits.
    """
    windows = _windows(docs, width)
    repeated = stored(
        windows.groupBy("window")
        .agg(F.count("*").alias("times"), F.min(F.struct(*_PLACE)).alias("first"))
        .where("times > 1")
        .select("window", "first")
    )
    later = windows.join(repeated, "window").where(F.struct(*_PLACE) > F.col("first"))
    covered = F.explode(F.sequence(F.col("pos"), F.col("pos") + (width - 1)))
    removed = (
        later.select("_id", "_hash", covered.alias("line"))
        .groupBy("_id", "_hash")
        .agg(F.collect_set("line").alias("_removed"))
    )
    key, mark, gone = fresh(docs, "_id", "_hash", "_removed")
    keyed = docs.withColumns({key: doc_key("doc_id"), mark: text_hash("text")})
    found = keyed.join(
        removed.toDF(key, mark, gone).hint("shuffle_hash"), [key, mark], "left"
    )

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(kept, lambda line: lines[line]), "\n")

    changed = F.when(F.col(gone).isNull(), F.col("text")).otherwise(
        let(lines_of("text"), without)
    )
    counts = {"n_lines": F.size(lines_of("text")), "n_removed": F.size(gone)}
    return found.withColumns(
        {name: F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)) for name, n in counts.items()}
        | {"text": changed}
    ).drop(key, mark, gone)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


OP9_SQL = """
WITH cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), windows AS (
  SELECT doc_id, pos, trim(lines[pos + 1], ' ') AS a, trim(lines[pos + 2], ' ') AS b,
         trim(lines[pos + 3], ' ') AS c
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM cut)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
  FROM windows
), removed AS (
  SELECT doc_id, list(DISTINCT pos + covered + 1) AS gone
  FROM ranked, (VALUES (0), (1), (2)) AS three(covered)
  WHERE nth > 1 GROUP BY doc_id
)
SELECT doc_id,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(
         list_filter(lines, lambda line, nr: NOT list_contains(gone, nr)), chr(10)) END AS text,
       coalesce(len(lines), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed
FROM cut LEFT JOIN removed USING (doc_id)"""
