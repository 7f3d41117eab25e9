"""Exact top-k search by the threshold algorithm (operator 3).

Vectors are dealt to blocks. In a block every dimension has a list of its vectors
sorted by that component. A query walks down the lists, those with negative weight
from below, and scores every vector it meets. What it has not met cannot score
more than the components it has reached; once that bound is below its k-th score,
it stops.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import read_table, stored

K = 10
SCALE = 1024
#: Expected vectors of a block, and queries of a batch.
BLOCK_VECTORS = 8_192
BATCH_QUERIES = 1_024
#: Entries of each list read first; then twice as many each time.
FIRST_DEPTH = 32
#: Below these limits doubles hold all inner products exactly.
_EXACT = 1 << 20
_EXACT_DIMS = 1 << 13
_NINES = str.maketrans("0123456789", "9876543210")
_LARGEST = (1 << 63) - 1


def finite(embedding: str) -> Column:
    """The vector as doubles; NULL if it is empty or any component is NULL or not finite."""
    values = F.transform(F.col(embedding), lambda x: x.cast("double"))
    fine = F.forall(values, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.when(fine & (F.size(values) > 0), values)


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """Components scaled and rounded down: as longs, or as Python numbers if too large."""
    if len(values) == 0 or np.abs(values).max() * scale < 2.0**62:
        return np.floor(values * scale).astype(np.int64)
    # Doubles of 2**53 or more are whole, so no digit is lost in either order.
    exact = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in values.tolist()]
    return np.array(exact, object)


def _sortable(score: int) -> str:
    """Text that sorts as the number does, whatever its size."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99_999 - len(digits):05d}" + digits.translate(_NINES)


class SortedLists:
    """One list per dimension: the rows of a block in order of that component."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T
        small = int(np.abs(vectors).max(initial=0)) < _EXACT
        self.exact = small and vectors.shape[1] <= _EXACT_DIMS
        self.doubles = vectors.astype(np.float64) if self.exact else None

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.exact and int(np.abs(query).max(initial=0)) < _EXACT:
            query = query.astype(np.float64)
            if 2 * len(rows) > len(self.doubles):
                return (self.doubles @ query)[rows].astype(np.int64)
            return (self.doubles[rows] @ query).astype(np.int64)
        return self.vectors[rows].astype(object) @ query.astype(object)

    def top(
        self, query: np.ndarray, ids: np.ndarray, own: int | None, k: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best, ties to the smaller id, without row ``own``."""
        size = len(ids)
        dims = np.flatnonzero(query)
        met = np.zeros(size, bool)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        read, depth = 0, FIRST_DEPTH
        while True:
            last = min(depth, size)
            new = np.zeros(size, bool)
            for dim in dims:
                rows = self.order[dim]
                new[rows[read:last] if query[dim] < 0 else rows[size - last : size - read]] = True
            if not len(dims) or last == size:
                new[:] = True
            new &= ~met
            met |= new
            if own is not None:
                new[own] = False
            rows = np.flatnonzero(new)
            best_ids = np.concatenate([best_ids, ids[rows]])
            best = np.concatenate([best, self.scores(rows, query)])
            keep = _best_first(best, best_ids)[:k]
            best_ids, best = best_ids[keep], best[keep]
            if met.all():
                return best_ids, best
            if len(best) == k:
                at = np.where(query[dims] < 0, last - 1, size - last)
                reached = self.vectors[self.order[dims, at], dims].astype(object)
                # An unmet vector whose score is the bound itself could win a tie.
                if (reached * query[dims].astype(object)).sum() < int(best[-1]):
                    return best_ids, best
            read, depth = last, 2 * depth


def _best_first(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if scores.dtype != object:
        return np.lexsort((ids, -scores))
    return np.array(sorted(range(len(ids)), key=lambda at: (-scores[at], ids[at])), np.int64)


def _matrix(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    lists = column.combine_chunks()
    return whole_numbers(lists.flatten().to_numpy(), scale).reshape(len(lists), -1)


def _search(k: int, scale: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(queries) and len(vectors):
            lists = SortedLists(_matrix(vectors.column("vector"), scale))
            ids = vectors.column("vec_id").to_numpy()
            places = {row: at for at, row in enumerate(vectors.column("row").to_pylist())}
            wanted = zip(
                queries.column("row").to_pylist(),
                queries.column("vec_id").to_pylist(),
                _matrix(queries.column("vector"), scale),
            )
            for row, query_id, query in wanted:
                best_ids, best = lists.top(query, ids, places.get(row), k)
                for vec_id, score in zip(best_ids.tolist(), best.tolist()):
                    shown = min(max(score, -_LARGEST), _LARGEST)
                    found.append((row, query_id, vec_id, shown, _sortable(score)))
        columns = list(zip(*found)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.Table.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)],
            ["row", "query_id", "vec_id", "score", "exact"],
        )

    return search


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    scale: int = SCALE,
    block_vectors: int = BLOCK_VECTORS,
    batch_queries: int = BATCH_QUERIES,
) -> DataFrame:
    """The ``k`` vectors with the highest inner product with each query.

    Reads ``vec_id`` and ``embedding``, and what ``is_query`` reads. Components
    are scaled and rounded down to whole numbers. Gives ``query_id``, ``rank`` from
    1, ``vec_id`` and ``score``. All rows but the query's own are candidates; equal
    scores go to the smaller vec_id.

    Vectors that are NULL or empty, have no vec_id, or hold a NULL or non-finite
    component take no part. A query is compared with vectors of its own length.
    Scores are exact whatever their size, and ranked so; one beyond a long is shown
    as its limit. Rows that repeat a vec_id are candidates each, and each of such
    queries asks and gets its own ranks. An empty table gives no rows.

    Both blocks of vectors and batches of queries have bounded size, and every
    pair of them is a group of its own. Vectors are repeated once per batch, each
    query once per block. The best of each block are merged in rows of ``k``.
    """
    usable = stored(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            finite("embedding").alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("is_query"),
        )
        .where("vec_id IS NOT NULL AND vector IS NOT NULL")
        .withColumns({"dims": F.size("vector"), "row": F.monotonically_increasing_id()})
    )
    sizes = usable.agg(F.count("*"), F.count_if("is_query")).first()
    blocks = max(1, round(sizes[0] / block_vectors))
    batches = max(1, -(-sizes[1] // batch_queries))
    # By row, so that repeated rows are spread too.
    mixed = F.xxhash64("row")

    def dealt(rows: DataFrame, own: str, number: int, other: str, others: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return rows.select(
            "row", "vec_id", "vector", "dims", F.pmod(mixed, F.lit(number)).cast("int").alias(own)
        ).withColumn(other, every)

    keys = ["dims", "block", "batch"]
    of_queries = dealt(usable.where("is_query"), "batch", batches, "block", blocks)
    of_vectors = dealt(usable, "block", blocks, "batch", batches)
    found = (
        of_queries.groupBy(*keys)
        .cogroup(of_vectors.groupBy(*keys))
        .applyInArrow(
            _search(k, scale), "row long, query_id long, vec_id long, score long, exact string"
        )
    )
    best_first = W.partitionBy("row").orderBy(F.desc("exact"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
WITH whole AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(
           embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS HUGEINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS (
  SELECT vec_id, own, len(v) AS dims, unnest(v) AS x, unnest(range(len(v))) AS dim FROM whole
), scored AS (
  SELECT q.own AS asking, q.vec_id AS query_id, p.own, p.vec_id,
         CAST(sum(q.x * p.x) AS BIGINT) AS score
  FROM parts q JOIN parts p ON q.dim = p.dim AND q.dims = p.dims AND q.own <> p.own
  WHERE q.vec_id % 100 = 0
  GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY asking ORDER BY score DESC, vec_id) AS nth
  FROM scored
)
SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, score FROM ranked WHERE nth <= 10"""
