import math
import random

from pyspark.sql import functions as F

from tallyloom.llm.topk import _sortable, top_k

SCHEMA = "vec_id long, embedding array<double>, rank int, score string"


def brute(rows, k):
    usable = [
        (i, [math.floor(x * 1024) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    wanted = []
    for at, (i, query) in enumerate(usable):
        if i % 3:
            continue
        scores = sorted(
            (-sum(a * b for a, b in zip(query, v)), j)
            for other, (j, v) in enumerate(usable)
            if other != at and len(v) == len(query)
        )
        limit = 2**63 - 1
        wanted += [(i, n + 1, j, max(min(-s, limit), -limit)) for n, (s, j) in enumerate(scores[:k])]
    return sorted(wanted)


def test_texts_sort_as_numbers():
    draw = random.Random(3)
    numbers = [0, 1, -1, 9, 10, -9, -10] + [draw.randint(-(10**n), 10**n) for n in range(80) for _ in range(4)]
    assert sorted(numbers, key=_sortable) == sorted(numbers)


def test_equals_brute_force(spark):
    draw = random.Random(9)
    rows = [(n, [round(draw.uniform(-1, 1), 1) for _ in range(4)]) for n in range(300)]
    rows += [(n, [0.5, -0.5, 0.0, 0.25]) for n in range(300, 340)]  # ties
    rows += [(340, [0.0] * 4), (341, [1e6, -1e6, 3e5, 1.0]), (342, [1.0, 2.0]), (345, [3.0, 1.0])]
    rows += [(6, [0.1] * 4), (348, None), (351, [1.0, None]), (354, [math.nan]), (357, [math.inf]), (360, [])]
    rows += [(None, [1.0] * 4), (9, [0.2] * 4), (9, [0.2] * 4), (363, [2.0**51, 0.0, -1.0, 0.5])]
    rows += [(n, [2.0**60 * n, -(2.0**60), 1.0, 3e20, 1e30]) for n in range(366, 390)]
    frame = spark.createDataFrame([(*row, 1, "x") for row in rows], SCHEMA)
    asks = F.col("vec_id") % 3 == 0
    for sizes in ({}, {"block_vectors": 50, "batch_queries": 7}):
        found = top_k(frame, asks, k=5, **sizes)
        assert sorted(tuple(row) for row in found.collect()) == brute(rows, 5)
    assert top_k(frame.limit(0), asks).isEmpty()
