"""Whitening against dense linear algebra and exact integers."""

import math

import numpy as np
import pytest

from conftest import SF_DIR
from tallyloom.llm.whitening import (
    Centre,
    jacobi_davidson,
    minres,
    op12_whitening,
    whiten,
)

SCHEMA = "vec_id long, embedding array<float>, x string, at int"


def spectrum(draw, values):
    turned, _ = np.linalg.qr(draw.standard_normal((len(values), len(values))))
    return turned * values @ turned.T


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(9, 1, 40),
        1 / np.arange(1, 301) ** 2,
        np.concatenate([[5, 4, 3], np.linspace(1.02, 1, 97)]),
        np.concatenate([[2.0, 2.0, 2.0], np.linspace(1, 0, 60)]),
        np.concatenate([np.ones(3), np.zeros(50)]),
        np.array([3.0]),
        np.array([3.0, 1.0]),
    ],
    ids=["even", "falling", "crowded", "equal", "three", "one", "two"],
)
def test_largest_eigenvalues(values):
    matrix = spectrum(np.random.default_rng(3), values)
    wanted = min(8, len(values))
    found, vectors = jacobi_davidson(lambda x: matrix @ x, len(values), 8)
    assert np.abs(found - np.sort(values)[::-1][:wanted]).max() < 1e-13 * values.max() * 10
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-13
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 1e-13 * values.max() * 10


def test_minres_solves_the_projected_equations():
    draw = np.random.default_rng(4)
    matrix = spectrum(draw, np.linspace(1, 2, 30))
    known, _ = np.linalg.qr(draw.standard_normal((30, 2)))
    taken = np.eye(30) - known @ known.T
    targets = taken @ draw.standard_normal((30, 3))
    shifts = np.array([0.0, 1.5, 5.0])
    found = minres(lambda x: matrix @ x, targets, shifts, known, 60, 1e-12)
    for x, target, shift in zip(found.T, targets.T, shifts):
        assert np.linalg.norm(taken @ (matrix - shift * np.eye(30)) @ taken @ x - target) < 1e-9


def exact_rows(vectors):
    x = {n: [math.floor(1024 * c) + 100000 for c in v] for n, v in vectors.items()}
    n, sums = len(x), [sum(column) for column in zip(*x.values())]
    deviation = {k: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for k, v in x.items()}
    centred = {k: np.array([(n * a - s) / n for a, s in zip(v, sums)]) for k, v in x.items()}
    whole = np.array(list(centred.values()))
    values, turned = np.linalg.eigh(whole.T @ whole / n)
    return n, deviation, centred, values[::-1], turned[:, ::-1]


def checked(frame, vectors):
    n, deviation, centred, values, turned = exact_rows(vectors)
    k = min(8, int((values > 1e-12 * values.sum()).sum()))
    rows = frame.collect()
    assert len(rows) == k * len(vectors)
    found = {(row.vec_id, row.component): row for row in rows}
    assert set(found) == {(v, c) for v in vectors for c in range(1, k + 1)}
    for c in range(k):
        wanted = {v: one @ turned[:, c] / math.sqrt(values[c]) for v, one in centred.items()}
        first = max(wanted, key=lambda v: abs(wanted[v]))
        sign = math.copysign(1, wanted[first] * found[first, c + 1].whitened)
        gap = min(abs(np.delete(values, c) - values[c]), default=values[c]) / values[0]
        for v in vectors:
            row = found[v, c + 1]
            assert (row.n, row.deviation) == (n, deviation[v])
            assert abs(row.whitened - sign * wanted[v]) < 1e-12 / gap
            assert row.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
            assert 0 <= row.identity_error < 1e-10


def test_query(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    vectors = {row.vec_id: [float(c) for c in row.embedding] for row in table}
    checked(op12_whitening(spark, SF_DIR), vectors)


def test_awkward_rows(spark):
    draw = np.random.default_rng(5)
    good = {n: draw.standard_normal(3).astype("f4").tolist() for n in range(30)}
    good |= {40: [3e3, -2e3, 1e3], 41: good[1], 42: good[1]}
    bad = {50: None, 51: [1.0, None, 2.0], 52: [1.0, math.nan, 2.0], 53: [math.inf, 0.0, 0.0],
           54: [], 55: [1.0, 2.0], 56: [1e30, 0.0, 0.0]}
    rows = [(n, v, "x", 1) for n, v in {**good, **bad}.items()]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    checked(whiten(frame), good)
    assert whiten(frame.limit(0)).isEmpty()
    same = spark.createDataFrame([(n, [1.0, 2.0], "x", 1) for n in (1, 1, None)], SCHEMA)
    assert whiten(same).isEmpty()
    line = spark.createDataFrame([(n, [float(n), 2.0 * n], "x", 1) for n in range(9)], SCHEMA)
    assert {row.component for row in whiten(line).collect()} == {1}
    twice = spark.createDataFrame([(None, [1.0], "x", 1), (None, [1.0], "x", 1), (3, [2.0], "x", 1)], SCHEMA)
    assert sorted((row.vec_id or 0, row.n) for row in whiten(twice).collect()) == [(0, 3), (0, 3), (3, 3)]


def test_exact_deviations_of_any_size():
    x = np.array([[2**60, 5], [-(2**60), 7], [3, 9]])
    centre = Centre(3, tuple(int(c) for c in x.astype(object).sum(axis=0)))
    assert centre.deviations(x) == [None, None, 72]
    x = np.array([[4, 5], [6, 7], [3, 9]]) + 10**9
    sums = x.sum(axis=0)
    wanted = [int(one) for one in np.square(3 * x - sums).sum(axis=1)]
    assert Centre(3, tuple(map(int, sums))).deviations(x) == wanted
