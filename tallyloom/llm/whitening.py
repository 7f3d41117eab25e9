"""Whitening of embeddings by their leading components (operator 12).

The covariance is never formed. Jacobi-Davidson asks only for its product with a
few vectors at a time: a Spark job in which every task centres its rows, multiplies
them twice and adds up a small matrix. The driver holds a subspace and nothing that
grows with the rows. Every round solves the projected correction equations of all
components that are not yet found, side by side, by a few steps of MINRES, widens
the subspace with the answers and takes its Ritz vectors; a component is locked as
soon as its residual is as small as double precision allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import read_table, stored

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Vectors in the subspace, as multiples of the components, at most and after a restart.
WIDEST, NARROW = 8, 3
INNER_STEPS = 5
#: Inner steps end once all residuals fell to this part of what they were.
INNER_PART = 0.02
ROUNDS = 200
#: A residual of so many roundings of the largest eigenvalue is as small as it gets.
ROUNDINGS = 32
#: An eigenvalue below this part of the trace is that of no direction of the data.
NOTHING = 1e-13
#: Partial sums that are added up on the driver; more are first added in Spark.
PARTS = 64
_EPS = float(np.finfo(np.float64).eps)
_LONG = 2**63

Product = Callable[[np.ndarray], np.ndarray]


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """The part of ``new`` outside of the bases, as orthonormal columns."""
    known = np.concatenate(bases, axis=1)
    found: list[np.ndarray] = []
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        whole = np.column_stack([known, *found])
        for _ in range(3):  # until nothing of the others is left in it
            column = column - whole @ (whole.T @ column)
        size = np.linalg.norm(column)
        if size > 1e-8:
            column = column / size
            column = column - whole @ (whole.T @ column)
            found.append(column / np.linalg.norm(column))
    return np.column_stack(found) if found else np.zeros((len(new), 0))


def minres(
    product: Product, targets: np.ndarray, shifts: np.ndarray, known: np.ndarray, steps: int, part: float
) -> np.ndarray:
    """Some steps of MINRES for (P (V - shift) P) x = target, for each column.

    P takes out the orthonormal columns ``known``. All columns share the products;
    one that is solved stays as it is.
    """

    def projected(x: np.ndarray) -> np.ndarray:
        return x - known @ (known.T @ x)

    x = np.zeros_like(targets)
    v = projected(targets)
    beta = np.linalg.norm(v, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v = v / start
    before = np.zeros_like(v)
    w, w_before = np.zeros_like(v), np.zeros_like(v)
    left = beta.copy()  # what the next step has to explain
    active = beta > 0
    beta_now = np.zeros(len(beta))
    c, s = -np.ones(len(beta)), np.zeros(len(beta))
    delta_bar, epsilon = np.zeros(len(beta)), np.zeros(len(beta))
    for _ in range(steps):
        if not active.any():
            break
        y = projected(product(v) - v * shifts)
        alpha = np.sum(v * y, axis=0)
        y = projected(y - v * alpha - before * beta_now)
        beta_next = np.linalg.norm(y, axis=0)
        # The next plane rotation of the tridiagonal matrix of this Krylov space.
        delta = c * delta_bar + s * alpha
        gamma_bar = s * delta_bar - c * alpha
        epsilon_now, epsilon = epsilon, s * beta_next
        delta_bar = -c * beta_next
        gamma = np.hypot(gamma_bar, beta_next)
        safe = np.where(gamma > 0, gamma, 1.0)
        c, s = gamma_bar / safe, beta_next / safe
        w, w_before = (v - w_before * epsilon_now - w * delta) / safe, w
        step = np.where(active & (gamma > 0), c * left, 0.0)
        x = x + w * step
        left = s * left
        before, beta_now = v, beta_next
        v = y / np.where(beta_next > 0, beta_next, 1.0)
        active &= (np.abs(left) > part * start) & (beta_next > _EPS * np.abs(shifts))
    return x


def jacobi_davidson(product: Product, dim: int, wanted: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their vectors.

    The matrix has no negative eigenvalue and is known by its products alone. Ends
    when the residual of every component is within some roundings of the largest
    eigenvalue; raises ``ArithmeticError`` if that does not come about.
    """
    wanted = min(wanted, dim)
    locked = np.zeros((dim, 0))
    start = np.random.default_rng(seed).standard_normal((dim, min(dim, wanted + 4)))
    basis = _orthonormal(start, locked)
    image = product(basis)
    best, stuck = np.inf, 0
    for _ in range(ROUNDS):
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        open_ = wanted - locked.shape[1]
        ritz, ritz_image = basis @ turns, image @ turns
        vectors, values = ritz[:, :open_], values[:open_]
        residuals = ritz_image[:, :open_] - vectors * values
        residuals -= locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        if locked.shape[1] == 0:
            largest = max(values[0], 0.0)
        enough = ROUNDINGS * _EPS * largest
        # Sums of many rows may be rounded a little worse: no progress is an end too.
        rest = float(sizes.max())
        stuck = 0 if rest < 0.5 * best else stuck + 1
        best = min(best, rest)
        if stuck >= 4 and rest <= 1e4 * enough:
            enough = max(enough, 2 * rest)
        whole = locked.shape[1] + basis.shape[1] == dim  # nothing is left to add
        done = sizes <= enough
        n_done = len(done) if whole or done.all() else int(np.argmin(done))
        if n_done == open_:
            locked = np.concatenate([locked, vectors], axis=1)
            break
        if n_done:
            # Locked in order only, so that none that is larger is passed over.
            locked = np.concatenate([locked, vectors[:, :n_done]], axis=1)
            basis, image = ritz[:, n_done:], ritz_image[:, n_done:]
            vectors, values, residuals = vectors[:, n_done:], values[n_done:], residuals[:, n_done:]
            best, stuck = np.inf, 0
        elif basis.shape[1] + len(values) > WIDEST * wanted:
            basis, image = ritz[:, : NARROW * wanted], ritz_image[:, : NARROW * wanted]
        known = _orthonormal(vectors, locked)
        known = np.concatenate([locked, known], axis=1)
        answers = minres(product, -residuals, values, known, INNER_STEPS, INNER_PART)
        more = _orthonormal(answers, locked, basis)
        if not more.shape[1]:  # solved by nothing new: go on from another direction
            more = _orthonormal(
                np.random.default_rng(seed + basis.shape[1]).standard_normal((dim, 2)), locked, basis
            )
        basis = np.concatenate([basis, more], axis=1)
        image = np.concatenate([image, product(more)], axis=1)
    else:
        raise ArithmeticError("the components did not settle")
    # Ritz vectors once more, of all that was found together.
    locked, _ = np.linalg.qr(locked)
    small = locked.T @ product(locked)
    values, turns = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], locked @ turns[:, ::-1]


@dataclass(frozen=True)
class Centre:
    """Number of rows and exact sums; the mean is ``floor + rest / n``."""

    n: int
    sums: tuple[int, ...]

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [divmod(one, self.n) for one in self.sums]
        return (
            np.array([floor for floor, _ in parts], np.int64),
            np.array([float(Fraction(rest, self.n)) for _, rest in parts]),
        )

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean; of each entry only the last bit is rounded."""
        floor, rest = self.split()
        return _less(x, floor).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S) squared, exact; None where a long can't hold it."""
        floor, _ = self.split()
        rest = [one % self.n for one in self.sums]
        off = _less(x, floor)
        # (n a - r)^2 = n^2 a^2 - 2 n a r + r^2, where a and r are small.
        widest = int(np.abs(off).max(initial=0))
        if off.dtype == object or x.shape[1] * widest * max(widest, self.n) >= _LONG:
            off, rests = off.astype(object), np.array(rest, object)
        else:
            rests = np.array(rest, np.int64)
        squares, crossed = (off * off).sum(axis=1), (off * rests).sum(axis=1)
        last = sum(one * one for one in rest)
        found = (
            self.n * self.n * int(a) - 2 * self.n * int(b) + last for a, b in zip(squares, crossed)
        )
        return [one if one < _LONG else None for one in found]


def _less(x: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """x - floor, exact: as Python numbers where longs would overflow."""
    if x.size and max(abs(int(x.max())), abs(int(x.min()))) >= 2**61:
        return x.astype(object) - floor.astype(object)
    return x - floor


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``x``, floor(1024 c) + 100000 of each entry, of the rows that have it.

    Left out are rows whose vector is NULL or empty, holds a NULL or an entry that
    is not finite, or one so large that its x is no long, and vectors of another
    length than the most frequent one (of lengths equally frequent, the longest).
    """
    # NaN is more than any other number.
    fits = f"""coalesce(forall(embedding, c ->
        c IS NOT NULL AND abs({SCALE}D * double(c)) <= {float(_LONG - 10 * OFFSET)!r}D), false)"""
    x = f"transform(embedding, c -> floor({SCALE}D * double(c)) + {OFFSET}L)"
    rows = stored(
        embeddings.where(fits)
        .where("size(embedding) > 0")
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(x).alias("x"))
    )
    sizes = rows.groupBy(F.size("x").alias("size")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return rows if first is None else rows.where(F.size("x") == first["size"])


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def centre(rows: DataFrame) -> Centre:
    """Of all rows; sums are decimals, so they are exact in any order."""
    entries = rows.select(F.posexplode("x").alias("at", "value"))
    sums = (
        entries.groupBy("at")
        .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))
        .collect()  # a row for each dimension
    )
    found = sorted((row.at, row.n, int(row.total)) for row in sums)
    return Centre(found[0][1] if found else 0, tuple(total for *_, total in found))


def _summed(rows: DataFrame, one_batch: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of a small array over all rows: first within each task, then across them."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += one_batch(_matrix(batch.column(0))).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = rows.select("x").mapInArrow(of_task, "part binary")
    if rows.rdd.getNumPartitions() > PARTS:
        parts = parts.repartition(PARTS).mapInArrow(of_parts, "part binary")
    return np.sum([np.frombuffer(row.part) for row in parts.collect()], axis=0)


@dataclass(frozen=True)
class Whitening:
    """Fitted components: eigenvalues, unit vectors in columns, and the trace."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def applied(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Leading components of the rows' covariance; None if there are no rows.

    ``rows`` are those of ``whole_numbers``, stored: they are read once for each
    product. Directions without variance are no components, so rows that are all
    equal have none.
    """
    mean = centre(rows)
    if not mean.n:
        return None
    dim = len(mean.sums)
    trace = float(_summed(rows, lambda x: np.array([np.square(mean.centred(x)).sum()]), 1)[0]) / mean.n
    if not trace > 0:
        return Whitening(mean, np.zeros(0), np.zeros((dim, 0)), trace)

    def product(columns: np.ndarray) -> np.ndarray:
        def of_batch(x: np.ndarray) -> np.ndarray:
            centred = mean.centred(x)
            return centred.T @ (centred @ columns)

        return _summed(rows, of_batch, columns.size).reshape(columns.shape) / mean.n

    values, vectors = jacobi_davidson(product, dim, components)
    some = values > NOTHING * trace
    return Whitening(mean, values[some], vectors[:, some], trace)


def identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest entry of the whitened rows' covariance less the identity."""
    k, n = len(fitted.values), fitted.centre.n
    if not k:
        return 0.0
    means = _summed(rows, lambda x: fitted.applied(x).sum(axis=0), k) / n

    def of_batch(x: np.ndarray) -> np.ndarray:
        centred = fitted.applied(x) - means
        return centred.T @ centred

    covariance = _summed(rows, of_batch, k * k).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: its whitened value, and what was fitted.

    Columns: vec_id, component (from 1, by falling eigenvalue), n, deviation
    (squared distance of n x from the sums, exact; NULL where a long can't hold it),
    whitened, explained (the component's part of the trace), identity_error (one
    value for all). Reads ``vec_id`` and ``embedding``, nothing else.

    ``whole_numbers`` tells which rows take part. Repeated rows and NULL vec_ids
    count and come back as they are. Of equal eigenvalues any basis may be given.
    Fewer components than asked for come from fewer dimensions or directions; no
    rows, or rows without variance, give no row.
    """
    rows = stored(whole_numbers(embeddings))
    fitted = fit(rows, components)
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    if fitted is None or not len(fitted.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, fitted)
    k, n = len(fitted.values), fitted.centre.n
    explained = fitted.values / fitted.trace

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            if not batch.num_rows:
                continue
            each = pa.array(np.repeat(np.arange(len(x)), k))
            size = len(x) * k
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, n)),
                pa.array(fitted.centre.deviations(x), pa.int64()).take(each),
                pa.array(fitted.applied(x).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(size, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in schema.split(", ")])

    return rows.mapInArrow(of_rows, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
