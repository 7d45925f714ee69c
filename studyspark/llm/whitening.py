"""Whitening of embeddings: a distributed centred covariance, its leading eigenvectors, and a broadcast projection.

Sums are exact (integers), the covariance is centred before it is multiplied. Only matrices of the vectors' width
reach the driver, where the eigenvectors come from Householder tridiagonalisation, bisection on Sturm counts and
inverse iteration, with the vectors of close eigenvalues made orthogonal to each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from studyspark.session import written

#: Steps of a vector's entry, and what is added to make usual entries positive.
SCALE, SHIFT = 1024, 100_000
#: Entries whose scaled value a double no longer holds to the unit are treated like non-finite ones.
MOST = float(1 << 53)
#: Sums are kept in two halves of so many bits, so that no partial sum leaves 64 bits.
HALF = 26


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, vector) of the rows whose vector is complete: not null or empty, every entry a finite number below 2^53 /
    1024, and as long as the commonest such vector (of equally common lengths the greatest)."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector")) \
        .where(F.coalesce(F.forall("vector", lambda e: F.coalesce(F.abs(e * SCALE) < MOST, F.lit(False))), F.lit(False)) & (F.size("vector") > 0))
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("vector") == (length.length if length else 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The whole numbers of a batch of vectors, one row each."""
    flat = np.asarray(column.flatten(), np.float64).reshape(-1, width)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Totals:
    """Number of vectors and their sums, exact."""

    n: int
    sums: tuple[int, ...]

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def totals(rows: DataFrame) -> Totals:
    """Exact sums of all vectors: a row per task and dimension, then one per dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), len(batch.column(0)[0]))
                h, part = (x >> HALF).sum(axis=0), (x & ((1 << HALF) - 1)).sum(axis=0)
                n, high, low = n + len(x), h if high is None else high + h, part if low is None else low + part
        if n:
            width = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)], names=["d", "n", "high", "low"])

    parts = rows.select("vector").mapInArrow(run, "d long, n long, high long, low long")
    wide = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    found = sorted((r.d, r.n, (int(r.high) << HALF) + int(r.low)) for r in wide.collect())
    return Totals(found[0][1] if found else 0, tuple(s for _, _, s in found))


def covariance(rows: DataFrame, of: Totals) -> np.ndarray:
    """Covariance of all vectors, divisor n: products of centred vectors, summed per task, then over tasks."""
    width, mean = len(of.sums), of.mean()
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                centred = _matrix(batch.column(0), width) - mean
                total += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(upper[0] * width + upper[1]), pa.array(total[upper])], names=["cell", "value"])

    cells = rows.select("vector").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros((width, width))
    for r in cells.collect():                # width squared / 2 cells, whatever the number of vectors
        out[r.cell // width, r.cell % width] = out[r.cell % width, r.cell // width] = r.value / of.n
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Q of a symmetric matrix, by Householder reflections: a = Q T Q'."""
    a, n = np.array(a, np.float64), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        if not np.any(v[1:]):
            continue
        top = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= top
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k], a[k + 2:, k] = top, 0
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), q


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each value: negative terms of the Sturm sequence."""
    least = np.finfo(float).tiny
    term = diagonal[0] - at
    count = (term < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off):
        term = d - at - e * e / np.where(np.abs(term) < least, -least, term)
        count += term < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, falling: all intervals are halved together, down to the rounding error of the norm."""
    radius = np.abs(np.r_[0, off]) + np.abs(np.r_[off, 0])
    n, low, high = len(diagonal), np.full(k, (diagonal - radius).min()), np.full(k, (diagonal + radius).max())
    high = high + np.spacing(np.abs(high)) * 4
    wanted = n - np.arange(k)                # the first eigenvalue is the least bound with all n below it
    tolerance = np.finfo(float).eps / 4 * max(np.abs(low).max(), np.abs(high).max())
    while np.any(high - low > tolerance):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        below = sturm_counts(diagonal, off, middle) >= wanted
        high, low = np.where(below, middle, high), np.where(below, low, middle)
    return low + (high - low) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) x = b: elimination with row exchanges; pivots below ``least`` are lifted to it."""
    n = len(diagonal)
    u, u1, u2 = diagonal - shift, np.r_[off, 0.0], np.zeros(n)
    factor, swapped = np.zeros(n), np.zeros(n, bool)
    for i in range(n - 1):
        below, d, right = off[i], u[i + 1], u1[i + 1]
        if abs(below) > abs(u[i]):
            swapped[i] = True
            f = u[i] / below
            u[i], u1[i], u2[i], kept = below if abs(below) >= least else least, d, right, u1[i]
            u[i + 1], u1[i + 1] = kept - f * d, -f * right
        else:
            u[i] = u[i] if abs(u[i]) >= least else least
            f = below / u[i]
            u[i + 1] = d - f * u1[i]
        factor[i] = f
    if abs(u[-1]) < least:
        u[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for i in range(n - 1):
            if swapped[i]:
                b[i], b[i + 1] = b[i + 1], b[i]
            b[i + 1] -= factor[i] * b[i]
        for i in range(n - 1, -1, -1):
            b[i] -= (u1[i] * b[i + 1] if i + 1 < n else 0) + (u2[i] * b[i + 2] if i + 2 < n else 0)
            b[i] /= u[i]
        return b
    return solve


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors in columns, by inverse iteration. Eigenvalues within a thousandth of the norm of their
    neighbour form a cluster, whose vectors are made orthogonal at every step."""
    n = len(diagonal)
    norm = max(float(np.abs(diagonal).max()), float(np.abs(off).max()) if len(off) else 0.0)
    if norm == 0:
        return np.eye(n)[:, :len(values)]
    diagonal, off, values, norm = diagonal / norm, off / norm, values / norm, 1.0
    random, out, first = np.random.default_rng(7), np.zeros((n, len(values))), 0
    shift = np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first = k
        shift = min(value, shift - 8 * np.finfo(float).eps * norm) if k > first else value   # equal values get shifts of their own
        solve, x = _solver(diagonal, off, shift, np.finfo(float).eps * norm * 0.5), random.standard_normal(n)
        for _ in range(6):
            x = solve(x / np.linalg.norm(x))
            for _ in range(2):
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors in columns. The sign of a
    vector makes its entry of greatest size positive."""
    diagonal, off, q = tridiagonal(matrix)
    values = leading_values(diagonal, off, min(k, len(matrix)))
    vectors = q @ leading_vectors(diagonal, off, values)
    vectors /= np.linalg.norm(vectors, axis=0)
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    return values, vectors * np.where(top < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """A fitted projection: ``vectors`` in columns with their eigenvalues; ``used`` says which of these differ from 0."""

    totals: Totals
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def used(self) -> np.ndarray:
        return self.values > self.trace * len(self.totals.sums) * np.finfo(float).eps * 4

    def apply(self, rows: DataFrame) -> DataFrame:
        """(id, deviation, whitened) per row of ``usable``: the exact squared distance from the sums, null where it exceeds
        64 bits, and an entry per component, null where the component has no variance."""
        of, n, width = self.totals, self.totals.n, len(self.totals.sums)
        mean, used = of.mean(), self.used
        basis = self.vectors[:, used] / np.sqrt(self.values[used])
        schema = StructType([rows.schema["id"], StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), width) if batch.num_rows else np.zeros((0, width), np.int64)
                out = np.full((len(x), len(used)), np.nan)
                out[:, used] = (x - mean) @ basis
                flat = pa.array(out.ravel(), mask=np.tile(~used, len(x)))
                yield pa.RecordBatch.from_arrays([batch.column(0), deviations(x, of), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(used), flat)], names=schema.names)

        return rows.select("id", "vector").mapInArrow(run, schema)


def deviations(x: np.ndarray, of: Totals) -> pa.Array:
    """Sum over dimensions of (n * x - sum)^2, exact; null where it exceeds 64 bits."""
    reach = (of.n * int(np.abs(x).max()) + max(map(abs, of.sums))) if x.size else 0
    if reach < 1 << 62:
        off = of.n * x - np.array(of.sums, np.int64)
        if not x.size or x.shape[1] * int(np.abs(off).max()) ** 2 < 1 << 63:
            return pa.array((off * off).sum(axis=1), pa.int64())
    exact = [sum((of.n * v - s) ** 2 for v, s in zip(row, of.sums)) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """A whitening fitted on all rows of ``usable``; none if there is no row."""
    of = totals(rows)
    if not of.n:
        return None
    matrix = covariance(rows, of)
    values, vectors = leading_components(matrix, components)
    return Whitening(of, values, vectors, float(np.trace(matrix)))


def identity_error(whitened: DataFrame, used: list[int]) -> float | None:
    """Greatest absolute entry of the covariance of the whitened rows minus the identity, over components that have variance."""
    pairs = [(i, j) for i in used for j in used if i <= j]
    if not pairs:
        return None
    entry = [F.col("whitened")[i] for i in range(max(used) + 1)]
    errors = [F.abs(F.covar_pop(entry[i], entry[j]) - (1.0 if i == j else 0.0)) for i, j in pairs]
    return whitened.agg(F.array_max(F.array(*errors)).alias("error")).first().error


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 8) -> DataFrame:
    """One row per usable vector (see ``usable``) and component: id, component (from 1, by falling eigenvalue), n,
    deviation, whitened, explained (share of the total variance), identity_error.

    Entries become whole numbers, floor(1024 * entry) + 100000, and all else is computed on these. Null, empty and
    incomplete vectors are dropped; repeated rows and ids count and return as often as they come; other columns are
    ignored; an empty table gives no row. With fewer dimensions than ``components`` there are as many components as dimensions.
    A component without variance has whitened null; without any variance explained and identity_error are null too.
    """
    id_type = vectors.schema[id_column].dataType.simpleString()
    result = f"`{id_column}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors, id_column, vector_column)
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], result)
    whitened = written(model.apply(rows), "whitened")
    error = identity_error(whitened, np.flatnonzero(model.used).tolist())
    explained = F.array(*[F.lit(float(v) / model.trace if model.trace > 0 else None).cast("double") for v in model.values])
    return whitened.select(F.col("id").alias(id_column), "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        id_column, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.totals.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
