"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.vectors import all_finite

# Components that are returned.
COMPONENTS = 8
# x = floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
# Entries x beyond this size are set to it, so that sums of differences fit 64 bits.
LARGEST = 1 << 61
# Remaining scatter, relative to the first pivot, at which the factor ends.
RANK_TOLERANCE = 1e-13
_MASK = (1 << 32) - 1


@dataclass
class Fit:
    """What whitening needs to know of the vectors of one length.

    ``whole`` and ``rest`` are the mean: S = n * whole + rest with 0 <= rest < n, exactly.
    ``directions`` has a unit eigenvector per column, ``values`` the eigenvalues by falling size,
    ``trace`` is the sum of all eigenvalues.
    """

    n: int
    whole: np.ndarray
    rest: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean; the integer part of the difference is exact."""
        return (x - self.whole).astype(np.float64) - self.rest.astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.directions / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over all dimensions of (n*x - S)^2, None where it passes 64 bits."""
        away, rest = x - self.whole, self.rest
        if (float(np.abs(away).max(initial=0)) + 1) * max(float(np.abs(away).max(initial=0)), self.n) * x.shape[1] >= 2.0**62:
            away, rest = away.astype(object), rest.astype(object)
        # (n*away - rest)^2, summed over the dimensions before the large factors enter.
        squares, mixed = (away**2).sum(axis=1).astype(object), (away * rest).sum(axis=1).astype(object)
        exact = self.n**2 * squares - 2 * self.n * mixed + int((self.rest.astype(object) ** 2).sum())
        return [value if value < 1 << 63 else None for value in exact.tolist()]


def pivoted_cholesky(scatter: np.ndarray, tolerance: float = RANK_TOLERANCE) -> np.ndarray:
    """Factor L, a column per rank, with L @ L.T equal to ``scatter``.

    Rows come in the order of the matrix; in the order of the pivots L is lower triangular. Each
    step takes the largest remaining diagonal entry, so the columns fall in size and the
    factor ends where nothing but rounding is left.
    """
    size = len(scatter)
    factor = np.zeros((size, size))
    left = scatter.diagonal().astype(np.float64).copy()
    open_rows = np.ones(size, bool)
    limit = tolerance * left.max(initial=0.0)
    for k in range(size):
        pivot = int(np.argmax(np.where(open_rows, left, -np.inf)))
        if not left[pivot] > limit:
            return factor[:, :k]
        open_rows[pivot] = False
        root = np.sqrt(left[pivot])
        column = (scatter[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / root
        factor[open_rows, k] = column[open_rows]
        factor[pivot, k] = root
        left[open_rows] -= factor[open_rows, k] ** 2
    return factor


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) and eigenvalues of factor @ factor.T, by falling eigenvalue.

    Pairs of columns are rotated until all are orthogonal. The products that the rotations stand
    for are never formed, so small eigenvalues keep their relative precision. A sweep meets every
    pair once: the columns sit around a table, opposite ones are rotated together, then all but
    the first move on by one seat.
    """
    columns = factor.copy()
    rank = columns.shape[1]
    if rank > 1:
        seats = np.arange(rank + rank % 2)
        for _ in range(sweeps):
            turned = False
            for _ in range(len(seats) - 1):
                a, b = seats[:len(seats) // 2], seats[len(seats) // 2:][::-1]
                inside = (a < rank) & (b < rank)
                turned |= _rotate(columns, a[inside], b[inside])
                seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
            if not turned:
                break
    norms = np.linalg.norm(columns, axis=0)
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return columns[:, order] / norms[order], norms[order] ** 2


def _rotate(columns: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Make the columns ``a`` orthogonal to their partners ``b``; False if all were already."""
    left, right = columns[:, a], columns[:, b]
    x, y = (left**2).sum(axis=0), (right**2).sum(axis=0)
    both = (left * right).sum(axis=0)
    slanted = np.abs(both) > 1e-15 * np.sqrt(x * y)
    if not slanted.any():
        return False
    a, b, left, right = a[slanted], b[slanted], left[:, slanted], right[:, slanted]
    half = (y[slanted] - x[slanted]) / (2 * both[slanted])
    tangent = np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(1.0, half))
    cosine = 1 / np.hypot(1.0, tangent)
    columns[:, a] = cosine * (left - tangent * right)
    columns[:, b] = cosine * (right + tangent * left)
    return True


def _integers(vectors: pa.Array, width: int) -> np.ndarray:
    """The x-vectors of equally long lists of doubles; entries no double integer can hold end at LARGEST."""
    entries = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)
    with np.errstate(over="ignore"):
        whole = np.floor(SCALE * entries)
    return np.clip(whole, -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _by_length(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Length, rows and x-vectors of the vectors of each length, batch by batch."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
        for width in np.unique(lengths):
            rows = batch.filter(pa.array(lengths == width))
            yield int(width), rows, _integers(rows.column(column), int(width))


def _sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length the number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for width, _, x in _by_length(batches, "vector"):
            part = found.setdefault(width, [0, np.zeros(width, object), np.zeros(width, object)])
            part[0] += len(x)
            part[1] += (x >> 32).sum(axis=0).astype(object)
            part[2] += (x & _MASK).sum(axis=0).astype(object)
        for width, (n, high, low) in found.items():
            yield pa.RecordBatch.from_pydict({
                "width": [width] * width, "i": list(range(width)), "n": [n] * width,
                "high": [int(v) for v in high], "low": [int(v) for v in low],
            }, schema=pa.schema([(c, pa.int32() if c in ("width", "i") else pa.int64()) for c in ("width", "i", "n", "high", "low")]))

    parts = vectors.select("vector").mapInArrow(run, "width int, i int, n long, high long, low long")
    total = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    out: dict[int, tuple[int, list[int]]] = {}
    for row in parts.groupBy("width", "i").agg(F.sum("n").alias("n"), total("high"), total("low")).orderBy("width", "i").collect():
        out.setdefault(row["width"], (row["n"], []))[1].append((int(row["high"]) << 32) + int(row["low"]))
    return out


def _products(vectors: DataFrame, fits: dict[int, Fit], rows_of) -> dict[int, np.ndarray]:
    """For each length the sum over its vectors of the outer products of ``rows_of(fit, x)``.

    Every task adds up its own rows and sends one number per pair of dimensions; pairs are summed
    by key.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for width, _, x in _by_length(batches, "vector"):
            if (fit := shared.value.get(width)) is not None:
                rows = rows_of(fit, x)
                found[width] = found.get(width, 0) + rows.T @ rows
        for width, matrix in found.items():
            i, j = np.triu_indices(len(matrix))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(i), width), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                pa.array(matrix[i, j], pa.float64()),
            ], names=["width", "i", "j", "value"])

    parts = vectors.select("vector").mapInArrow(run, "width int, i int, j int, value double")
    found: dict[int, np.ndarray] = {}
    for row in parts.groupBy("width", "i", "j").agg(F.sum("value").alias("value")).collect():
        size = len(rows_of(fits[row["width"]], np.zeros((1, row["width"]), np.int64))[0])
        matrix = found.setdefault(row["width"], np.zeros((size, size)))
        matrix[row["i"], row["j"]] = matrix[row["j"], row["i"]] = row["value"]
    return found


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Whitening of the vectors of each length in column ``vector``, a list of finite doubles.

    The driver receives one sum per dimension and one product per pair of dimensions, whatever
    the number of vectors. Components without variance are left out.
    """
    fits = {}
    for width, (n, sums) in _sums(vectors).items():
        whole = np.array([total // n for total in sums], np.int64)
        rest = np.array([total % n for total in sums], np.int64)
        fits[width] = Fit(n, whole, rest, np.zeros((width, 0)), np.zeros(0), 0.0)
    for width, scatter in _products(vectors, fits, Fit.centred).items():
        one = fits[width]
        directions, values = jacobi(pivoted_cholesky(scatter))
        one.trace = float(scatter.trace()) / one.n
        one.directions, one.values = directions[:, :components], values[:components] / one.n
    kept = {width: one for width, one in fits.items() if len(one.values)}
    for width, products in _products(vectors, kept, Fit.whitened).items():
        kept[width].identity_error = float(np.abs(products / kept[width].n - np.eye(len(products))).max())
    return fits


def usable(source: DataFrame, key: str, vector: str) -> DataFrame:
    """Columns ``key`` and ``vector`` of the rows whose vector has entries, all finite."""
    known = source.select(F.col(key).alias("key"), F.col(vector).alias("raw")).where(all_finite(F.col("raw")) & (F.size("raw") > 0))
    return known.select("key", F.transform("raw", lambda entry: entry.cast("double")).alias("vector"))


def whiten(source: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null, NaN or infinite entries are left out; null
    and repeated keys are rows like others. Vectors of different lengths are tables of their own,
    each with its own n. A component without variance (as in constant dimensions, or with fewer
    vectors than components) can't be brought to variance one and has no rows. ``deviation`` is
    null where it passes 64 bits. Entries are read as x = floor(1024 * entry) + 100000, held at
    2^61. Nothing but the sums is shuffled; vectors are read once per pass and not stored.
    """
    vectors = usable(source, key, vector)
    shared = vectors.sparkSession.sparkContext.broadcast(fit(vectors, components))
    schema = vectors.select(
        "key", F.lit(0).alias("component"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("deviation"),
        *[F.lit(0.0).alias(name) for name in ("whitened", "explained", "identity_error")],
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, rows, x in _by_length(batches, "vector"):
            # A vector that no fit has seen can't occur: both passes read the same rows.
            one = shared.value[width]
            made, count = one.whitened(x), len(one.values)
            deviations = pa.array(one.deviations(x), pa.int64())
            at = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays([
                rows.column("key").take(pa.array(at)), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                pa.array(np.full(len(at), one.n), pa.int64()), deviations.take(pa.array(at)),
                pa.array(made.ravel(), pa.float64()), pa.array(np.tile(one.values / one.trace, len(x)), pa.float64()),
                pa.array(np.full(len(at), one.identity_error), pa.float64()),
            ], names=schema.names)

    return vectors.mapInArrow(run, schema)


def whitened_vectors(source: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The digest of ``whiten`` under the name of the key column."""
    found = whiten(source, key, vector)
    return found.select(F.col("key").alias(key), *[name for name in found.columns if name != "key"])
