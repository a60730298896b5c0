"""Vector helpers of the embedding operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import hash_share

# Vectors that centres are fitted to, about; a bound on what the driver sees.
SAMPLE_ROWS = 16_384


def all_finite(vector: Column) -> Column:
    """True for a vector without null, NaN and infinite components; null counts as false."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, lambda x: number(x.cast("double"))), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sampled(vectors: DataFrame, key: str, vector: str, rows: int, bound: int = SAMPLE_ROWS) -> np.ndarray:
    """About ``bound`` of ``rows`` vectors, chosen by a hash of the key, in the order of the key."""
    chosen = vectors.where(hash_share(F.col(key), min(1.0, bound / max(rows, 1)))).select(key, vector)
    found = sorted((row[key], row[vector]) for row in chosen.collect())
    return np.array([v for _, v in found], dtype=np.float64)


def centres(points: np.ndarray, count: int, spherical: bool, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means centres of the points; of unit length and by cosine if ``spherical``."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    count = max(1, min(count, len(distinct)))
    found = distinct[rng.choice(len(distinct), count, replace=False)]
    for _ in range(rounds):
        near = (points @ found.T - (0 if spherical else (found**2).sum(axis=1) / 2)).argmax(axis=1)
        for k in np.unique(near):
            found[k] = points[near == k].mean(axis=0)
        if spherical:
            found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return found


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns, across batch borders."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        if not batch.num_rows:
            continue
        changes = np.any([np.diff(c) != 0 for c in columns], axis=0)
        starts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for start, stop in zip(starts, starts[1:]):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)
