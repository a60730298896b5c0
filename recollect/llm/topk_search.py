"""Exact top-k by inner product of integer vectors: a Voronoi kNN join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import small_side
from recollect.llm.vectors import all_finite, centres, groups, matrix, sampled
from recollect.operators.staging import scope, stage

# Queries of one group aimed at, the least and most groups, and data vectors of one block.
GROUP_QUERIES = 4096
LEAST_GROUPS, MOST_GROUPS = 8, 512
BLOCK_ROWS = 16_384
PRODUCT_ROWS = 128
# Products and sums of doubles are exact integers up to here.
_EXACT = 1 << 53


def _lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component that gives all of them the squared length ``top``.

    For a query with 0 there, squared distance is |q|^2 + top - 2 q.x: the nearest vector is the
    one with the largest inner product.
    """
    rest = np.sqrt(np.maximum(0.0, top - (vectors**2).sum(axis=1)))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squared, 0.0))


def _summaries(data: DataFrame, queries: DataFrame, pivots: np.ndarray, top: float, k: int) -> dict[int, tuple[float, float]]:
    """For each query group its radius and an upper bound of every query's k-th distance.

    Both sides send a few rows per pivot and batch: the radius of the queries, and for every pivot
    the k + 1 keys with the smallest distances of data (a query's may be one of them). A query is at
    most the radius from its pivot, so the k + 1 keys nearest to the pivot are at most radius +
    distance away; the k-th other one is among them.
    """
    shared = data.sparkSession.sparkContext.broadcast((pivots, top))

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, _ = shared.value
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column(1))
                d = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), p)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(d.min(axis=1))], names=["part", "far"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, most = shared.value
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                by_key = np.argsort(ids, kind="stable")
                keys, starts = np.unique(ids[by_key], return_index=True)
                d = np.minimum.reduceat(_distances(_lifted(matrix(batch.column(1)), most), p)[by_key], starts)
                first = np.argsort(d, axis=0, kind="stable")[:k + 1]
                part = np.tile(np.arange(len(p)), len(first))
                far = np.take_along_axis(d, first, axis=0).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys[first.ravel()]), pa.array(far)], names=["part", "id", "far"])

    radius = {r["part"]: r["far"] for r in queries.mapInArrow(radii, "part int, far double").groupBy("part").agg(F.max("far").alias("far")).collect()}
    order = Window.partitionBy("part").orderBy("far")
    nearest_keys = data.mapInArrow(nearest, "part int, id long, far double").groupBy("part", "id").agg(F.min("far").alias("far"))
    near = nearest_keys.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    bound = {r["part"]: (r["n"], r["far"]) for r in near.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    return {
        part: (far, far + bound[part][1] if part in bound and bound[part][0] > k else float("inf"))
        for part, far in radius.items()
    }


def _solve(group: pa.Table, k: int) -> pa.RecordBatch:
    """The k best keys of the block for each query of the block, each by its best row.

    Rows of one key are dealt to one block, so that none takes the place of another key.
    """
    role, ids = group.column("role").to_numpy(), group.column("id").to_numpy()
    vectors = matrix(group.column("vector").combine_chunks())
    queries, data = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    data = data[np.argsort(ids[data], kind="stable")]
    right = vectors[data]
    right_ids, starts = np.unique(ids[data], return_index=True)
    repeated = len(right_ids) < len(data)
    largest = float(np.abs(vectors).max()) if len(vectors) else 0.0
    exact = largest * largest * max(1, vectors.shape[1]) < _EXACT
    right = right.astype(np.float64 if exact else np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(queries), PRODUCT_ROWS):
        mine = queries[start:start + PRODUCT_ROWS]
        scores = vectors[mine].astype(right.dtype) @ right.T
        if repeated:
            scores = np.maximum.reduceat(scores, starts, axis=1)
        lowest = -np.inf if exact else np.iinfo(np.int64).min
        own = ids[mine][:, None] == right_ids[None, :]
        scores[own] = lowest
        if scores.shape[1] > k:
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        else:
            least = np.full(len(mine), lowest)
        for n, q in enumerate(mine):
            at = np.flatnonzero((scores[n] >= least[n]) & ~own[n])
            best = at[np.argsort(-scores[n][at], kind="stable")[:k]]  # columns are by id, so ties are too
            out.append((np.full(len(best), ids[q]), right_ids[best], scores[n][best].astype(np.int64)))
    flat = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), ()))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in flat], names=["query_id", "vec_id", "score"])


def _join(data: DataFrame, queries: DataFrame, rows: int, n_queries: int, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score), the k best of every block; all vectors have one length.

    ``data`` and ``queries`` are staged, with id and vector.
    """
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    top = data.agg(F.max(squares)).first()[0] or 0.0
    points = _lifted(sampled(data, "id", "vector", rows), top)
    count = min(MOST_GROUPS, max(LEAST_GROUPS, -(-n_queries // GROUP_QUERIES)))
    pivots = centres(points, count, spherical=False)
    limits = _summaries(data, queries, pivots, top, k)
    parts = sorted(limits)
    # Room for rounding: a bound may only let too much through.
    reach = np.array([sum(limits[part]) for part in parts]) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(top))
    shared = data.sparkSession.sparkContext.broadcast((pivots, top, np.array(parts), reach))

    def to_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value[0]
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column(1))
                own = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), p).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], names=["part", "id", "vector"])

    def to_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, most, wanted, far = shared.value
        for batch in batches:
            if batch.num_rows:
                row, part = np.nonzero(_distances(_lifted(matrix(batch.column(1)), most), p[wanted]) <= far)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wanted[part], pa.int32()), *batch.take(pa.array(row)).columns], names=["part", "id", "vector"]
                )

    schema = "part int, id long, vector array<long>"
    asked = stage(queries.mapInArrow(to_queries, schema), "asked")
    given = stage(data.mapInArrow(to_groups, schema), "given")
    counts = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).cast("int").alias("h")).join(
        given.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("v")), "part"
    )
    counts = small_side(stage(counts, "blocks"), 32)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = F.xxhash64("id")
    left = asked.join(counts, "part").select("part", F.pmod(spread, "h").cast("int").alias("a"), every("v").alias("b"), F.lit(0).alias("role"), "id", "vector")
    right = given.join(counts, "part").select("part", every("h").alias("a"), F.pmod(spread, "v").cast("int").alias("b"), F.lit(1).alias("role"), "id", "vector")
    dealt = left.union(right).withColumn("block", F.xxhash64("part", "a", "b")).select("block", "role", "id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            yield _solve(group, k)

    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, key: str, vector: str, is_query: str, k: int = 5, scale: int = 256) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k best other rows for each query row.

    Components become floor(scale * x); score is the integer inner product, ties go to the smaller
    key. ``is_query`` is a condition on the columns id and given. Vectors that are null, empty or hold
    null or non-finite components, and rows with a null key, take no part; vectors of different
    lengths are not compared. Repeated rows with the same key and vector answer once; rows that
    share a key never answer each other.

    Queries are grouped by their nearest pivot. From the summaries of both sides each group gets
    its radius and a bound on the k-th distance; a data vector goes only to groups whose pivot is
    within their sum, as a farther one can't be among the k best. Blocks are solved one by one
    and the best of each merged. Only summaries, one row per pivot, reach the driver.
    """
    with scope() as keep:
        usable = vectors.select(F.col(key).alias("id"), F.col(vector).alias("given")).where(
            F.col("id").isNotNull() & all_finite(F.col("given"))
        )
        whole = F.transform("given", lambda x: F.floor(x.cast("double") * scale).cast("long"))
        data = stage(usable.withColumn("asked", F.expr(is_query)).select("id", whole.alias("vector"), "asked").distinct(), "points")
        found = None
        sizes = data.groupBy(F.size("vector").alias("n")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.col("asked").cast("int")).alias("queries")
        ).orderBy("n").collect()
        for row in sizes:  # one pass per vector length; a table normally has one
            if not row["queries"] or not row["n"]:
                continue
            same = data.where(F.size("vector") == row["n"])
            queries = same.where("asked").select("id", "vector")
            part = stage(_join(same.select("id", "vector"), queries, row["rows"], row["queries"], k), "best")
            found = part if found is None else found.union(part)
        if found is None:
            found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        # A key with several vectors, or a query with several, may answer twice; the better score counts.
        ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
        out = ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        return keep(out, "top-k")
