"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one vector per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import components, small_side
from recollect.llm.vectors import all_finite, centres, groups, matrix, sampled
from recollect.operators.staging import scope, stage

# Vectors per cell aimed at, and the most cells a sample can carry; home and visiting vectors of
# one block; rows of one matrix product.
CELL_ROWS = 8192
MOST_CELLS = 1024
HOME_ROWS, VISIT_ROWS = 4096, 16_384
PRODUCT_ROWS = 256


def _cells(unit: DataFrame, centre: np.ndarray, least: float) -> DataFrame:
    """Rows (cell, home, id, weight, vector): every vector in its own cell and those it may have a
    partner in.

    A vector's cell is that of its nearest centre c. It visits cell d if it lies within the angle
    of ``least`` of the plane between c and d: no vector of cell d is nearer than that plane, so
    all partners are met.
    """
    shared = unit.sparkSession.sparkContext.broadcast(centre)
    reach = float(np.sqrt(max(0.0, 1 - least * least))) + 1e-6
    schema = "cell int, home boolean, id long, weight long, vector array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        apart = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) if len(c) <= 64 else None
        for batch in batches:
            if not batch.num_rows:
                continue
            if not len(c):
                vectors, near = None, np.zeros((batch.num_rows, 1))
                row, cell, own = np.arange(batch.num_rows), np.zeros(batch.num_rows, int), np.zeros(batch.num_rows, int)
            else:
                vectors = matrix(batch.column(2))
                near = vectors @ c.T
                own = near.argmax(axis=1)
                gap = near[np.arange(len(near)), own][:, None] - near
                width = apart[own] if apart is not None else np.stack([np.linalg.norm(c - c[k], axis=1) for k in own])
                row, cell = np.nonzero(gap <= reach * width + 1e-9)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([
                pa.array(cell, pa.int32()), pa.array(cell == own[row]), *taken.columns,
            ], names=["cell", "home", "id", "weight", "vector"])

    return unit.select("id", "weight", "vector").mapInArrow(run, schema)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the matrix connects, at most rows + columns - 1."""
    rows_left, columns_left = linked.any(axis=1), linked.any(axis=0)
    edges = []
    for start in np.flatnonzero(rows_left):
        if not rows_left[start]:
            continue
        rows_left[start] = False
        front = np.array([start])
        while len(front):
            sub = linked[front][:, columns_left]
            reached = np.flatnonzero(columns_left)[sub.any(axis=0)]
            if not len(reached):
                break
            edges += zip(front[linked[np.ix_(front, reached)].argmax(axis=0)].tolist(), reached.tolist())
            columns_left[reached] = False
            back = np.flatnonzero(rows_left)
            block = linked[np.ix_(back, reached)]
            touched = block.any(axis=1)
            edges += zip(back[touched].tolist(), reached[block[touched].argmax(axis=1)].tolist())
            rows_left[back[touched]] = False
            front = back[touched]
    return edges


def _products(group: pa.Table, least: float) -> pa.RecordBatch:
    """Rows (id, links, other) of one block: links of home vectors (other null), forest edges."""
    home = group.column("role").to_numpy() == 0
    ids, weights = group.column("id").to_numpy(), group.column("weight").to_numpy()
    vectors = matrix(group.column("vector").combine_chunks())
    place, visit = np.flatnonzero(home), np.flatnonzero(~home)
    right, right_ids = vectors[visit], ids[visit]
    rough = right.astype(np.float32)
    out_ids, out_links, out_others = [], [], []
    for start in range(0, len(place), PRODUCT_ROWS):
        mine = place[start:start + PRODUCT_ROWS]
        # Single precision finds candidates with room for its error; double precision decides.
        close = vectors[mine].astype(np.float32) @ rough.T >= least - 1e-3
        a, b = np.nonzero(close)
        for part in range(0, len(a), 1 << 18):
            x, y = a[part:part + (1 << 18)], b[part:part + (1 << 18)]
            wrong = np.einsum("ij,ij->i", vectors[mine[x]], right[y]) < least
            close[x[wrong], y[wrong]] = False
        close &= ids[mine][:, None] != right_ids[None, :]
        links = close @ weights[visit]
        has = links > 0
        out_ids.append(ids[mine][has])
        out_links.append(links[has])
        out_others.append(np.full(has.sum(), -1))
        edges = _forest(close)
        if edges:
            x, y = np.array(edges).T
            out_ids.append(ids[mine[x]])
            out_links.append(np.zeros(len(x), np.int64))
            out_others.append(right_ids[y])
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_ids, out_links, out_others)]
    return pa.RecordBatch.from_arrays(
        [pa.array(x.astype(np.int64), pa.int64()) for x in (flat[0], flat[1])]
        + [pa.array(flat[2].astype(np.int64), pa.int64(), mask=flat[1] > 0)], names=["id", "links", "other"],
    )


def _linked(members: DataFrame, least: float) -> DataFrame:
    """Rows (id, links, other) over all blocks of all cells.

    The home vectors of a cell and all its vectors are dealt into blocks by a hash; each pair of a
    home block and a visiting block is one task's product, so a cell of any size is cut.
    """
    counts = stage(members.groupBy("cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / HOME_ROWS).cast("int").alias("homes"),
        F.ceil(F.count(F.lit(1)) / VISIT_ROWS).cast("int").alias("visits"),
    ), "cells")
    sized = members.join(small_side(counts, 32), "cell")
    spread = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sized.where("home").select(
        "cell", F.pmod(spread, "homes").cast("int").alias("h"), every("visits").alias("v"), F.lit(0).alias("role"), "id", "weight", "vector"
    )
    right = sized.where("homes > 0").select(
        "cell", every("homes").alias("h"), F.pmod(spread, "visits").cast("int").alias("v"), F.lit(1).alias("role"), "id", "weight", "vector"
    )
    dealt = left.union(right).withColumn("block", F.xxhash64("cell", "h", "v")).select("block", "role", "id", "weight", "vector")
    sorted_rows = dealt.repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            yield _products(group, least)

    return sorted_rows.mapInArrow(run, "id long, links long, other long")


def near_vectors(
    vectors: DataFrame, key: str, vector: str, least: float = 0.95, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Columns id, n_links, component_id, kept for each row of ``vectors``.

    Two rows link when the cosine of their vectors, in double precision, is at least ``least``;
    n_links counts the other rows linked directly, component_id is the smallest key reachable and
    kept marks it. Vectors that are null, zero, or hold null or non-finite components link with
    nothing, as do vectors of different lengths; rows with a null key have null component and
    are kept.

    Equal vectors are one class with a weight. Classes are assigned to the cells of a spherical
    k-means, fitted to a bounded sample, and visit every cell in which they may have a partner, so
    no link is missed whatever the cells are. Blocks return counts and the edges of a spanning
    forest, not all links.
    """
    with scope() as keep:
        rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("given"))
        usable = rows.where(F.col("id").isNotNull() & all_finite(F.col("given")))
        double = F.transform("given", lambda x: x.cast("double"))
        # Scaling by the largest component first keeps the squares of extreme vectors finite.
        scaled = usable.withColumn("top", F.array_max(F.transform(double, F.abs))).where("top > 0").withColumn(
            "vector", F.transform(double, lambda x: x / F.col("top"))
        )
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
        unit = scaled.withColumn("norm", norm).withColumn("vector", F.transform("vector", lambda x: x / F.col("norm")))
        member = stage(unit.select("id", "given", "vector"), "unit").withColumn("class_key", F.xxhash64("given"))
        classes = stage(
            member.groupBy("class_key", "given").agg(
                F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector")
            ).select("id", "class_key", "given", "weight", "vector"), "classes",
        )
        sizes = classes.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").collect()
        found = None
        for row in sizes:  # one pass per vector length; a table normally has one
            same = classes.where(F.size("vector") == row["n"])
            cells = max(1, min(MOST_CELLS, row["count"] // cell_rows))
            centre = centres(sampled(same, "id", "vector", row["count"]), cells, spherical=True)
            part = _linked(stage(_cells(same, centre, least), "cells"), least)
            found = part if found is None else found.union(part)
        if found is None:
            return keep(rows.select(
                "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
            ), "vectors")
        found = stage(found, "links")
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        groups_of = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
        by_class = classes.join(links, "id", "left").join(groups_of, "id", "left").select(
            "class_key", "given", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        linked = member.select("id", "given", "class_key").join(by_class, ["class_key", "given"]).select("id", "n_links", "component_id")
        alone = rows.where(
            F.col("id").isNull() | ~all_finite(F.col("given"))
            | (F.coalesce(F.array_max(F.transform(double, F.abs)), F.lit(0.0)) == 0)
        ).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        out = linked.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
        return keep(out, "vectors")
