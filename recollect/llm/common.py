"""Helpers of the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import recollect
from recollect.operators.staging import remove_path, scope, shared_dir, stage

# A table is sent to every executor only when its counted rows stay below this many bytes.
BROADCAST_BYTES = 16 << 20
# Bytes of text that a task holds as Python objects at a time.
SLICE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
_SHIPPED = "_recollect_shipped"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def spread_over_cores(df: DataFrame) -> int:
    """Partitions that keep every core of the session busy."""
    session = df.sparkSession
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows one; count a staged table only."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def measured_side(df: DataFrame, row_bytes: Column) -> DataFrame | None:
    """``df`` with a broadcast hint if the sum of its rows' bytes allows one, else None; give a staged table only."""
    total = df.agg(F.sum(row_bytes.cast("double")).alias("n")).first()["n"] or 0.0
    return F.broadcast(df) if total <= BROADCAST_BYTES else None


def ship_package(spark: SparkSession) -> None:
    """Make this package known to the Python workers of the session, once.

    Its modules go as one archive in the shared folder, so executors need not have it installed.
    """
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    package = Path(recollect.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    # Not a staged table: executors that start later fetch it, so it stays until the driver ends.
    folder = f"{shared_dir(spark)}/recollect/package-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, folder)
    path = f"{folder}/recollect_package.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    context.addPyFile(path)
    setattr(context, _SHIPPED, True)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that limits the bytes of a batch sent to Python: BATCH_BYTES unless it says otherwise.

    Spark's own limit of 64 MB is held several times over by a task and its worker.
    """
    ship_package(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values in a text or binary column hold about ``limit`` bytes; one row may hold more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // limit
    start = 0
    for stop in [*(np.flatnonzero(np.diff(part) > 0) + 1).tolist(), batch.num_rows]:
        if stop > start:
            yield batch.slice(start, stop - start)
        start = stop


def give_back_memory() -> None:
    """Return what a task freed to the system; a Python worker outlives its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def hash_share(key: Column, share: Column | float, seed: int = 0) -> Column:
    """True for about ``share`` of all keys; depends on nothing but the key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * share


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns ``id`` and ``component``: for every id in an edge the smallest id it can reach.

    Alternates two steps until nothing changes: each id hands its larger neighbours, then its
    smaller ones, to the smallest id it knows. Both are a minimum per id and a join, so a hub
    with any number of neighbours is summed in parts and its join may be split; no neighbour
    list is built. Each round is written to the shared folder and frees the one before. Self
    loops, repeated edges and nulls are ignored.
    """
    with scope() as keep:
        low, high = F.least(a, b).alias("u"), F.greatest(a, b).alias("v")
        now = stage(
            edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(low, high)
            .where("u < v").distinct(), "edges",
        )
        seen = _state(now)
        while seen[0]:
            both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(
                now.select(F.col("v").alias("x"), F.col("u").alias("y"))
            )
            least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
            large = both.join(least, "x").where("y > x").select(F.col("m").alias("u"), F.col("y").alias("v"))
            large = stage(large.where("u < v").distinct(), "edges")
            root = large.groupBy("v").agg(F.min("u").alias("m"))
            linked = large.join(root, "v")
            now = stage(
                linked.where("m < u").select(F.col("m").alias("u"), F.col("u").alias("v"))
                .union(root.select(F.col("m").alias("u"), "v")).distinct(), "edges",
            )
            before, seen = seen, _state(now)
            if before == seen:
                break
        found = now.select(F.col("v").alias("id"), F.col("u").alias("component")).union(
            now.select(F.col("u").alias("id"), F.col("u").alias("component"))
        )
        return keep(found.distinct(), "components")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"] or 0
