"""Tables written once to the shared folder, so that a later re-read always sees the same rows."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Folders not freed yet, oldest first.
_live: list[tuple[SparkSession, str]] = []
# Fixed value: Spark's setting to delete a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, else one below the session's warehouse.

    The warehouse default is a folder of the driver's machine, so a session on a cluster has to
    name either setting itself.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and folder.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{folder}/_staged"


def new_path(spark: SparkSession, name: str) -> str:
    """Unused path below the shared folder, freed by ``scope``, ``release`` or the driver's end."""
    path = f"{shared_dir(spark)}/recollect/{name}-{uuid.uuid4().hex}"
    _live.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is still there and the session still runs."""
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session is already gone; the folder's owner cleans up
        pass


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries in the block delete their shuffle files when they end.

    Else the files stay until the driver happens to collect its garbage, and a job of several
    steps has the shuffles of all of them on disk.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    What was shuffled on the way is freed.
    """
    path = new_path(df.sparkSession, name)
    with _freeing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(mark: int = 0) -> None:
    """Delete staged tables, all of them or those after the first ``mark``.

    Frames that read them can't be evaluated afterwards.
    """
    while len(_live) > mark:
        remove_path(*_live.pop())


@contextmanager
def scope() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Free what is staged inside the block when it ends.

    The block gets a function that stages like ``stage``, but for good: its table outlives the
    block.
    """
    mark, kept = len(_live), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        kept.append(_live.pop())
        return out

    try:
        yield keep
    finally:
        release(mark)
        _live.extend(kept)


atexit.register(release)
