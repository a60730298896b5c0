"""Incremental reading of a shard directory and metrics that grow with it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from recollect.operators import metrics as M
from recollect.operators.ordering import running_totals
from recollect.operators.staging import scope, stage
from recollect.streaming.user_scores import counted_users


def stream_shards(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    files_per_trigger: int = 1,
    pattern: str = "*.parquet",
) -> DataFrame:
    """Rows of a shard directory as a stream, ``files_per_trigger`` files at a time."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .parquet(path)
    )


def stream_bucket_counts(scores: DataFrame) -> DataFrame:
    """Positives and negatives per score bucket so far. The state has at most 201 keys."""
    return M.bucket_counts(scores)


def run_confusion(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write to ``path`` the bucket counts of everything read so far.

    Each trigger rewrites its own folder, so a trigger run again after a failure replaces what
    it wrote before.
    """
    def save(counts: DataFrame, epoch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        stream_bucket_counts(scores).writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def latest_confusion(spark: SparkSession, path: str) -> DataFrame:
    """Confusion counts from the newest snapshot of :func:`run_confusion`."""
    saved = spark.read.schema("bucket int, pos bigint, neg bigint, epoch bigint").parquet(path)
    newest = saved.agg(F.max("epoch").alias("e")).scalar()
    return M.confusion_from_buckets(saved.where(F.col("epoch") == newest))


# Fixed value: the store that keyed state needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_step_metrics(
    scores: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] | None = None
) -> StreamingQuery:
    """Treat every trigger as a step: append its own metrics, bucket counts and users' changes.

    The keyed state of the stream holds every user's counts over all steps, so that the per-user
    AUC of all rows so far is exact, also after a restart from ``checkpoint``. A trigger run again
    after a failure replaces what it wrote before; what it stages on the way is freed at its end.
    """
    def save(rows: DataFrame, epoch: int) -> None:
        with scope():
            counted = stage(rows, "counted")
            cube = counted.where(F.col("n") > 0).select(
                F.lit(epoch).cast("bigint").alias("batch_id"), "uid", "score", "pos", "neg", "n"
            )
            more = {"more_weighted_auc": "double", "more_impressions": "bigint"}
            sums = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in more]).first()
            changes = {c: F.lit(sums[c]).cast(kind) for c, kind in more.items()}
            steps, buckets = M.cube_steps(cube)
            steps.drop("step").withColumns(changes).write.mode("overwrite").parquet(f"{path}/steps/step={epoch}")
            buckets.drop("batch_id").write.mode("overwrite").parquet(f"{path}/buckets/batch_id={epoch}")

    spark = scores.sparkSession
    before = spark.conf.get(_PROVIDER)
    # A query keeps the settings with which it was started.
    spark.conf.set(_PROVIDER, STATE_STORE)
    try:
        return (
            counted_users(scores).writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(save)
            .start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)


def accumulated_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Running metrics over the steps written by :func:`run_step_metrics`.

    ``gauc_so_far`` weighs the users of each step by themselves; ``user_auc_so_far`` takes every
    user over all rows up to the step.
    """
    steps = spark.read.parquet(f"{path}/steps").withColumn("step", F.col("step").cast("bigint"))
    buckets = spark.read.parquet(f"{path}/buckets").withColumn(
        "batch_id", F.col("batch_id").cast("bigint")
    )
    curves = M.running_curves(buckets).withColumnRenamed("auroc", "auroc_so_far")
    users = running_totals(steps, ["step"], {
        "_weighted": F.col("more_weighted_auc"), "_rows": F.col("more_impressions")
    }).select("step", F.try_divide("_weighted", "_rows").alias("user_auc_so_far"))
    return M.accumulate(steps).join(curves, "step").join(users, "step")
