"""Readers of stored tables, shard directories and sidecar files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect import schema as S

METADATA_SCHEMA = "mode string, total_rows bigint, num_shards bigint, schema array<string>, created_at string"


def read_stored(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet rows; of tables made from text those of good lines, by their partition."""
    df = spark.read.parquet(*paths)
    if S.LINE_KIND not in df.columns:
        return df
    return df.where(F.col(S.LINE_KIND) == "good").drop(S.LINE_KIND, "value", "reason")


def read_typed(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Named columns of a Parquet table, readable names; fails if one is missing."""
    df = S.to_readable(read_stored(spark, path))
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found in {path}: {missing}")
    return df.select(*columns)


def read_shards(
    spark: SparkSession, path: str, mode: str, schema: T.StructType | None = None
) -> DataFrame:
    """All shards of a split with ``shard_file`` and ``row_in_shard`` (from 0) for each row."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("pathGlobFilter", f"{mode}-shard-*.parquet").parquet(path)
    return S.to_readable(df.select(
        "*",
        F.col("_metadata.file_name").alias("shard_file"),
        F.col("_metadata.row_index").alias("row_in_shard"),
    ))


def shard_rows(shards: DataFrame) -> DataFrame:
    """(shard_file, n_rows) of :func:`read_shards`."""
    return shards.groupBy("shard_file").agg(F.count(F.lit(1)).alias("n_rows"))


def with_row_place(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with the file and position that identify each of them.

    The pair stays the same when a task is run again, also for rows that are exact copies.
    """
    return read_stored(spark, path).select(
        "*",
        F.col("_metadata.file_path").alias("row_file"),
        F.col("_metadata.row_index").alias("row_pos"),
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar of a shard directory; an empty table if there is none."""
    try:
        return spark.read.schema(METADATA_SCHEMA).option("multiLine", True).json(
            f"{path}/metadata.json"
        )
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], METADATA_SCHEMA)


def steps_per_epoch(metadata: DataFrame, batch_size: int, world_size: int = 1) -> DataFrame:
    return metadata.select(
        "mode", F.expr(f"total_rows div {batch_size * world_size}").alias("steps")
    )


def read_frequencies(spark: SparkSession, path: str, features: Sequence[str] = ()) -> DataFrame:
    """Frequency table; naming features reads only their partitions."""
    df = spark.read.schema("id bigint, freq bigint, feature string").parquet(path)
    df = df.select("feature", "id", "freq")
    return df.where(F.col("feature").isin(*features)) if features else df


def read_vocabulary(spark: SparkSession, path: str, reduced: bool = False) -> DataFrame:
    """Vocabularies. With ``reduced`` the item list uses its reduced vocabulary."""
    df = spark.read.schema("id bigint, idx bigint, variant string, vocab string").parquet(path)
    small = (F.col("vocab") == "hist_items") & (F.col("variant") == "reduced")
    full = F.col("variant") == "full"
    wanted = small | (full & (F.col("vocab") != "hist_items")) if reduced else full
    return df.where(wanted).select("vocab", "id", "idx")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Quantised embedding table (iid, vec)."""
    return spark.read.schema("iid bigint, vec array<tinyint>").parquet(path)


def read_parts(spark: SparkSession, *paths: str) -> DataFrame:
    """Several part files or folders of one table as one, rows of all of them kept."""
    return S.to_readable(read_stored(spark, *paths))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
