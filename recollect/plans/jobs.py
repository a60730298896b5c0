"""Preparation of a split from end to end: statistics, vocabularies, shards, evened-out tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators import frequency as FR
from recollect.operators import vocabulary as VO
from recollect.operators.samples import load_and_build, split_tables
from recollect.sources import sinks, tables, text


def ingest(spark: SparkSession, text_path: str, layout: str, path: str, **options) -> text.ParsedText:
    """Raw feature text to a typed Parquet table, in one pass over the text.

    Rejected lines are kept in a partition of their own, which the readers of this package leave
    out. Returns good and rejected rows as written, and counters.
    """
    return text.store_lines(spark.read.text(text_path), S.LAYOUTS[layout], path, **options)


def build_statistics(spark: SparkSession, input_dir: str, output_dir: str) -> None:
    """Frequencies of item and training user ids, full and reduced vocabularies."""
    items = tables.read_typed(spark, f"{input_dir}/item_features.parquet", S.ITEM_COLUMNS)
    users = tables.read_typed(
        spark, f"{input_dir}/train_user_features.parquet", [*S.USER_COLUMNS, *S.HISTORY_COLUMNS]
    )
    counted = FR.id_frequency(items, S.ITEM_COLUMNS).unionByName(
        FR.id_frequency(users, S.USER_COLUMNS, S.HISTORY_COLUMNS)
    )
    sinks.write_frequencies(counted, f"{output_dir}/frequencies")
    freq = tables.read_frequencies(spark, f"{output_dir}/frequencies")
    sinks.write_vocabulary(VO.build_vocabulary(freq), f"{output_dir}/vocabulary")
    hist, target = (freq.where(F.col("feature") == f) for f in ("hist_items", "iid"))
    sinks.write_vocabulary(
        VO.reduced_vocabulary(hist, target), f"{output_dir}/vocabulary", "reduced"
    )


def split_rows(
    spark: SparkSession, input_dir: str, mode: str, rows_per_shard: int = S.ROWS_PER_SHARD
) -> tuple[DataFrame, int]:
    """Joined rows of a split with ``row_no`` and ``shard_no``, and the number of shards."""
    rows = load_and_build(spark, input_dir, mode, ("row_no", "shard_no"), rows_per_shard)
    samples = tables.read_stored(spark, f"{input_dir}/{split_tables(mode)[0]}.parquet")
    return rows, -(-samples.count() // rows_per_shard)


def prepare_split(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    mode: str,
    rows_per_shard: int = S.ROWS_PER_SHARD,
) -> DataFrame:
    """Join a split's samples to their features and write them as shards with a sidecar.

    Shards follow the order of the sample files. The joined rows are moved once, straight to the
    task of their shard. Returns the sidecar.
    """
    path = f"{output_dir}/{mode}"
    rows, shards = split_rows(spark, input_dir, mode, rows_per_shard)
    sinks.write_planned_shards(S.to_source(rows), path, "row_no", (0, shards))
    sinks.name_shards(spark, path, mode)
    shards = tables.read_shards(spark, path, mode)
    written = shards.select(*S.SAMPLE_COLUMNS, "shard_file")
    return sinks.write_metadata(written, path, mode, "shard_file")


def even_out_tail(
    spark: SparkSession, data_dir: str, output_dir: str, mode: str, start_index: int, n_parts: int = 8
) -> None:
    """Rewrite the shards from ``start_index`` on as ``n_parts`` equal ones plus a remainder."""
    shards = tables.read_shards(spark, data_dir, mode)
    number = F.regexp_extract("shard_file", r"-shard-(\d+)\.", 1).cast("bigint")
    tail = shards.where(number >= start_index)
    sizes = tables.shard_rows(tail)
    before = sinks.feed.plan_offsets(
        sinks.feed.plan_readers(sizes, shard="shard_file")
    ).select("shard_file", "rows_before")
    placed = tail.join(before, "shard_file").withColumn(
        "row_no", F.col("rows_before") + F.col("row_in_shard")
    ).drop("shard_file", "row_in_shard", "rows_before")
    even = sinks.feed.rebalance(placed, (), n_parts, start_index, row_no="row_no")
    sinks.write_planned_shards(S.to_source(even), output_dir, "row_no", (start_index, n_parts + 1))
    sinks.name_shards(spark, output_dir, mode)
