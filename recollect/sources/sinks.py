"""Writers of shards, vocabularies, frequencies and embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators import feed
from recollect.operators.frequency import sort_by_frequency
from recollect.sources import tables

# Size of compacted files: a block of a distributed store.
COMPACT_BYTES = 256 << 20


def _shard_writer(df: DataFrame):
    return (
        df.write.option("compression", "zstd")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.row.count.limit", str(S.ROWS_PER_ROW_GROUP))
    )


def write_shards(
    df: DataFrame,
    path: str,
    mode: str = "train",
    rows_per_shard: int = S.ROWS_PER_SHARD,
    order: Sequence[str] | None = None,
) -> None:
    """Write a split as shards of ``rows_per_shard`` rows below ``path``/shard_no=N.

    With ``order`` every shard but the last has exactly that many rows, in that order: rows are
    numbered first and each task then receives whole shards. Without it rows stay where they
    are, the number is an upper bound per file, and the files already have their shard names.
    """
    if order is None:
        _shard_writer(df).option("maxRecordsPerFile", rows_per_shard).parquet(path)
        _name_files(df.sparkSession, path, mode)
        return
    write_planned_shards(feed.shard_numbers(df, order, rows_per_shard), path, "row_no")


def place_shards(df: DataFrame, order: str, numbers: tuple[int, int] | None = None) -> DataFrame:
    """Deal rows out so that a task has whole neighbouring shards, rows by ``order``.

    ``numbers`` is the first shard and how many there are. With it a shard's task follows from its
    number. Otherwise the rows are sampled for ranges, which computes them twice.
    """
    if numbers is None:
        # Ranges spread few numbers evenly, which a hash doesn't.
        return df.repartitionByRange("shard_no").sortWithinPartitions("shard_no", order)
    first, count = numbers
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tasks = max(min(count, tasks), 1)
    task = F.floor((F.col("shard_no") - first) * tasks / F.lit(max(count, 1))).cast("int")
    return df.repartitionById(tasks, task).sortWithinPartitions("shard_no", order)


def write_planned_shards(df: DataFrame, path: str, order: str, numbers: tuple[int, int] | None = None) -> None:
    """Write rows that already carry ``shard_no``: one file per shard, rows by ``order``."""
    _shard_writer(place_shards(df, order, numbers).drop(order)).partitionBy("shard_no").parquet(path)


def name_shards(spark: SparkSession, path: str, mode: str) -> list[str]:
    """Move the files below ``path``/shard_no=N to ``path``/{mode}-shard-NNNNNN.parquet.

    Only file names change; this is the layout that shard readers list by pattern.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    named = []
    for folder in fs.globStatus(hadoop.Path(root, "shard_no=*")):
        number = int(folder.getPath().getName().split("=")[1])
        for file in fs.globStatus(hadoop.Path(folder.getPath(), "*.parquet")):
            target = f"{mode}-shard-{number:06d}.parquet"
            if not fs.rename(file.getPath(), hadoop.Path(root, target)):
                raise OSError(f"cannot move {file.getPath()} to {target}")
            named.append(target)
        fs.delete(folder.getPath(), True)
    return sorted(named)


def _name_files(spark: SparkSession, path: str, mode: str) -> None:
    """Give the part files of an unordered write shard names, numbered by their order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for number, name in enumerate(sorted(f.getPath().getName() for f in fs.globStatus(hadoop.Path(root, "part-*.parquet")))):
        target = f"{mode}-shard-{number:06d}.parquet"
        if not fs.rename(hadoop.Path(root, name), hadoop.Path(root, target)):
            raise OSError(f"cannot move {name} to {target}")


def write_metadata(written: DataFrame, path: str, mode: str, shard: str = "shard_no") -> DataFrame:
    """Write the sidecar of a written split and return it as written: mode, totals, schema, time."""
    fields = [f"{f.name}: {f.dataType.simpleString()}" for f in written.schema if f.name != shard]
    meta = feed.shard_totals(written, shard).select(
        F.lit(mode).alias("mode"), "total_rows", "num_shards",
        F.array(*[F.lit(x) for x in fields]).alias("schema"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )
    spark = written.sparkSession
    _write_line(spark, f"{path}/metadata.json", meta.toJSON().first())
    return spark.read.schema(meta.schema).json(f"{path}/metadata.json")


def _write_line(spark: SparkSession, path: str, text: str) -> None:
    """Write one line as a plain file, the form sidecar readers expect."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text + "\n", "utf-8"))
    finally:
        out.close()


def write_frequencies(freq: DataFrame, path: str) -> None:
    """One partition per feature, most frequent ids first."""
    sort_by_frequency(freq).write.partitionBy("feature").parquet(path)


def write_vocabulary(vocab: DataFrame, path: str, variant: str = "full") -> None:
    """One partition per vocabulary, ids ascending. ``variant`` is full or reduced."""
    ordered = vocab.select("vocab", "id", "idx").orderBy("vocab", "id")
    ordered.write.partitionBy("vocab").parquet(f"{path}/variant={variant}")


def write_embeddings(embeddings: DataFrame, path: str) -> DataFrame:
    """Quantised embeddings by id; returns the one-row description with the scale."""
    embeddings.orderBy("iid").write.parquet(path)
    meta = embeddings.sparkSession.range(1).select(
        F.lit("int8").alias("kind"), (F.lit(1.0) / 127).cast("float").alias("scale")
    )
    _write_line(embeddings.sparkSession, f"{path}_metadata.json", meta.toJSON().first())
    return meta


def compact(parts: DataFrame, path: str, n_files: int) -> DataFrame:
    """Rewrite many part files as ``n_files`` and return the written row total."""
    parts.repartition(n_files).write.parquet(path)
    return parts.sparkSession.read.schema(parts.schema).parquet(path).agg(
        F.count(F.lit(1)).alias("total_rows")
    )


def compact_to_size(
    spark: SparkSession, source: str, path: str, target_bytes: int = COMPACT_BYTES, mode: str = "part"
) -> DataFrame:
    """Rewrite the Parquet files below ``source`` as files of about ``target_bytes``, rows in their order.

    Files are read in the order of their names. Returns (shard_file, n_rows) of what was written.
    """
    rows = tables.with_row_place(spark, source).withColumn("file_bytes", F.col("_metadata.file_size"))
    placed = feed.number_by_bytes(rows, target_bytes).drop("row_file", "row_pos", "file_bytes")
    files = rows.groupBy("row_file").agg(F.max("file_bytes").alias("n"))
    total = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    write_planned_shards(placed, path, "row_no", (0, total // target_bytes + 1))
    name_shards(spark, path, mode)
    return tables.shard_rows(tables.read_shards(spark, path, mode, rows.drop("row_file", "row_pos", "file_bytes").schema))


def write_rebalanced(
    tail: DataFrame, path: str, order: Sequence[str], n_parts: int = 8, start_index: int = 0
) -> None:
    """Write tail shards evened out over ``n_parts`` readers."""
    write_planned_shards(feed.rebalance(tail, order, n_parts, start_index), path, "row_no")
