"""Training feed: shard and batch plans as data, for in-order and shuffled reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators.ordering import with_index
from recollect.operators.skew import lookup_join
from recollect.operators.staging import stage

# Factors with which epoch, reader group and reader enter the seed.
EPOCH_FACTOR = 100
RANK_FACTOR = 10

# Rows that a reader's shuffle buffer holds.
BUFFER_ROWS = 1000


def shard_numbers(
    df: DataFrame, order: Sequence[str], rows_per_shard: int = S.ROWS_PER_SHARD
) -> DataFrame:
    """Add ``row_no`` (from 0, in the given order) and the shard it falls in."""
    numbered = with_index(df, order, name="row_no", start=0)
    return numbered.withColumn("shard_no", F.floor(F.col("row_no") / rows_per_shard).cast("bigint"))


# Files up to which their list is sent to every task; a path and two numbers take under 1 KB.
LISTED_FILES = 10_000


def number_by_place(
    rows: DataFrame, rows_per_shard: int = S.ROWS_PER_SHARD, file: str = "row_file", pos: str = "row_pos"
) -> DataFrame:
    """Add ``row_no`` (from 0) and ``shard_no`` to stored rows, in the order of files and of rows in them.

    A row's number is its position in its file plus the rows of the files before it. The counts
    per file read no column, and nothing is sorted or sampled, however wide the rows are.
    """
    earlier = Window.partitionBy(F.lit(0)).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(file).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(file, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    if sizes.count() <= LISTED_FILES:
        placed = rows.join(F.broadcast(before), file)
    else:
        placed = lookup_join(rows, before, file, "inner", [pos])
    numbered = placed.withColumn("row_no", (F.col("_before") + F.col(pos)).cast("bigint")).drop("_before")
    return numbered.withColumn("shard_no", F.floor(F.col("row_no") / rows_per_shard).cast("bigint"))


def shard_sizes(df: DataFrame, shard: str = "shard_no") -> DataFrame:
    """Rows per shard."""
    return df.groupBy(shard).agg(F.count(F.lit(1)).alias("n_rows"))


def shard_totals(df: DataFrame, shard: str = "shard_no") -> DataFrame:
    """Total rows and number of shards."""
    return shard_sizes(df, shard).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("num_shards"),
    )


def number_shards(shards: DataFrame, shard: str = "shard_no") -> DataFrame:
    """Add ``position`` (from 0, in shard order) to a shard list.

    A shard list has one row per shard, the size of a directory listing, so one task may sort it.
    """
    listing = Window.partitionBy(F.lit(0)).orderBy(shard)
    return shards.withColumn("position", (F.row_number().over(listing) - 1).cast("bigint"))


def plan_readers(
    shards: DataFrame,
    world_size: int = 1,
    num_workers: int = 1,
    seed: int = 42,
    epoch: int = 0,
    shuffle: bool = False,
    shard: str = "shard_no",
) -> DataFrame:
    """Which reader (rank, worker) reads each shard, and at which place.

    ``shards`` has the shard and its ``n_rows``. Shards beyond the last multiple of
    ``world_size`` go unread: they stay in the plan with ``used`` false so that the loss shows.
    """
    placed = number_shards(shards, shard)
    total = shards.agg(F.count(F.lit(1)).alias("n"))
    surplus = F.col("position") >= total.select(
        F.col("n") - F.pmod(F.col("n"), F.lit(world_size))
    ).scalar()
    rank = F.pmod(F.col("position"), F.lit(world_size))
    in_rank = F.floor(F.col("position") / world_size)
    worker = F.pmod(in_rank, F.lit(num_workers))
    plan = placed.select(
        shard, "n_rows", "position", (~surplus).alias("used"),
        F.when(~surplus, rank).cast("int").alias("rank"),
        F.when(~surplus, worker).cast("int").alias("worker"),
    )
    plan = plan.withColumn(
        "seed", reader_seed(F.col("rank"), F.col("worker"), seed, epoch).cast("bigint")
    )
    key = _mixed("seed", shard) if shuffle else F.col("position")
    turn = Window.partitionBy("rank", "worker").orderBy(key, "position")
    return plan.withColumn("turn", F.when(F.col("used"), F.row_number().over(turn) - 1))


def reader_seed(rank: Column, worker: Column, seed: int = 42, epoch: int = 0) -> Column:
    return F.lit(seed + epoch * EPOCH_FACTOR) + rank * RANK_FACTOR + worker


def _mixed(*columns: str) -> Column:
    """Order key that any engine can repeat: MD5 of the columns' text."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def unread_rows(plan: DataFrame) -> DataFrame:
    """Shards and rows that a plan leaves unread."""
    left = ~F.col("used")
    return plan.agg(
        F.count_if(left).alias("shards_unread"),
        F.coalesce(F.sum(F.when(left, F.col("n_rows"))), F.lit(0)).alias("rows_unread"),
        F.sum("n_rows").alias("rows_total"),
    )


def assign_readers(rows: DataFrame, plan: DataFrame, shard: str = "shard_no") -> DataFrame:
    """Rows of the used shards with their reader and the shard's turn."""
    wanted = plan.where("used").select(shard, "rank", "worker", "seed", "turn")
    # Stored, the plan has its true size, one row per shard, and Spark may broadcast it.
    return rows.join(stage(wanted, "readers"), shard)


def plan_offsets(plan: DataFrame) -> DataFrame:
    """Add ``rows_before``: rows the same reader has read before a shard."""
    earlier = (
        Window.partitionBy("rank", "worker").orderBy("turn")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return plan.where("used").withColumn(
        "rows_before", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0))
    )


def batches_in_order(
    rows: DataFrame,
    plan: DataFrame,
    batch_size: int,
    position: str = "row_in_shard",
    shard: str = "shard_no",
    drop_last: bool = True,
) -> DataFrame:
    """Batches of rows read in shard order, numbered within each reader.

    The place of a row follows from its shard's offset and its position in the shard, so rows
    are not sorted; they are shuffled only where the shard list is too large to broadcast.
    """
    offsets = _with_reader_rows(plan_offsets(plan)).select(
        shard, "rank", "worker", "rows_before", "reader_rows"
    )
    # Stored, the plan has its true size, one row per shard, and Spark may broadcast it.
    placed = rows.join(stage(offsets, "offsets"), shard)
    return _cut(placed, F.col("rows_before") + F.col(position), batch_size, drop_last)


def _with_reader_rows(plan: DataFrame) -> DataFrame:
    reader = Window.partitionBy("rank", "worker")
    return plan.withColumn("reader_rows", F.sum("n_rows").over(reader))


def _cut(placed: DataFrame, place: Column, batch_size: int, drop_last: bool) -> DataFrame:
    out = placed.withColumn("place", place.cast("bigint")).withColumn(
        "batch_id", F.floor(F.col("place") / batch_size).cast("bigint")
    )
    if drop_last:
        full = F.floor(F.col("reader_rows") / batch_size)
        out = out.where(F.col("batch_id") < full)
    return out.drop("rows_before", "reader_rows")


def shuffled_batches(
    rows: DataFrame,
    plan: DataFrame,
    row_key: Sequence[str],
    batch_size: int,
    shard: str = "shard_no",
    drop_last: bool = True,
) -> DataFrame:
    """Batches of rows in a reproducible random order within each reader.

    The order is a hash of the reader's seed and the row's key: it changes with the epoch
    and does not depend on how Spark splits the work. Readers may be of any size, as the order
    is cut over many tasks.
    """
    assigned = assign_readers(rows, plan, shard).drop("turn")
    keyed = assigned.withColumn("_shuffle_key", _mixed("seed", *row_key))
    placed = with_index(
        keyed, ["rank", "worker", "_shuffle_key", *row_key], name="_place", start=0
    ).join(_reader_offsets(plan), ["rank", "worker"])
    out = _cut(placed, F.col("_place") - F.col("rows_before"), batch_size, drop_last)
    return out.drop("_place", "_shuffle_key", "seed")


def buffered_batches(
    rows: DataFrame,
    plan: DataFrame,
    batch_size: int,
    buffer_size: int = BUFFER_ROWS,
    position: str = "row_in_shard",
    shard: str = "shard_no",
    drop_last: bool = True,
) -> DataFrame:
    """Batches of rows as they leave a buffer with replacement of ``buffer_size`` rows per reader.

    A reader's first rows fill the buffer. Each later row takes a slot drawn from the reader's
    seed and the row's place in the stream, and the row that held the slot comes out. What is
    left at the end comes out in a drawn order. So a row never comes out more than
    ``buffer_size`` places before its turn, however late it may come.

    No buffer is run: a row comes out when the next row of its slot arrives. Rows are shuffled once,
    by reader and slot, so a reader of any size is cut into ``buffer_size`` keys; only the rest, at
    most a buffer for each reader, is ordered in one task. With a buffer of one row the stream keeps
    its order.
    """
    if buffer_size < 1:
        raise ValueError("buffer_size must be positive")
    offsets = _with_reader_rows(plan_offsets(plan)).select(
        shard, "rank", "worker", "seed", "rows_before", "reader_rows"
    )
    # Stored, the plan has its true size, one row per shard, and Spark may broadcast it.
    read = rows.join(stage(offsets, "offsets"), shard).withColumn(
        "_turn", (F.col("rows_before") + F.col(position)).cast("bigint")
    )
    drawn = F.conv(F.substring(_mixed("seed", "_turn"), 1, 8), 16, 10).cast("bigint")
    slot = F.when(F.col("_turn") < buffer_size, F.col("_turn")).otherwise(F.pmod(drawn, F.lit(buffer_size)))
    held = Window.partitionBy("rank", "worker", "_slot").orderBy("_turn")
    # Stored, the rows that are replaced and the rest are read without finding them anew.
    left = stage(read.withColumn("_slot", slot).withColumn("_next", F.lead("_turn").over(held)), "buffered")
    out = left.where(F.col("_next").isNotNull()).withColumn("_place", F.col("_next") - buffer_size)
    # At most ``buffer_size`` rows of a reader are left.
    rest = Window.partitionBy("rank", "worker").orderBy(_mixed("seed", "_slot"), "_slot")
    last = left.where(F.col("_next").isNull()).withColumn(
        "_place", F.greatest(F.col("reader_rows") - buffer_size, F.lit(0)) + F.row_number().over(rest) - 1
    )
    placed = _cut(out.unionByName(last), F.col("_place"), batch_size, drop_last)
    return placed.drop("_turn", "_slot", "_next", "_place", "seed")


def _reader_offsets(plan: DataFrame) -> DataFrame:
    """One row per reader: its rows and those of the readers before it."""
    earlier = (
        Window.partitionBy(F.lit(0)).orderBy("rank", "worker")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return plan.where("used").groupBy("rank", "worker").agg(F.sum("n_rows").alias("reader_rows")).select(
        "rank", "worker", "reader_rows",
        F.coalesce(F.sum("reader_rows").over(earlier), F.lit(0)).alias("rows_before"),
    )


def number_by_bytes(
    rows: DataFrame, target_bytes: int, file: str = "row_file", pos: str = "row_pos", size: str = "file_bytes"
) -> DataFrame:
    """Add ``row_no`` and ``shard_no`` to stored rows: neighbours share a shard of ``target_bytes``.

    Files keep their order. A row's byte is its file's first byte plus its share of the file, so
    small files are put together and large ones cut. The listing has one row per file.
    """
    if target_bytes < 1:
        raise ValueError("target_bytes must be positive")
    earlier = Window.partitionBy(F.lit(0)).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    listing = rows.groupBy(file).agg(F.max(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows")).withColumns({
        "_bytes_before": F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)),
        "_rows_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
    })
    listing = stage(listing, "files")
    if listing.count() <= LISTED_FILES:
        placed = rows.join(F.broadcast(listing), file)
    else:
        placed = lookup_join(rows, listing, file, "inner", [pos])
    share = F.expr(f"cast(_bytes as decimal(19,0)) * cast({pos} as decimal(19,0)) div _rows")
    return placed.withColumns({
        "row_no": (F.col("_rows_before") + F.col(pos)).cast("bigint"),
        "shard_no": F.floor((F.col("_bytes_before") + share) / F.lit(target_bytes)).cast("bigint"),
    }).drop("_bytes", "_rows", "_bytes_before", "_rows_before")


def rebalance(
    rows: DataFrame,
    order: Sequence[str],
    n_parts: int = 8,
    start_index: int = 0,
    row_no: str | None = None,
) -> DataFrame:
    """Cut rows into ``n_parts`` equal shards and one more for the remainder.

    Adds ``shard_no`` counting from ``start_index``, which has to be a multiple of ``n_parts``.
    With fewer rows than parts everything goes to one shard at ``start_index``. ``row_no``
    names an existing position column (from 0); otherwise rows are numbered by ``order``.
    """
    if start_index % n_parts:
        raise ValueError("start_index must be a multiple of n_parts")
    if row_no is None:
        rows = with_index(rows, order, name="row_no", start=0)
        row_no = "row_no"
    each = F.floor(
        rows.agg(F.count(F.lit(1)).alias("n")).scalar() / F.lit(n_parts)
    ).cast("bigint")
    part = F.when(each == 0, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col(row_no), each)).cast("bigint"), F.lit(n_parts))
    )
    return rows.withColumn("shard_no", (part + start_index).cast("bigint"))


def estimate_steps(total_rows: int, batch_size: int, world_size: int = 1) -> int:
    """Steps per epoch expected from a split's total rows."""
    return total_rows // (batch_size * world_size)
