"""Global positions and running sums without a single-task sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.staging import stage

_PART = "_range_part"
# Fixed value: bits that monotonically_increasing_id leaves for the row within a partition.
_PLACE_BITS = 33


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    group: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums over rows ordered by ``order`` within each ``group``.

    Rows are range-partitioned on (group, order), so a group of any size is cut over many
    tasks. The cut is written down once: every later step reads the same partition number.
    Each partition sums its own rows; what earlier partitions contribute is carried in. Only
    the first group of a partition can have begun earlier, so the carry table has at most one
    row per partition, and that bound is what allows broadcasting it.
    ``order`` has to identify rows within a group for a reproducible result.
    """
    keys = [*group, *order]
    addends = {f"_add_{name}": value for name, value in sums.items()}
    parts = stage(
        df.withColumns(addends).repartitionByRange(*keys).withColumn(_PART, F.spark_partition_id()),
        "ordered",
    )
    within = (
        Window.partitionBy(_PART, *group).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = parts.withColumns({f"_run_{n}": F.sum(f"_add_{n}").over(within) for n in sums})

    totals = parts.groupBy(_PART, *group).agg(*[F.sum(f"_add_{n}").alias(f"_tot_{n}") for n in sums])
    # One row per (partition, group): a group has at most as many rows as there are partitions.
    before = (
        Window.partitionBy(*(group or [F.lit(0)])).orderBy(_PART)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        F.col(_PART).alias("_carry_part"),
        *[F.col(g).alias(f"_carry_key_{i}") for i, g in enumerate(group)],
        *[F.sum(f"_tot_{n}").over(before).alias(f"_before_{n}") for n in sums],
    ).where(F.col(f"_before_{next(iter(sums))}").isNotNull())

    same = F.col(_PART) == F.col("_carry_part")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_carry_key_{i}"))
    joined = local.join(F.broadcast(carry), same, "left")
    return joined.select(
        *df.columns,
        *[
            (F.col(f"_run_{n}") + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n)
            for n in sums
        ],
    )


def with_index(
    df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "idx", start: int = 1
) -> DataFrame:
    """Add the dense position of each row in the global order, per group if given.

    Without groups the rows, however wide, are shuffled once: each task numbers its own sorted
    range while writing it down, and the sizes of the earlier ranges, one row per partition,
    are added on reading.
    """
    if group:
        numbered = running_totals(df, order, {name: F.lit(1).cast("bigint")}, group)
        return numbered if start == 1 else numbered.withColumn(name, F.col(name) + (start - 1))
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stage(ranges.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    # The id holds the partition number above the row's place in it.
    parts = parts.withColumn(_PART, F.shiftright("_place", _PLACE_BITS))
    earlier = Window.partitionBy(F.lit(0)).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(_PART).agg(F.count(F.lit(1)).alias("_n")).select(
        _PART, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    place = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return parts.join(F.broadcast(offsets), _PART).select(
        *df.columns, (place + F.col("_before") + start).cast("bigint").alias(name)
    )
