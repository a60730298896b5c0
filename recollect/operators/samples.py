"""Sample construction: samples with the features of their user and item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators.feed import number_by_place
from recollect.operators.skew import HOT_ROWS, lookup_join


def split_tables(mode: str) -> tuple[str, str, str]:
    """Names of the sample, user and item tables of a split."""
    if mode not in S.SPLIT_TABLES:
        raise ValueError(f"no split is named {mode!r}; there are {', '.join(S.SPLIT_TABLES)}")
    return S.SPLIT_TABLES[mode]


def build_samples(
    samples: DataFrame,
    users: DataFrame,
    items: DataFrame,
    hot_rows: int = HOT_ROWS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Samples with user and item features, both left joins.

    Unmatched ids become 0 and unmatched lists stay NULL. ``keep`` names further sample
    columns to carry along. The narrow sample rows are joined to items first, so that the
    long user lists are moved only once.
    """
    base = samples.select(*keep, "label_0", "uid", "iid")
    with_item = lookup_join(base, items.select(*S.ITEM_COLUMNS), "iid", hot_rows=hot_rows)
    user_rows = users.select(*S.USER_COLUMNS, *S.HISTORY_COLUMNS)
    joined = lookup_join(with_item, user_rows, "uid", "left", base.columns, hot_rows, base)
    return joined.select(*keep, *[
        F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
        if c in (*S.USER_COLUMNS, *S.ITEM_COLUMNS) else F.col(c)
        for c in S.SAMPLE_COLUMNS
    ])


def load_and_build(
    spark: SparkSession, input_dir: str, mode: str, keep: tuple[str, ...] = (), rows_per_shard: int | None = None
) -> DataFrame:
    """Joined samples of a split from the stored tables of ``input_dir``.

    ``keep`` may name ``row_file`` and ``row_pos``, the place of each row in the sample files, and,
    with ``rows_per_shard``, the ``row_no`` and ``shard_no`` that follow from it. Samples are
    numbered while they are narrow, before they are joined.
    """
    from recollect.sources.tables import read_typed, with_row_place

    sample_name, user_name, item_name = split_tables(mode)
    samples = S.to_readable(with_row_place(spark, f"{input_dir}/{sample_name}.parquet"))
    if rows_per_shard:
        samples = number_by_place(samples, rows_per_shard)
    users = read_typed(
        spark, f"{input_dir}/{user_name}.parquet", [*S.USER_COLUMNS, *S.HISTORY_COLUMNS]
    )
    items = read_typed(spark, f"{input_dir}/{item_name}.parquet", S.ITEM_COLUMNS)
    return build_samples(samples, users, items, keep=keep)
