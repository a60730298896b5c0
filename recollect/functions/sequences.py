"""Behaviour lists: older entries left, newer right, id 0 as padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect import schema as S


def keep_last(values: Column, n: int, length: Column | None = None) -> Column:
    """Newest ``n`` entries. ``length`` is the list length that decides the cut."""
    size = F.size(values) if length is None else length
    return F.slice(values, F.greatest(size - F.lit(n), F.lit(0)) + 1, F.lit(n))


def pad_left(values: Column, n: int, length: Column | None = None) -> Column:
    """Fill with id 0 on the left up to ``n`` entries."""
    size = F.size(values) if length is None else length
    missing = F.greatest(F.lit(n) - size, F.lit(0))
    return F.concat(F.array_repeat(F.lit(0).cast("bigint"), missing), values)


def _list_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<bigint>"))


def fit_histories(df: DataFrame, max_len: int = S.MAX_SEQ_LEN) -> DataFrame:
    """Cut both behaviour lists to their newest ``max_len`` entries and pad them on the left.

    Rows whose lists differ in length have no valid pairs and are left out; ``split_misaligned``
    returns them. A NULL list counts as empty.
    """
    aligned = split_misaligned(df)[0]
    items, cates = _list_or_empty("hist_items"), _list_or_empty("hist_cates")
    entries = keep_last(F.arrays_zip(items.alias("item"), cates.alias("cate")), max_len)
    return aligned.withColumn("_entries", entries).withColumns({
        "hist_items": pad_left(F.col("_entries.item"), max_len),
        "hist_cates": pad_left(F.col("_entries.cate"), max_len),
    }).drop("_entries")


def add_short(df: DataFrame, n: int = S.SHORT_LEN) -> DataFrame:
    """Short lists: the newest ``n`` entries of the fitted lists."""
    return df.withColumns({
        "short_items": keep_last(F.col("hist_items"), n),
        "short_cates": keep_last(F.col("hist_cates"), n),
    })


def add_content_keys(df: DataFrame) -> DataFrame:
    """Copies of the id columns used as content-embedding keys."""
    return df.withColumns({
        f"{c}_c": F.col(c) for c in ("iid", "hist_items", "short_items") if c in df.columns
    })


def split_misaligned(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose two behaviour lists have equal length, and the others."""
    equal = F.size(_list_or_empty("hist_items")) == F.size(_list_or_empty("hist_cates"))
    return df.where(equal), df.where(~equal)


def mask_ids(values: Column, drop) -> Column:
    """Set to 0 every id for which ``drop(id, position)`` holds."""
    return F.transform(values, lambda x, i: F.when(drop(x, i), F.lit(0).cast("bigint")).otherwise(x))


def mask_random(values: Column, share: float, key: Column, seed: int = 0) -> Column:
    """Set a reproducible random share of the entries to 0, drawn per (seed, key, position).

    The draw is the first 32 bits of an MD5, so that other engines can repeat it.
    """
    cut = round(share * 1_000_000)

    def drop(x: Column, i: Column) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), i.cast("string"))), 1, 8), 16, 10)
        return F.pmod(drawn.cast("bigint"), F.lit(1_000_000)) < cut

    return mask_ids(values, drop)
