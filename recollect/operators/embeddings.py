"""Embedding tables (id, vec): quantised storage, lookups and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import vectors as V
from recollect.operators.skew import HOT_ROWS, lookup_join


def quantise_table(embeddings: DataFrame) -> DataFrame:
    """(iid, vec float) to (iid, vec tinyint). The reserved id 0 is left out."""
    return embeddings.where(F.col("iid") != 0).select("iid", V.quantise("vec").alias("vec"))


def dequantise_table(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("iid", V.dequantise("vec").alias("vec"))


def lookup_vector(
    df: DataFrame,
    embeddings: DataFrame,
    column: str = "iid",
    output: str = "target_vec",
    width: int | None = None,
    spread: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the vector of a scalar id. A miss gives NULL, or a zero vector if ``width`` is given."""
    table = embeddings.where(F.col("iid") != 0).select(
        F.col("iid").alias(column), F.col("vec").alias(output)
    )
    found = lookup_join(df, table, column, "left", spread, hot_rows)
    if width is None:
        return found
    kind = dict(embeddings.dtypes)["vec"]
    zero = F.array_repeat(F.lit(0), width).cast(kind)
    return found.withColumn(output, F.coalesce(F.col(output), zero))


def unfold_history(users: DataFrame, by: Sequence[str] = ("uid",)) -> DataFrame:
    """(*by, pos, item, cate) per history entry; padding is left out before any shuffle."""
    entries = F.arrays_zip(
        F.col("hist_items").alias("item"), F.col("hist_cates").alias("cate")
    )
    return (
        users.select(*by, F.posexplode(entries).alias("pos", "entry"))
        .select(*by, "pos", "entry.item", "entry.cate")
        .where((F.col("item") != 0) | (F.col("cate") != 0))
    )


def history_vectors(
    users: DataFrame,
    embeddings: DataFrame,
    hot_rows: int = HOT_ROWS,
    by: Sequence[str] = ("uid",),
) -> DataFrame:
    """(*by, hit_pos, hit_vec): per user, the history positions that have a vector.

    Each history is looked up once per user however many samples the user has. Positions
    without a vector are absent instead of being carried as zero vectors. ``by`` identifies a
    row of ``users`` and is what the result stays partitioned by.
    """
    entries = users.select(*by, F.posexplode("hist_items").alias("pos", "item")).where(
        F.col("item") != 0
    )
    table = embeddings.where(F.col("iid") != 0).select(F.col("iid").alias("item"), "vec")
    hits = lookup_join(entries, table, "item", "inner", hot_rows=hot_rows)
    return _fold_hits(hits, by)


def history_pair_vectors(
    users: DataFrame,
    item_vectors: DataFrame,
    cate_vectors: DataFrame,
    item_width: int,
    cate_width: int,
    hot_rows: int = HOT_ROWS,
    by: Sequence[str] = ("uid",),
) -> DataFrame:
    """Like :func:`history_vectors` with the item and category vectors joined end to end."""
    entries = unfold_history(users, by)
    both = pair_vector(entries, item_vectors, cate_vectors, item_width, cate_width, "item", "cate",
                       hot_rows)
    return _fold_hits(both.where(F.col("vec").isNotNull()).select(*by, "pos", "vec"), by)


def pair_vector(
    df: DataFrame,
    item_vectors: DataFrame,
    cate_vectors: DataFrame,
    item_width: int,
    cate_width: int,
    item: str = "iid",
    cate: str = "cate",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``vec`` = item vector followed by category vector; NULL where neither exists."""
    items = item_vectors.where(F.col("iid") != 0).select(
        F.col("iid").alias(item), F.col("vec").alias("_item_vec")
    )
    cates = cate_vectors.where(F.col("cate") != 0).select(
        F.col("cate").alias(cate), F.col("vec").alias("_cate_vec")
    )
    out = lookup_join(df, items, item, "left", df.columns, hot_rows)
    out = lookup_join(out, cates, cate, "left", df.columns, hot_rows, df)
    kind = dict(item_vectors.dtypes)["vec"]

    def filled(name: str, width: int):
        return F.coalesce(F.col(name), F.array_repeat(F.lit(0), width).cast(kind))

    known = F.col("_item_vec").isNotNull() | F.col("_cate_vec").isNotNull()
    joined = F.concat(filled("_item_vec", item_width), filled("_cate_vec", cate_width))
    return out.withColumn("vec", F.when(known, joined)).drop("_item_vec", "_cate_vec")


def _fold_hits(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per user; its length is bounded by the fitted history length."""
    return hits.groupBy(*by).agg(
        F.collect_list(F.struct("pos", "vec")).alias("_hits")
    ).select(
        *by,
        F.col("_hits.pos").alias("hit_pos"),
        F.col("_hits.vec").alias("hit_vec"),
    )


def coverage(df: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Share of target ids and of history positions that have an embedding.

    ``df`` has ``iid`` or ``hist_items`` (or both, in one table or one per call). History
    shares are given over all positions and over positions that are not padding.
    """
    known = embeddings.where(F.col("iid") != 0).select(F.col("iid").alias("id"), F.lit(1).alias("_has"))
    pieces = []
    if "iid" in df.columns:
        pieces.append(df.select(F.lit("target").alias("part"), F.col("iid").alias("id")))
    if "hist_items" in df.columns:
        pieces.append(df.select(F.lit("history").alias("part"), F.explode("hist_items").alias("id")))
    ids = pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])
    # Equal ids are counted before the lookup, so a frequent id crosses the shuffle once per task.
    counted = ids.groupBy("part", "id").agg(F.count(F.lit(1)).alias("n"))
    found = F.when(F.col("_has").isNotNull(), F.col("n")).otherwise(F.lit(0))
    real = F.when(F.col("id") != 0, F.col("n")).otherwise(F.lit(0))
    return counted.join(known, "id", "left").groupBy("part").agg(
        F.sum("n").alias("positions"),
        F.sum(found).alias("covered"),
        F.try_divide(F.sum(found), F.sum("n")).alias("rate"),
        F.try_divide(F.sum(found), F.sum(real)).alias("rate_without_padding"),
    )
