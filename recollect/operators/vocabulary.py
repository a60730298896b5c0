"""Integer vocabularies: sorted ids numbered from 1, with 0 for anything unseen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators.frequency import coverage_levels
from recollect.operators.ordering import with_index
from recollect.operators.skew import HOT_ROWS, lookup_join, spark_broadcasts


def vocabulary_keys(*sources: DataFrame) -> DataFrame:
    """Distinct (vocabulary, id) of several (feature, id) tables, id 0 left out.

    Features that share a key space are merged into the vocabulary they share.
    """
    names = F.create_map(*[F.lit(x) for pair in S.SHARED_VOCABULARY.items() for x in pair])
    keys = None
    for source in sources:
        part = source.select(
            F.coalesce(names[F.col("feature")], F.col("feature")).alias("vocab"), "id"
        )
        keys = part if keys is None else keys.unionByName(part)
    return keys.where(F.col("id") != 0).distinct()


def build_vocabulary(*sources: DataFrame) -> DataFrame:
    """(vocab, id, idx): ids in ascending order, numbered from 1 within each vocabulary."""
    return with_index(vocabulary_keys(*sources), ["id"], ["vocab"])


def reduced_vocabulary(
    hist_freq: DataFrame, target_ids: DataFrame, level: int = 90
) -> DataFrame:
    """Vocabulary of the ids that cover ``level`` percent of the occurrences, plus all targets.

    Keeps every id at least as frequent as the one at which the level is passed.
    """
    cut = coverage_levels(hist_freq, [level]).select("feature", "min_freq")
    frequent = hist_freq.join(cut, "feature").where(F.col("freq") >= F.col("min_freq"))
    return build_vocabulary(frequent.select("feature", "id"), target_ids.select("feature", "id"))


def _coded(vocab: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """(_vocab, _id, _idx) of the vocabularies of ``columns`` under small numbers, and these numbers."""
    names = sorted({S.vocabulary_of(c) for c in columns})
    codes = {name: i for i, name in enumerate(names)}
    number = F.lit(None)
    for name, i in codes.items():
        number = F.when(F.col("vocab") == name, F.lit(i)).otherwise(number)
    known = vocab.where(F.col("vocab").isin(names)).select(
        number.cast("tinyint").alias("_vocab"), F.col("id").alias("_id"), F.col("idx").alias("_idx")
    )
    return known, codes


def index_ids(
    df: DataFrame, columns: Sequence[str], vocab: DataFrame, hot_rows: int = HOT_ROWS, key: Sequence[str] = ()
) -> DataFrame:
    """Add ``{column}_idx`` for scalar id columns; unseen ids and padding give 0.

    Columns whose vocabulary Spark may broadcast are looked up where the rows lie. With ``key``,
    columns that identify a row, all others are stacked as (key, column, id) and looked up in one
    join, so that the rows themselves move once however many large vocabularies there are.
    """
    large = [
        c for c in columns
        if key and not spark_broadcasts(vocab.where(F.col("vocab") == S.vocabulary_of(c)).select("id", "idx"))
    ]
    source = df
    for column in columns:
        if column in large:
            continue
        keys = vocab.where(F.col("vocab") == S.vocabulary_of(column)).select(
            F.col("id").alias(column), F.col("idx").alias(f"{column}_idx")
        )
        df = lookup_join(df, keys, column, "left", source.columns, hot_rows, source)
        df = df.withColumn(f"{column}_idx", F.coalesce(F.col(f"{column}_idx"), F.lit(0)))
    return df.join(_stacked(source, large, vocab, key, hot_rows), [*key]) if large else df


def _stacked(
    df: DataFrame, columns: Sequence[str], vocab: DataFrame, key: Sequence[str], hot_rows: int
) -> DataFrame:
    """(key, {column}_idx ...) by one join of all columns' ids."""
    known, codes = _coded(vocab, columns)
    entries = F.array(*[
        F.struct(
            F.lit(i).cast("tinyint").alias("_column"),
            F.lit(codes[S.vocabulary_of(c)]).cast("tinyint").alias("_vocab"), F.col(c).cast("bigint").alias("_id"),
        )
        for i, c in enumerate(columns)
    ])
    stacked = df.select(*key, F.inline(entries))
    found = lookup_join(stacked, known, ["_vocab", "_id"], "left", [*key, "_column"], hot_rows)
    return found.groupBy(*key).agg(*[
        F.coalesce(F.max(F.when(F.col("_column") == i, F.col("_idx"))), F.lit(0)).alias(f"{c}_idx")
        for i, c in enumerate(columns)
    ])


def index_lists(
    df: DataFrame, key: str, columns: Sequence[str], vocab: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(key, {column}_idx ...): list columns mapped position by position.

    ``key`` identifies a row. All lists are unfolded in one scan and joined once; an id that
    fills much of the lists, padding above all, is cut into pieces before the shuffle.
    """
    known, codes = _coded(vocab, columns)

    def entries(number: int, name: str) -> Column:
        return F.transform(
            F.coalesce(F.col(name), F.array().cast("array<bigint>")),
            lambda x, i: F.struct(
                F.lit(number).cast("tinyint").alias("_column"),
                F.lit(codes[S.vocabulary_of(name)]).cast("tinyint").alias("_vocab"),
                i.alias("_pos"), x.alias("_id"),
            ),
        )

    unfolded = df.select(key, F.inline(F.concat(*[entries(i, c) for i, c in enumerate(columns)])))
    joined = lookup_join(unfolded, known, ["_vocab", "_id"], "left", hot_rows=hot_rows)
    pair = F.struct("_pos", F.coalesce(F.col("_idx"), F.lit(0)).alias("idx"))
    lists = joined.groupBy(key).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("_column") == i, pair))).alias(c) for i, c in enumerate(columns)
    ])
    folded = lists.select(
        key, *[F.transform(F.col(c), lambda e: e["idx"]).alias(f"{c}_idx") for c in columns]
    )
    empty = F.array().cast("array<bigint>")
    return df.select(key).join(folded, key, "left").select(
        key, *[F.coalesce(F.col(f"{c}_idx"), empty).alias(f"{c}_idx") for c in columns]
    )


def occurrence_counts(indexed: DataFrame, column: str) -> DataFrame:
    """Occurrences per mapped index of a scalar or list index column, index 0 included."""
    is_list = dict(indexed.dtypes)[column].startswith("array")
    ids = indexed.select((F.explode(column) if is_list else F.col(column)).alias("idx"))
    return ids.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))


def dense_counts(counts: DataFrame, vocab: DataFrame, feature: str) -> DataFrame:
    """Counts for every index of the feature's vocabulary, zeros included, and for index 0."""
    own = vocab.where(F.col("vocab") == S.vocabulary_of(feature)).select("idx")
    unseen = vocab.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("idx"))
    return (
        own.unionByName(unseen).join(counts, "idx", "left")
        .select("idx", F.coalesce(F.col("n"), F.lit(0)).alias("n"))
    )


def vocabulary_sizes(vocab: DataFrame) -> DataFrame:
    """Number of ids per vocabulary."""
    return vocab.groupBy("vocab").agg(F.max("idx").alias("size"))
