"""Id frequencies and what is read off them: summaries, coverage levels, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X


def feature_ids(df: DataFrame, scalars: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """One row (feature, id) per occurrence, over several columns in a single scan."""
    def tagged(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("feature"), value.cast("bigint").alias("id"))

    missing = [c for c in (*scalars, *lists) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    def entries(name: str) -> Column:
        values = F.coalesce(F.col(name), F.array().cast("array<bigint>"))
        return F.transform(values, lambda x: tagged(name, x))

    pieces = [F.array(tagged(c, F.col(c))) for c in scalars] + [entries(c) for c in lists]
    return df.select(F.inline(F.concat(*pieces))).where(F.col("id").isNotNull())


def id_frequency(df: DataFrame, scalars: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """Occurrences per (feature, id)."""
    return feature_ids(df, scalars, lists).groupBy("feature", "id").agg(
        F.count(F.lit(1)).alias("freq")
    )


def sort_by_frequency(freq: DataFrame) -> DataFrame:
    """Most frequent ids first, smaller id first on ties."""
    return freq.orderBy("feature", F.desc("freq"), "id")


def top_ids(freq: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent ids of each feature.

    The rank limit is pushed below the shuffle, so a task receives at most ``n`` rows per
    feature from every map task.
    """
    best = Window.partitionBy("feature").orderBy(F.desc("freq"), "id")
    return freq.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def frequency_summary(freq: DataFrame, n: int = 10) -> DataFrame:
    """Per feature: distinct ids, occurrences, extremes and the share of the top ``n`` ids."""
    whole = freq.groupBy("feature").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.sum("freq").alias("total_occurrences"),
        F.min("freq").alias("min_freq"),
    )
    top = top_ids(freq, n).groupBy("feature").agg(
        F.max("freq").alias("top1_freq"),
        F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("top1_value"),
        F.sum("freq").alias("_top_sum"),
    )
    share = F.col("_top_sum") / F.col("total_occurrences")
    return whole.join(top, "feature").select(
        "feature", "unique_count", "total_occurrences", "top1_freq", "top1_value", "min_freq",
        share.alias("top10_share"), X.percent_text(share).alias("top10_coverage"),
    )


def frequency_classes(freq: DataFrame) -> DataFrame:
    """Number of ids per (feature, frequency).

    The distinct frequencies of a feature with T occurrences number at most sqrt(2 T), since
    their sum is at most T; windows over one feature's classes therefore stay small.
    """
    return freq.where(F.col("freq") > 0).groupBy("feature", "freq").agg(
        F.count(F.lit(1)).alias("n_ids")
    )


def coverage_levels(freq: DataFrame, levels: Sequence[int] = S.COVERAGE_LEVELS) -> DataFrame:
    """For each level (in percent): the first id, by descending frequency, past the level.

    Reports that id's frequency, the share of occurrences reached and the ids needed. Shares
    are compared as integers, so no level falls on a rounding edge.
    """
    above = (
        Window.partitionBy("feature").orderBy(F.desc("freq"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy("feature")
    mass = F.col("n_ids") * F.col("freq")
    classes = frequency_classes(freq).select(
        "feature", "freq", "n_ids",
        F.coalesce(F.sum(mass).over(above), F.lit(0)).alias("c_before"),
        F.coalesce(F.sum("n_ids").over(above), F.lit(0)).alias("i_before"),
        F.sum(mass).over(whole).alias("total"),
        F.min("freq").over(whole).alias("last_freq"),
    )
    c_after = F.col("c_before") + mass
    reached = F.filter(
        F.array(*[F.lit(q) for q in levels]),
        lambda q: (
            (F.col("c_before") * 100 <= q * F.col("total")) & (q * F.col("total") < c_after * 100)
        ) | ((q >= 100) & (F.col("freq") == F.col("last_freq"))),
    )
    hit = classes.withColumn("level", F.explode(reached))
    k = F.least(
        F.expr("(level * total - c_before * 100) div (freq * 100)") + 1, F.col("n_ids")
    )
    hit = hit.withColumn("_k", k)
    return hit.select(
        "feature", "level", F.col("freq").alias("min_freq"),
        ((F.col("c_before") + F.col("_k") * F.col("freq")) / F.col("total")).alias("cumulative_ratio"),
        (F.col("i_before") + F.col("_k")).alias("num_items"),
    )


def log_histogram(
    freq: DataFrame, num_bins: int = 10, log_base: float = 10.0, add_one: bool = True
) -> DataFrame:
    """Histogram of the frequencies over bins evenly spaced in log10, empty bins included.

    A feature whose frequencies are all equal gives one bin.
    """
    classes = frequency_classes(freq)
    bounds = classes.groupBy("feature").agg(
        F.log10(F.min("freq").cast("double")).alias("low"),
        F.log10(F.max("freq").cast("double")).alias("high"),
    ).withColumn("n", F.when(F.col("low") == F.col("high"), F.lit(1)).otherwise(F.lit(num_bins)))
    position = (F.log10(F.col("freq").cast("double")) - F.col("low")) / (F.col("high") - F.col("low"))
    number = F.when(F.col("n") == 1, F.lit(0)).otherwise(
        F.least(F.floor(position * F.col("n")), F.col("n") - 1)
    )
    filled = (
        classes.join(bounds, "feature")
        .select("feature", number.cast("int").alias("bin"), "n_ids")
        .groupBy("feature", "bin").agg(F.sum("n_ids").alias("n_ids"))
    )
    bins = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    count = F.coalesce(F.col("n_ids"), F.lit(0))
    step = (F.col("high") - F.col("low")) / F.col("n")

    def edge(i: Column) -> Column:
        return F.pow(F.lit(10.0), F.col("low") + i * step)

    return bins.join(filled, ["feature", "bin"], "left").select(
        "feature", "bin",
        edge(F.col("bin")).alias("low_edge"),
        edge(F.col("bin") + 1).alias("high_edge"),
        F.sqrt(edge(F.col("bin")) * edge(F.col("bin") + 1)).alias("center"),
        count.alias("n_ids"),
        X.log_count(count, log_base, add_one).alias("log_count"),
    )
