"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single task may receive before the key is cut into several.
HOT_ROWS = 1_000_000
_SALT = "_salt"
_PARTS = "_salt_parts"


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer's size estimate, or None where the session does not expose it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def spark_broadcasts(df: DataFrame) -> bool:
    """Whether Spark's own size estimate lets it send the table to every task."""
    size = estimated_bytes(df)
    if size is None:
        return False
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    limit = int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)
    return size <= limit


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of pieces to cut each into.

    There are at most rows / ``hot_rows`` such keys.
    """
    return (
        df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
        .select(*on, F.ceil(F.col("_n") / F.lit(float(hot_rows))).cast("int").alias(_PARTS))
    )


def salt_many(
    df: DataFrame, on: Sequence[str], hot: DataFrame, spread: Sequence[str], name: str = _SALT
) -> DataFrame:
    """Give rows of a hot key one of its piece numbers, taken from a hash of ``spread``.

    A hash, unlike a random draw, gives the same piece when a lost task is run again.
    """
    piece = F.pmod(F.xxhash64(*spread), F.col(_PARTS)).cast("int")
    return (
        df.join(F.broadcast(hot), list(on), "left")
        .withColumn(name, F.coalesce(piece, F.lit(0))).drop(_PARTS)
    )


def salt_one(
    df: DataFrame, on: Sequence[str], hot: DataFrame, name: str = _SALT
) -> DataFrame:
    """Repeat rows of a hot key once for each of its pieces."""
    pieces = F.sequence(F.lit(0), F.coalesce(F.col(_PARTS), F.lit(1)) - 1)
    return (
        df.join(F.broadcast(hot), list(on), "left")
        .withColumn(name, F.explode(pieces)).drop(_PARTS)
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    spread: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
    count_in: DataFrame | None = None,
) -> DataFrame:
    """Join many ``left`` rows to a keyed ``right`` table.

    When Spark's own size estimate lets it broadcast ``right``, ``left`` is not shuffled and
    a plain join is enough. Otherwise keys with more than ``hot_rows`` left rows are cut into
    pieces on the left and their right rows repeated, so that no task receives a whole hot key.
    ``spread`` names the columns that tell rows of one key apart (all left columns by default).
    ``count_in`` is a table with the same key frequencies as ``left``, counted instead of it.
    In a chain of lookups it is the table before the first one, so that counting keys does not
    repeat the lookups already made.
    """
    on = [on] if isinstance(on, str) else list(on)
    if spark_broadcasts(right):
        return left.join(right, on, how)
    hot = hot_keys(left if count_in is None else count_in, on, hot_rows)
    salted = salt_many(left, on, hot, spread or left.columns)
    joined = salted.join(salt_one(right, on, hot), [*on, _SALT], how)
    return joined.drop(_SALT)
