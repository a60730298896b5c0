r"""Raw feature text: one row per line, tab between fields, comma in lists, \x1d in vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recollect import schema as S

# Characters stripped from both ends of a line, and the separators.
EDGE_SPACE = r"[\s\x1c-\x1f\x85   -     　]+"
FIELD, LIST, VECTOR = "\t", ",", "\x1d"


@dataclass(frozen=True)
class ParsedText:
    """Typed rows, rejected lines with the reason, and line counters (one row)."""

    good: DataFrame
    rejected: DataFrame
    counts: DataFrame


def _convert(text: Column, role: str) -> Column:
    kind = S.ROLE_TYPES[role].simpleString()
    if role == "id":
        return F.get(F.split(text, LIST, -1), 0).try_cast(kind)
    if role == "vector":
        return F.split(F.get(F.split(text, LIST, -1), 0), VECTOR, -1).try_cast(kind)
    return F.split(text, LIST, -1).try_cast(kind)


def _valid(value: Column, role: str, width: int) -> Column:
    if role == "id":
        return value.isNotNull()
    whole = value.isNotNull() & ~F.exists(value, lambda x: x.isNull())
    return whole & (F.size(value) == width) if role == "vector" else whole


def _checked_lines(lines: DataFrame, layout: list[tuple[str, str]], vector_width: int) -> DataFrame:
    """Converted fields of every line, what kind of line it is, and why it is rejected."""
    edges = f"^{EDGE_SPACE}|{EDGE_SPACE}$"
    trimmed = lines.withColumn("_text", F.regexp_replace("value", edges, ""))
    fields = trimmed.withColumns({
        "_blank": F.col("_text") == "",
        "_fields": F.split("_text", FIELD, -1),
    }).withColumn("_short", F.size("_fields") < len(layout))

    def field(i: int) -> Column:
        text = F.get(F.col("_fields"), i)
        return F.when(text.isNull() | (text == ""), F.lit("0")).otherwise(text)

    converted = fields.select(
        "value", "_blank", "_short",
        *[_convert(field(i), role).alias(name) for i, (name, role) in enumerate(layout)],
    )
    reason = F.coalesce(*[
        F.when(~_valid(F.col(name), role, vector_width), F.lit(f"bad field {name}"))
        for name, role in layout
    ])
    return converted.withColumn("reason", reason)


def parse_lines(
    lines: DataFrame,
    layout: list[tuple[str, str]],
    fill_missing: bool = True,
    vector_width: int = S.VECTOR_WIDTH,
) -> ParsedText:
    """Convert the ``value`` column of text lines by a declared layout.

    Blank lines are skipped and empty fields read as 0. A short line is filled with 0 fields, or
    dropped without ``fill_missing``; surplus fields are ignored. A line with a field that does
    not convert, or a vector of the wrong width, is rejected and does not stop the load.
    """
    checked = _checked_lines(lines, layout, vector_width)
    taken = _taken(fill_missing)
    good = checked.where(taken & F.col("reason").isNull()).select(*[name for name, _ in layout])
    rejected = checked.where(taken & F.col("reason").isNotNull()).select("value", "reason")
    return ParsedText(good, rejected, checked.agg(*_counters(taken)))


def _counters(taken: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("lines_read"),
        F.count_if(F.col("_blank")).alias("lines_blank"),
        F.count_if(~F.col("_blank")).alias("lines_not_blank"),
        F.count_if(~F.col("_blank") & F.col("_short")).alias("lines_short"),
        F.count_if(taken & F.col("reason").isNotNull()).alias("rows_rejected"),
        F.count_if(taken & F.col("reason").isNull()).alias("rows_written"),
        F.count_if(~F.col("_blank") & ~F.col("_short")).alias("rows_full_length"),
    ]


def _taken(fill_missing: bool) -> Column:
    return ~F.col("_blank") if fill_missing else ~F.col("_blank") & ~F.col("_short")


def store_lines(
    lines: DataFrame,
    layout: list[tuple[str, str]],
    path: str,
    fill_missing: bool = True,
    vector_width: int = S.VECTOR_WIDTH,
    codes: bool = True,
) -> ParsedText:
    """Like :func:`parse_lines`, with one pass over the text: rows are written while lines are counted.

    Good rows go to ``path``/line_kind=good, rejected lines with their reason to
    ``path``/line_kind=rejected; ``tables.read_stored`` leaves the rejected ones out. With ``codes``
    columns are stored under their column codes. The frames returned read what was written, and the
    counters are those observed by the write.
    """
    taken = _taken(fill_missing)
    names = [name for name, _ in layout]
    seen = Observation("lines")
    checked = _checked_lines(lines, layout, vector_width).observe(seen, *_counters(taken))
    good = F.col("reason").isNull()
    kept = checked.where(taken).select(
        F.when(good, F.lit("good")).otherwise("rejected").alias(S.LINE_KIND),
        *[F.when(good, F.col(name)).alias(name) for name in names],
        F.when(~good, F.col("value")).alias("value"), "reason",
    )
    kept = S.to_source(kept) if codes else kept
    kept.write.partitionBy(S.LINE_KIND).parquet(path)
    spark = lines.sparkSession
    stored = spark.read.schema(kept.schema).parquet(path)
    stored = S.to_readable(stored) if codes else stored
    counts = spark.range(1).select(*[F.lit(n).cast("bigint").alias(name) for name, n in seen.get.items()])
    return ParsedText(
        stored.where(F.col(S.LINE_KIND) == "good").select(*names),
        stored.where(F.col(S.LINE_KIND) == "rejected").select("value", "reason"), counts,
    )


def read_text(
    spark: SparkSession,
    path: str,
    layout: str | list[tuple[str, str]],
    fill_missing: bool = True,
    vector_width: int = S.VECTOR_WIDTH,
) -> ParsedText:
    """Read raw feature files. ``layout`` is a declared layout or the name of one."""
    fields = S.LAYOUTS[layout] if isinstance(layout, str) else layout
    return parse_lines(spark.read.text(path), fields, fill_missing, vector_width)


def format_lines(df: DataFrame, layout: list[tuple[str, str]]) -> DataFrame:
    """Inverse of :func:`parse_lines`: typed rows as text lines in column ``value``."""
    def text(name: str, role: str) -> Column:
        if role == "id":
            return F.col(name).cast("string")
        values = F.transform(F.col(name), lambda x: x.cast("string"))
        return F.concat_ws(VECTOR if role == "vector" else LIST, values)

    return df.select(
        F.concat_ws(FIELD, *[F.coalesce(text(n, r), F.lit("")) for n, r in layout]).alias("value")
    )
