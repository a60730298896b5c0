"""Shards of near-equal bytes from a k-d tree over metadata dimensions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import small_side
from recollect.operators.staging import scope, stage

# Buckets of one search step, bits of the hashes that order groups and rows, rows that one task
# numbers, and the part of a shard's bytes to which a median is searched.
BUCKETS = 1024
HASH_BITS = 40
NUMBERED_ROWS = 65_536
# Copies of one row that are told apart in one step.
COPY_ROWS = 65_536
TOLERANCE = 0.001
# A group of equal rows above this part of a shard may be cut.
GROUP_SHARE = 0.5
_PHASES = ("value", "grp", "tie")


@dataclass
class _Node:
    """A node of the tree that shall become ``leaves`` shards, numbered from ``first``."""

    number: int
    first: int
    leaves: int


@dataclass
class _Search:
    """Search for the cut of a node: rows below ``at`` = (value, grp, tie) go left.

    ``phase`` says which part of the key is being searched, in [low, low + BUCKETS * width);
    the parts before it are settled.
    """

    node: _Node
    axis: int
    want: float
    low: int
    width: int
    phase: int = 0
    at: list[int] = field(default_factory=lambda: [0, 0, 0])
    done: bool = False


def _medians(rows: DataFrame, searches: list[_Search], dims: list[str], leaf_bytes: float) -> None:
    """Narrow every search down to its cut; each step is one sum per node and bucket.

    Only the bucket that holds the wanted share comes back, one row per node.
    """
    spark = rows.sparkSession
    schema = "node int, axis int, phase int, low long, width long, is_value long, is_grp long, want double"
    while open_now := [s for s in searches if not s.done]:
        state = spark.createDataFrame(
            [(s.node.number, s.axis, s.phase, s.low, s.width, s.at[0], s.at[1], s.want) for s in open_now], schema
        )
        value = F.element_at(F.array(*dims), F.col("axis") + 1)
        part = F.when(F.col("phase") == 0, value).when(F.col("phase") == 1, F.col("grp")).otherwise(F.col("tie"))
        inside = ((F.col("phase") == 0) | (value == F.col("is_value"))) & ((F.col("phase") < 2) | (F.col("grp") == F.col("is_grp")))
        below = (value < F.col("is_value")) & (F.col("phase") > 0) | (
            (F.col("phase") > 1) & (value == F.col("is_value")) & (F.col("grp") < F.col("is_grp"))
        )
        bucket = F.when(below, F.lit(-1)).when(
            inside & (part < F.col("low")), F.lit(-1)
        ).when(inside & (part < F.col("low") + F.col("width") * BUCKETS), F.floor((part - F.col("low")) / F.col("width")))
        summed = (
            rows.join(F.broadcast(state), "node").withColumn("bucket", bucket).where("bucket is not null")
            .groupBy("node", "bucket").agg(F.sum("size").alias("bytes"), F.first("want").alias("want"))
        )
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bucket"))
        reached = summed.withColumn("upto", upto).where("upto >= want and bucket >= 0").groupBy("node").agg(
            F.min(F.struct("bucket", "bytes", "upto")).alias("hit")
        )
        hits = {row["node"]: row["hit"] for row in reached.collect()}
        for s in open_now:
            hit = hits.get(s.node.number)
            if hit is None:  # all that is wanted lies below: the cut is behind the range
                s.at[s.phase], s.done = s.low + s.width * BUCKETS, True
                continue
            start = s.low + hit["bucket"] * s.width
            take = 2 * (s.want - (hit["upto"] - hit["bytes"])) > hit["bytes"]
            alone = s.width == 1 and (s.phase == 2 or s.phase == 1 and hit["bytes"] <= GROUP_SHARE * leaf_bytes)
            if alone or hit["bytes"] <= TOLERANCE * leaf_bytes and s.phase < 2:
                s.at[s.phase], s.done = start + s.width * take, True
            elif s.width > 1:
                s.low, s.width = start, -(-s.width // BUCKETS)
            else:
                s.at[s.phase] = start
                s.phase += 1
                s.low, s.width = 0, 1 << max(HASH_BITS - 10, 0)


def kd_shards(points: DataFrame, dims: list[str], target_bytes: float | None = None, shards: int | None = None) -> DataFrame:
    """``points`` with ``shard``: leaves of a k-d tree, each near the target bytes.

    ``points`` has ``size``, the long dimensions ``dims``, and ``grp`` and ``tie`` as hashes of
    HASH_BITS bits that order equal values by group and row. The root shall become total /
    target_bytes (or ``shards``) leaves. A node with several leaves is cut along its widest
    dimension, compared to the whole table's range, at the weighted median that gives each side
    bytes for its leaves. Equal rows have equal dimensions and group, so they stay in one shard
    unless their bytes exceed GROUP_SHARE of one. The driver sees only one row per node and step;
    all nodes of a level are searched together.
    """
    spark = points.sparkSession
    ranges = [F.min(d).alias(f"low_{d}") for d in dims] + [F.max(d).alias(f"high_{d}") for d in dims]
    with scope() as keep:
        rows = stage(points.withColumn("node", F.lit(0)), "kd")
        total = rows.agg(F.sum("size").alias("bytes"), *ranges).first()
        count = shards or max(1, round((total["bytes"] or 0) / target_bytes))
        leaf_bytes = (total["bytes"] or 0) / count
        spans = [max((total[f"high_{d}"] or 0) - (total[f"low_{d}"] or 0), 1) for d in dims]
        leaves, open_nodes, number = [], [_Node(0, 0, count)], 1
        while open_nodes:
            leaves += [n for n in open_nodes if n.leaves == 1]
            open_nodes = [n for n in open_nodes if n.leaves > 1]
            if not open_nodes:
                break
            found = {row["node"]: row for row in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ranges).collect()}
            searches = []
            for node in open_nodes:
                if (row := found.get(node.number)) is None:
                    leaves.append(_Node(node.number, node.first, 1))  # nothing to cut
                    continue
                widths = [(row[f"high_{d}"] - row[f"low_{d}"]) / span for d, span in zip(dims, spans)]
                axis = max(range(len(dims)), key=lambda k: (widths[k], -k))
                low, high = row[f"low_{dims[axis]}"], row[f"high_{dims[axis]}"]
                want = row["bytes"] * (node.leaves // 2) / node.leaves
                searches.append(_Search(node, axis, want, low, -(-(high - low + 1) // BUCKETS)))
            _medians(rows, searches, dims, leaf_bytes)
            cuts, open_nodes = [], []
            for s in searches:
                left = _Node(number, s.node.first, s.node.leaves // 2)
                right = _Node(number + 1, s.node.first + left.leaves, s.node.leaves - left.leaves)
                number += 2
                cuts.append((s.node.number, s.axis, *s.at, left.number, right.number))
                open_nodes += [left, right]
            if not cuts:
                break
            table = spark.createDataFrame(cuts, "node int, axis int, cut_value long, cut_grp long, cut_tie long, l int, r int")
            key = F.struct(F.element_at(F.array(*dims), F.col("axis") + 1).alias("v"), F.col("grp").alias("g"), F.col("tie").alias("t"))
            edge = F.struct(F.col("cut_value").alias("v"), F.col("cut_grp").alias("g"), F.col("cut_tie").alias("t"))
            side = F.when(F.col("axis").isNull(), F.col("node")).when(key < edge, F.col("l")).otherwise(F.col("r"))
            rows = stage(
                rows.join(F.broadcast(table), "node", "left").withColumn("node", side).select(*points.columns, "node"), "kd"
            )
        names = spark.createDataFrame([(n.number, n.first) for n in leaves], "node int, shard int")
        return keep(rows.join(F.broadcast(names), "node").drop("node"), "shards")


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add the gapless ``slot`` of each row within its ``shard``.

    Rows of a shard are dealt by their ``tie`` into parts that one task can number; a part begins
    where the counts of the parts before it end. ``rows`` is staged.
    """
    sizes = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / NUMBERED_ROWS).cast("int").alias("parts"))
    dealt = rows.join(small_side(sizes, 32), "shard").withColumn("part", F.pmod("tie", "parts").cast("int")).drop("parts")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order))
    numbered = dealt.withColumn("place", place).join(offsets, ["shard", "part"])
    return numbered.withColumn("slot", (F.col("begin") + F.col("place") - 1).cast("bigint")).drop("begin", "place", "part")


def short_hash(*columns: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - HASH_BITS)


def apart(rows: DataFrame) -> DataFrame:
    """``rows`` with a ``tie`` that tells equal rows apart.

    Equal rows are counted, and their numbers enter ``tie``: the same rows get the same ties however
    Spark splits the work. Copies are made COPY_ROWS at a time, each such run in a task of its own.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPY_ROWS))))
    first = F.col("run") * COPY_ROWS
    last = F.least(first + COPY_ROWS, F.col("copies")) - 1
    each = runs.repartition("tie", "run").withColumn("copy", F.explode(F.sequence(first, last)))
    return each.withColumn("tie", short_hash("tie", "copy")).select(*rows.columns)


def text_dimensions(text: Column) -> Mapping[str, Column]:
    """Metadata that depends on the text alone: scale of its size, and shares per 1000 bytes."""
    size = F.greatest(F.octet_length(text), F.lit(1))
    lines = F.octet_length(text) - F.octet_length(F.translate(text, "\n", ""))
    return {
        "scale": F.floor(F.log2(size.cast("double")) * 4096),
        "wide": F.floor(1000 * (F.octet_length(text) - F.char_length(text)) / size),
        "lines": F.floor(1000 * lines / size),
    }


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is bytes).

    Null and empty texts have no bytes, size 1 and checksum 0. Equal texts share a shard unless
    they are above half of one. Equal rows are counted apart, so a group of any number of copies is
    cut by their numbers; ties of a slot's order are equal rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    points = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[column.cast("bigint").alias(name) for name, column in text_dimensions(text).items()],
        short_hash(text).alias("grp"), short_hash(F.col("doc_id"), text, F.lit(1)).alias("tie"),
    )
    sharded = kd_shards(apart(points), ["scale", "wide", "lines"], shards=shards)
    return with_slots(sharded, ["doc_id", "tie"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
