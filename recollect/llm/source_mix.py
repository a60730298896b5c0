"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import small_side
from recollect.operators.staging import scope, stage

# Fixed value of the contract: a word is a run of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"
# Units that one flight handles, and the number of balancing totals (tokens and documents).
FLIGHT_UNITS = 4096
_TOTALS = 2
_EPS = 1e-9


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\x09-\\x0D; 0 for null."""
    # A run begins where a word character follows the start or a separator.
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(
        F.size(F.filter(F.split(plain, " "), lambda word: word != "")), F.lit(0)
    ).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """Columns source, source_size, target: the words each source shall give.

    ``sizes`` has one row per (source, source_size). Sources by code point, null last, weigh
    ``weights`` in turn and share ``share`` of all words; a target stops at ``most`` times the
    source's size and what is above is shared again by weight until none is above. That settles
    where target = min(most * size, level * weight) for one common level: sources ordered by
    size per weight fill up one after the other, so running sums give the level. The windows run
    over the list of sources, one row each.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(named) - 1) % len(weights) + 1)
    weighed = sizes.select("source", "source_size", turn.alias("weight")).withColumns({
        "roof": F.col("source_size") * most, "fill": F.col("source_size") * most / F.col("weight"),
    })
    by_fill = Window.orderBy("fill", F.col("source").isNull(), "source")
    full = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * share
    level = (total - F.coalesce(F.sum("roof").over(full), F.lit(0.0))) / F.sum("weight").over(rest)
    # The level of the first source that it does not fill holds for it and all later ones.
    levels = weighed.withColumn("level", level)
    levels = levels.withColumn("open", F.col("level") <= F.col("fill"))
    common = F.min(F.when(F.col("open"), F.struct("fill", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    return levels.withColumn("common", common).select(
        "source", "source_size",
        F.when(F.col("common").isNull(), F.col("roof")).otherwise(F.least("roof", F.col("common") * F.col("weight")))
        .cast("double").alias("target"),
    )


def flight(share: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities until at most two are left between 0 and 1.

    Each step takes three open units and walks along the one direction that changes neither the
    sum of sizes nor the number of units, as far as a probability reaches 0 or 1; which way is
    drawn so that every probability keeps its expectation.
    """
    share = share.astype(float).tolist()
    sizes = sizes.astype(float).tolist()
    open_units = [k for k in range(len(share)) if _EPS < share[k] < 1 - _EPS]
    draws = rng.random(len(open_units) + 1)
    active = open_units[:_TOTALS + 1]
    following = _TOTALS + 1
    step = 0
    while len(active) == _TOTALS + 1:
        a, b, c = active
        way = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if way == (0.0, 0.0, 0.0):
            way = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, w in zip(active, way):
            if w > 0:
                up, down = min(up, (1 - share[k]) / w), min(down, share[k] / w)
            elif w < 0:
                up, down = min(up, share[k] / -w), min(down, (1 - share[k]) / -w)
        go = up if draws[step] * (up + down) < down else -down
        step += 1
        left = []
        for k, w in zip(active, way):
            value = share[k] + go * w
            if value <= _EPS:
                value = 0.0
            elif value >= 1 - _EPS:
                value = 1.0
            else:
                left.append(k)
            share[k] = value
        while len(left) < _TOTALS + 1 and following < len(open_units):
            left.append(open_units[following])
            following += 1
        active = left
    return np.array(share)


def _settle(share: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Go on with the sum of sizes alone, two open units at a time, until at most one is open."""
    share = share.copy()
    open_units = np.flatnonzero((share > _EPS) & (share < 1 - _EPS)).tolist()
    while len(open_units) > 1:
        a, b = open_units[:2]
        way = (sizes[b], -sizes[a]) if sizes[a] or sizes[b] else (1.0, -1.0)
        up = min((1 - share[k]) / w if w > 0 else share[k] / -w for k, w in zip((a, b), way) if w)
        down = min(share[k] / w if w > 0 else (1 - share[k]) / -w for k, w in zip((a, b), way) if w)
        go = up if rng.random() * (up + down) < down else -down
        for k, w in zip((a, b), way):
            value = share[k] + go * w
            share[k] = 0.0 if value <= _EPS else 1.0 if value >= 1 - _EPS else value
        open_units = [k for k in open_units if _EPS < share[k] < 1 - _EPS]
    return share


def _landing(share: np.ndarray, sizes: np.ndarray, fixed: np.ndarray | None = None) -> np.ndarray:
    """Set the last open unit to 0 or 1, then mend what that costs the sum of sizes.

    The nearer of both values is taken. If another unit's change, or an exchange of a taken unit for
    one that isn't, brings the sum nearer to the shares' own, the best of these is made. Units in
    ``fixed``, whose share was 0 or 1 from the start, stay.
    """
    landed = np.round(share)
    owed = float((share * sizes).sum() - (landed * sizes).sum())  # what is still to be taken
    free = np.ones(len(share), bool) if fixed is None else ~fixed
    inside = np.flatnonzero(free & (landed == 1))
    outside = np.flatnonzero(free & (landed == 0))
    inside, outside = (x[np.argsort(sizes[x], kind="stable")] for x in (inside, outside))
    # A unit of size 0 stands for "none", on either side.
    take, leave = np.append(0.0, sizes[outside]), np.append(0.0, sizes[inside])
    place = np.searchsorted(leave, take - owed)
    left, right = np.maximum(place - 1, 0), np.minimum(place, len(leave) - 1)
    miss_left, miss_right = np.abs(owed - take + leave[left]), np.abs(owed - take + leave[right])
    best = np.where(miss_left <= miss_right, left, right)
    miss = np.minimum(miss_left, miss_right)
    k = int(np.argmin(miss))
    if miss[k] < abs(owed) - _EPS:
        if k:
            landed[outside[k - 1]] = 1.0
        if best[k]:
            landed[inside[best[k] - 1]] = 0.0
    return landed


def _seed(*parts: int) -> np.random.Generator:
    return np.random.default_rng([part & 0xFFFFFFFF for part in parts])


def _flyer(level: int, land: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Flight over one group, keyed by (stratum, group, groups of the stratum)."""

    def fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Large units first: what stays open to the end, and is landed, is small.
        rows = rows.sort_values(["size", "order", "unit"], ascending=[False, True, True], kind="stable")
        sizes = rows["size"].to_numpy()
        share = rows["share"].to_numpy()
        after = flight(share, sizes, _seed(key[0], key[1], level))
        if key[2] == 1 and land:
            fixed = (share <= _EPS) | (share >= 1 - _EPS)
            settled = _settle(after, sizes, _seed(key[0], key[1], level, 1))
            after = _landing(settled, sizes.astype(float), fixed)
        return rows.assign(share=after)[["unit", "stratum", "size", "share"]]

    return fly


def balanced_sample(units: DataFrame, land: bool = True) -> DataFrame:
    """Columns of ``units`` (``unit``, ``stratum``, ``size``, ``share``) with ``share`` 0 or 1.

    ``unit`` and ``stratum`` are longs that identify a unit and its stratum, ``share`` is the
    inclusion probability. Units of a stratum are dealt by a hash into groups of about
    FLIGHT_UNITS, so a stratum with a third of all rows is many tasks. A flight keeps each group's
    totals of size and count and leaves at most two units open. Those go into the next round's
    groups, about a two-thousandth as many, until a stratum has one group; there the number of units
    is let go, the sum of sizes is kept until one unit is open, and landing it is made good by one exchange. Groups and random draws depend on the units alone, so reruns agree.
    """
    schema = "unit long, stratum long, size long, share double"
    with scope() as keep:
        done: list[DataFrame] = []
        now = stage(units.select("unit", "stratum", F.col("size").cast("long"), F.col("share").cast("double")), "units")
        level = 0
        while True:
            counts = stage(
                now.groupBy("stratum").agg(F.ceil(F.count(F.lit(1)) / FLIGHT_UNITS).cast("long").alias("groups")), "groups"
            )
            last = (counts.agg(F.max("groups")).first()[0] or 1) == 1

            dealt = now.join(small_side(counts, 64), "stratum").select(
                "unit", "stratum", "size", "share", "groups", F.xxhash64("unit", F.lit(level)).alias("order"),
                F.pmod(F.xxhash64("unit", F.lit(level + 1000)), F.col("groups")).alias("group"),
            )
            flown = stage(dealt.groupBy("stratum", "group", "groups").applyInPandas(_flyer(level, land), schema), "flight")
            if last:
                done.append(flown)
                break
            closed = (F.col("share") <= _EPS) | (F.col("share") >= 1 - _EPS)
            done.append(flown.where(closed))
            now = flown.where(~closed)
            level += 1
        out = done[0]
        for part in done[1:]:
            out = out.unionByName(part)
        return keep(out.withColumn("share", F.round("share").cast("int")), "sample")


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> tuple[DataFrame, DataFrame]:
    """(copies, targets): how often each document is taken, and what each source shall give.

    ``copies`` has doc_id, source, size (words of one row) and copies. A source that shall give
    t times its size takes every document floor(t) times and once more with probability t -
    floor(t); the cube method picks those, so that words and documents of each source are met up
    to its landing. With t at most ``most``, no document is taken more than ceil(most) times.
    Rows that share doc_id and source are one unit and are taken together; null ids and null
    sources are values like any other. A source without words gives nothing.
    """
    with scope() as keep:
        rows = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
        sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        targets = keep(source_targets(sizes, weights, share, most), "targets")
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        # Rounding keeps a full target from looking like a share just below one.
        times = F.round(ratio, 12)
        rates = targets.select(
            F.col("source").alias("of"), F.xxhash64("source", F.col("source").isNull()).alias("stratum"),
            F.floor(times).cast("int").alias("base"), (times - F.floor(times)).alias("share"),
        )
        units = stage(
            rows.groupBy("doc_id", "source").agg(F.sum("size").alias("unit_size"), F.max("size").alias("size"))
            .join(small_side(rates, 256), F.col("source").eqNullSafe(F.col("of"))).drop("of")
            .withColumn("unit", F.xxhash64("doc_id", "stratum", F.col("doc_id").isNull())), "mix-units",
        )
        drawn = balanced_sample(
            units.where("share > 0").select("unit", "stratum", F.col("unit_size").alias("size"), "share")
        ).where("share = 1").select("unit", F.col("share").alias("extra"))
        copies = units.join(drawn.dropDuplicates(["unit"]), "unit", "left").select(
            "doc_id", "source", (F.col("base") + F.coalesce("extra", F.lit(0))).alias("copies")
        )
        return keep(copies, "copies"), targets


def mixture(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken."""
    copies, targets = mix(docs)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    by_source = targets.withColumnRenamed("source", "of")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of"))
    taken = copies.select(F.col("doc_id").alias("of_id"), F.col("source").alias("of"), "copies")
    return (
        sized.join(taken, same).drop("of_id", "of")
        .join(small_side(by_source, 256), F.col("source").eqNullSafe(F.col("of")))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, columns unchanged, each repeated as often as the mixture takes it."""
    copies, _ = mix(docs)
    taken = copies.where("copies > 0").select(
        F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("copies").alias("__mix_copies")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_source"))
    again = F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))).alias("__mix_again")
    return docs.join(small_side(taken, 48), same).select(*[docs[name] for name in docs.columns], again).drop("__mix_again")
