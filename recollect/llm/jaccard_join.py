"""Exact Jaccard join of texts on word n-grams with signature trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import bounded_batches, components, give_back_memory, hash_share, slices, small_side
from recollect.llm.vectors import groups, matrix
from recollect.operators.skew import lookup_join
from recollect.operators.staging import scope, stage

# Bits of a document's token bitmap in a tree. Sets above WIDE_GRAMS have a second one, with about
# WIDE_BITS bits for each gram, by which single pairs are judged.
BITMAP_BITS = 2048
WIDE_GRAMS, WIDE_BITS = 512, 4
# Documents of one leaf block of a signature tree, and the children of an inner node. A gram of no
# more documents is one block.
BLOCK_ROWS = 256
FANOUT = 8
# A document carries this many of its grams, the smallest ones, so that a pair that meets in many
# grams comes out of one of them. Fewer or more change only how often a pair comes out.
FIRST_GRAMS = 32
# Part of all texts that is read to find the n-grams that many texts share, the least number of
# texts for it, how many of those texts make a gram frequent, and how many frequent grams are set
# aside. As a fixed part it finds grams above a fixed number of texts in a table of any size. They
# only order the n-grams; any order gives the same result.
SAMPLE_SHARE = 1 / 32
SAMPLE_TEXTS = 2048
SAMPLE_HITS = 2
SAMPLE_GRAMS = 250_000
# Bytes of words whose hashes a task remembers, and of texts that it holds as sets at a time.
_MEMORY_BYTES = 24 << 20
_SETS_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sets of hashed word n-grams; words are runs of bytes other than space and \\x09-\\x0D."""

    def __init__(self, n: int):
        self.n = n
        self.words: dict[bytes, int] = {}
        self.bytes = 0

    def grams(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes of the lower-cased text's n-grams; all words if fewer than n."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if self.bytes > _MEMORY_BYTES:
            self.words.clear()
            self.bytes = 0
        known = self.words
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
            self.bytes += len(word) + 120
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.n, len(codes))
        mixed = np.full(len(codes) - width + 1, width, np.uint64)
        for k in range(width):
            mixed = _scramble((mixed ^ codes[k:len(codes) - width + 1 + k]) * _ODD)
        return np.unique(mixed)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def bitmap(grams: np.ndarray, width: int = BITMAP_BITS) -> np.ndarray:
    """``width`` bits as 64-bit words, one set for each gram."""
    bits = np.zeros(width, np.uint8)
    bits[(grams % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def wide_bitmap(grams: np.ndarray) -> bytes | None:
    """Bitmap of a large set, as long as the next power of two; null for a small set."""
    if len(grams) <= WIDE_GRAMS:
        return None
    return bitmap(grams, 1 << (WIDE_BITS * len(grams) - 1).bit_length()).tobytes()


def most_shared(size_a: int, wide_a: bytes, size_b: int, wide_b: bytes) -> int:
    """Largest intersection that two sets with these bitmaps may have."""
    a, b = np.frombuffer(wide_a, np.uint64), np.frombuffer(wide_b, np.uint64)
    # The longer one is folded: its halves hold the same places modulo the shorter length.
    while len(a) > len(b):
        a = a[:len(a) // 2] | a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] | b[len(b) // 2:]
    hidden = min(size_a - int(np.bitwise_count(a).sum()), size_b - int(np.bitwise_count(b).sum()))
    return int(np.bitwise_count(a & b).sum()) + hidden


def _required(total: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least intersection of two sets of joint size ``total`` with 100 * inter >= percent * union."""
    return -(-percent * total // (100 + percent))


def _sets(docs: DataFrame, n: int, percent: int, frequent: list[int]) -> DataFrame:
    """Columns id, size, same (digest of the set), bits and prefix (grams that a partner shares).

    Two sets that agree in at least ``percent`` share one of the first size - least + 1 grams of
    any common order, where least is the smallest intersection that the set may have with a
    partner. The order puts frequent grams last. A gram of the prefix is a number that sorts in
    this order: its hash without the lowest bit, negative unless it is frequent. Two grams with
    one number only bring more sets together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(frequent, np.int64).astype(np.uint64)))
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("same", T.BinaryType()),
        T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("wide", T.BinaryType()),
        T.StructField("prefix", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, late = Shingler(n), shared.value
        for batch in (part for whole in batches for part in slices(whole, 1, _SETS_BYTES)):
            sizes, same, bits, wide, prefixes = [], [], [], [], []
            for text in batch.column(1):
                grams = shingler.grams(text.as_py())
                size = len(grams)
                sizes.append(size)
                same.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                bits.append(bitmap(grams).view(np.int64))
                wide.append(wide_bitmap(grams))
                # A partner has at least percent of this set's size, and so has the intersection.
                first = size - -(-percent * size // 100) + 1 if size else 0
                early = np.ones(size, bool)
                if len(late) and size:
                    early = late[np.minimum(np.searchsorted(late, grams), len(late) - 1)] != grams
                places = (grams >> np.uint64(1)) | (early.astype(np.uint64) << np.uint64(63))
                prefixes.append(np.sort(places.view(np.int64))[:first])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), _lists(bits),
                pa.array(wide, pa.binary()), _lists(prefixes),
            ], names=schema.names)
        del shingler
        give_back_memory()

    return bounded_batches(docs).mapInArrow(run, schema)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _frequent(docs: DataFrame, n: int) -> list[int]:
    """Grams that several texts of a sample share, the most frequent first and no more than SAMPLE_GRAMS."""
    rows = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            for text in batch.column(1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingler.grams(text.as_py()).view(np.int64), pa.int64())], names=["gram"]
                )

    sample = docs.where(hash_share(F.col("id"), min(1.0, max(SAMPLE_SHARE, SAMPLE_TEXTS / max(rows, 1)))))
    counted = bounded_batches(sample).mapInArrow(run, "gram long").groupBy("gram").count().where(F.col("count") >= SAMPLE_HITS)
    return counted.orderBy(F.desc("count"), "gram").limit(SAMPLE_GRAMS).toPandas()["gram"].tolist()


class Tree:
    """Signature tree over documents sorted by size: levels of nodes, leaves first.

    A node has the OR of its documents' bitmaps, their least and largest size, and the largest
    number of grams that share a bit with another one.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        sizes, bits = sizes[self.order], bits[self.order]
        excess = sizes - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, excess = self.levels[-1]
            cuts = np.arange(0, len(bits), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(bits, cuts), np.minimum.reduceat(low, cuts),
                np.maximum.reduceat(high, cuts), np.maximum.reduceat(excess, cuts),
            ))

    def pairs(self, other: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of this tree and of ``other`` that may agree in at least ``percent``.

        Both trees are walked down together. The grams that two documents share set at most the
        bits that both nodes have, and each bit hides at most the smaller excess of further ones;
        a node pair that can't reach what its least sizes require is dropped with all below it.
        """
        level_a, level_b = len(self.levels) - 1, len(other.levels) - 1
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            bits_a, low_a, high_a, excess_a = self.levels[level_a]
            bits_b, low_b, high_b, excess_b = other.levels[level_b]
            kept = []
            for start in range(0, len(a), 1 << 16):
                x, y = a[start:start + (1 << 16)], b[start:start + (1 << 16)]
                near = (100 * high_a[x] >= percent * low_b[y]) & (100 * high_b[y] >= percent * low_a[x])
                x, y = x[near], y[near]
                most = np.bitwise_count(bits_a[x] & bits_b[y]).sum(axis=1) + np.minimum(excess_a[x], excess_b[y])
                most = np.minimum(most, np.minimum(high_a[x], high_b[y]))
                fits = most >= _required(low_a[x] + low_b[y], percent)
                kept.append((x[fits], y[fits]))
            a, b = np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept])
            if not level_a and not level_b or not len(a):
                return self.order[a], other.order[b]
            if level_a:
                level_a -= 1
                a, b = _below(a, b, len(self.levels[level_a][0]))
            if level_b:
                level_b -= 1
                b, a = _below(b, a, len(other.levels[level_b][0]))


def _below(nodes: np.ndarray, partners: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of ``nodes`` among ``count`` nodes of the next level, with the partner of each."""
    children = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    again = np.repeat(partners, FANOUT)
    return children[children < count], again[children < count]


def _paired(table: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Rows of ``table`` whose id is in a pair, staged once for both sides; ``pairs`` is staged."""
    ids = stage(
        pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids"
    )
    return stage(table.join(small_side(ids, 32), "id", "left_semi"), name)


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole texts agree in at least ``percent``; ``pairs`` is staged."""
    texts = _paired(docs, pairs, "texts")
    # The partner that many pairs may share comes last: its text isn't moved again. A text that
    # leads very many pairs is repeated for pieces of them.
    side = lambda name: texts.select(F.col("id").alias(name), F.col("text").alias(f"text_{name}"))
    joined = lookup_join(lookup_join(pairs, side("b"), "b", "inner", ["a"]), side("a"), "a", "inner", ["b"], count_in=pairs)
    joined = joined.select("a", "text_a", "b", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, left = Shingler(n), None, None
        for batch in batches:
            kept = []
            for k, (a, text_a, text_b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3))):
                if a != last:
                    last, left = a, shingler.grams(text_a.as_py())
                right = shingler.grams(text_b.as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64())).select(["a", "b"])

    return bounded_batches(joined).mapInArrow(run, "a long, b long")


def _plausible(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps and sizes leave room for the required overlap; ``pairs`` is staged."""
    known = _paired(heads.select("id", "size", "bits", "wide"), pairs, "bitmaps")
    side = lambda name: known.select(
        *[F.col(c).alias(f"{c}_{name}" if c != "id" else name) for c in ("id", "size", "bits", "wide")]
    )
    columns = ["a", "b", *[f"{c}_{name}" for c in ("size", "bits", "wide") for name in "ab"]]
    both = lookup_join(lookup_join(pairs, side("b"), "b", "inner", ["a"]), side("a"), "a", "inner", ["b"], count_in=pairs)
    joined = both.select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _bit_rows(batch.column(4)), _bit_rows(batch.column(5))
            size_a, size_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            hidden = np.minimum(size_a - np.bitwise_count(a).sum(axis=1), size_b - np.bitwise_count(b).sum(axis=1))
            needed = _required(size_a + size_b, percent)
            fits = np.bitwise_count(a & b).sum(axis=1) + hidden >= needed
            for k in np.flatnonzero(fits):
                wide_a, wide_b = batch.column(6)[k].as_py(), batch.column(7)[k].as_py()
                if wide_a and wide_b:
                    fits[k] = most_shared(int(size_a[k]), wide_a, int(size_b[k]), wide_b) >= needed[k]
            yield batch.filter(pa.array(fits)).select(["a", "b"])

    return joined.mapInArrow(run, "a long, b long").distinct()


def _bit_rows(bits: pa.Array) -> np.ndarray:
    return matrix(bits).view(np.uint64)


def _tree_pairs(members: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, that may agree, from staged rows (gram, many, id, size, upto, class) by gram.

    Every gram's members form the leaves of one tree. With more than BLOCK_ROWS of them (``many``)
    the tree's first level below the root are blocks: documents of one size band, dealt by a hash
    into as many blocks as keep each near BLOCK_ROWS. A block's node is (gram, band, block) with size
    range and OR-combined bitmap; node pairs of a gram that may still reach the overlap are the
    tasks, in which the trees below are walked. So a gram with any number of members is cut over
    many tasks, and members move only to the blocks they may have a partner in. Other grams are one
    task each. Members of one class are linked already and not paired. Bitmaps are looked up once the
    tasks are known: they move to blocks and to tasks, not with every join before.

    Two documents of a family meet in many grams. Each carries the first FIRST_GRAMS of its grams;
    a gram leaves out a pair that both lists show in an earlier one, and a pair of which either has
    a size above the other's ``upto``. In its first common gram a pair is never left out; only where
    that gram lies beyond a list may it come out repeatedly. An id with several different texts has
    no list, as its rows don't tell them apart.
    """
    listed = members.groupBy("id").agg(F.sort_array(F.collect_list("gram")).alias("grams")).select(
        "id", F.when(F.size("grams") == F.size(F.array_distinct("grams")), F.slice("grams", 1, FIRST_GRAMS)).alias("first")
    )
    known = stage(listed.join(heads.select("id", "bits"), "id"), "known")
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    banded = members.where("many").withColumn("band", band)
    counts = banded.groupBy("gram", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    leaves = stage(
        banded.join(counts, ["gram", "band"])
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks"), "leaves",
    )
    rows = leaves.join(known.drop("first"), "id")
    words = [F.get("bits", k) for k in range(BITMAP_BITS // 64)]
    excess = F.col("size") - sum((F.bit_count(word) for word in words), F.lit(0))
    nodes = rows.withColumn("excess", excess).withColumns({f"w{k}": word for k, word in enumerate(words)}).groupBy(
        "gram", "band", "block"
    ).agg(
        F.min("size").alias("low"), F.max("size").alias("high"), F.max("upto").alias("upto"), F.max("excess").alias("excess"),
        F.min("class").alias("class_low"), F.max("class").alias("class_high"),
        *[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(len(words))],
    )
    nodes = stage(nodes, "nodes")
    left, right = nodes.alias("l"), nodes.alias("r")
    shared = sum((F.bit_count(F.col(f"l.w{k}").bitwiseAND(F.col(f"r.w{k}"))) for k in range(len(words))), F.lit(0))
    most = F.least(shared + F.least("l.excess", "r.excess"), "l.high", "r.high")
    # A partner's size differs by at most the factor that a band spans, so it is in the next band;
    # one more allows for rounding of the logarithm.
    order = (F.col("l.band") < F.col("r.band")) | (
        (F.col("l.band") == F.col("r.band")) & (F.col("l.block") <= F.col("r.block"))
    )
    one_class = (F.least("l.class_low", "r.class_low") == F.greatest("l.class_high", "r.class_high"))
    node_pairs = left.join(right, (F.col("l.gram") == F.col("r.gram")) & order & (
        F.col("r.band") - F.col("l.band") <= 2
    )).where(
        (F.col("l.low") <= F.col("r.upto")) & (F.col("r.low") <= F.col("l.upto"))
        & (most * (100 + percent) >= percent * (F.col("l.low") + F.col("r.low"))) & ~one_class
    ).select(
        F.col("l.gram").alias("gram"), F.col("l.band").alias("band_l"), F.col("l.block").alias("block_l"),
        F.col("r.band").alias("band_r"), F.col("r.block").alias("block_r"),
    )
    node_pairs = stage(node_pairs.withColumn("pair", F.xxhash64("*")), "node-pairs")
    sides = [
        node_pairs.select("gram", F.col(f"band_{s}").alias("band"), F.col(f"block_{s}").alias("block"), "pair", F.lit(k).alias("side"))
        for k, s in enumerate("lr")
    ]
    # A block paired with itself moves once.
    sides[1] = sides[1].join(
        sides[0].select("pair", "gram", "band", "block"), ["pair", "gram", "band", "block"], "left_anti"
    )
    columns = ["many", "pair", "side", "gram", "id", "size", "upto", "class"]
    moved = leaves.join(sides[0].union(sides[1].select(sides[0].columns)), ["gram", "band", "block"]).select(columns)
    whole = members.where("not many").withColumns({"pair": F.col("gram"), "side": F.lit(0)}).select(columns)
    parts = moved.union(whole).join(known, "id").select(
        "many", "pair", "side", "id", "size", "upto", "bits", "class", F.filter("first", lambda x: x < F.col("gram")).alias("first")
    ).repartition("many", "pair").sortWithinPartitions("many", "pair", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 2):
            a, b = _walk(group, percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return parts.mapInArrow(run, "a long, b long")


def _walk(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    side, ids, sizes, classes = (group.column(k).to_numpy() for k in ("side", "id", "size", "class"))
    bits = _bit_rows(group.column("bits").combine_chunks())
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    right = right if len(right) else left  # a block with itself
    tree = Tree(sizes[left], bits[left])
    other = Tree(sizes[right], bits[right])
    a, b = tree.pairs(other, percent)
    a, b = left[a], right[b]
    # Of a block with itself either order is one pair.
    kept = (classes[a] != classes[b]) & ((ids[a] < ids[b]) if right is left else (ids[a] != ids[b]))
    if "upto" in group.column_names:
        upto = group.column("upto").to_numpy()
        kept &= (sizes[a] <= upto[b]) & (sizes[b] <= upto[a])
    a, b = a[kept], b[kept]
    kept = ~_met_before(group.column("first").combine_chunks(), a, b)
    a, b = ids[a[kept]], ids[b[kept]]
    return np.minimum(a, b), np.maximum(a, b)


def _met_before(first: pa.ListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of places whether their lists share an entry; a null list shares none."""
    rows = np.repeat(np.arange(len(first)), pc.fill_null(pc.list_value_length(first), 0).to_numpy())
    _, entry, times = np.unique(first.flatten().to_numpy(), return_inverse=True, return_counts=True)
    several = np.flatnonzero(times > 1)
    at = np.minimum(np.searchsorted(several, entry), max(len(several) - 1, 0))
    has = np.zeros((len(first), len(several)), bool)
    if len(several):
        common = several[at] == entry
        has[rows[common], at[common]] = True
    bits = np.packbits(has, axis=1)
    found = [(bits[a[k:k + 4096]] & bits[b[k:k + 4096]]).any(axis=1) for k in range(0, len(a), 4096)]
    return np.concatenate([np.zeros(0, bool), *found])


def _classes(source: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged tables: (id, size) of every row, one row of ``_sets`` per class, pairs (a, b) of a class's id and another.

    A class is all rows of an equal set and named by its smallest id. While the list of copies can be
    broadcast, the wide columns move only for ids that have one set in several rows; beyond, once.
    """
    with scope() as keep:
        sets = stage(_sets(source, n, percent, _frequent(source.where(F.col("id").isNotNull()), n)), "sets")
        full = sets.where((F.col("size") > 0) & F.col("id").isNotNull())
        counted = stage(full.groupBy("id", "same").agg(F.count(F.lit(1)).alias("times")), "counted")
        classes = stage(counted.groupBy("same").agg(F.min("id").alias("class")), "classes")
        owned = counted.join(classes, "same")
        tied = keep(owned.where("class != id").select(F.col("class").alias("a"), F.col("id").alias("b"), "same"), "tied")
        again = stage(owned.where("class = id and times > 1").select("id", "same"), "again")
        others = stage(tied.select(F.col("b").alias("id"), "same").union(again), "others")
        columns = ["id", "size", "bits", "wide", "prefix"]
        heads = full.join(small_side(others, 64), ["id", "same"], "left_anti").select(columns).union(
            full.join(small_side(again, 64), ["id", "same"], "left_semi").dropDuplicates(["id", "same"]).select(columns)
        )
        return keep(sets.select("id", "size"), "sizes"), keep(heads, "heads"), tied


def jaccard_join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Columns id, size, component for columns ``id`` and ``text`` of ``docs``, one row per row.

    Two rows link when 100 * intersection >= percent * union of their n-gram sets; component is
    the smallest id reachable by links. Null and empty texts have the empty set and link with
    nothing; a null id links with nothing and has no component. Rows that share an id are one
    document if their sets are equal, and their links all belong to that id.

    Equal sets first become one class, named by its smallest id. Classes meet through the grams of
    their prefixes. Each class is checked against one leader, the smallest class of most of its
    grams; what these checks link is one group. Only grams whose members are still of several
    groups go to the signature trees, and only pairs of different groups come out of them, so a
    family of near copies costs about one check each and no pair of different groups is lost.
    Where a gram is the first that two sets share, the grams before it are lost to the overlap: its
    place in a set and the set's size give the largest partner (``upto``) that it may be first with.
    Documents that have no partner of another group in a gram by these sizes leave it early.
    Every candidate pair is checked on whole texts, once its bitmaps leave room for enough overlap.
    """
    with scope() as keep:
        source = docs.select("id", F.col("text").cast("binary").alias("text"))
        named = source.where(F.col("id").isNotNull())
        sizes, heads, tied = _classes(source, n, percent)
        upto = F.expr(f"{100 + percent} * (size - place) div {percent} - size")
        prefix = heads.select("id", "size", F.posexplode("prefix").alias("place", "gram"))
        met = prefix.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "size")).alias("leader")).where("n > 1")
        grams = stage(prefix.join(met, "gram").withColumn("upto", upto).drop("place"), "met")

        near = (100 * F.col("size") >= percent * F.col("leader.size")) & (100 * F.col("leader.size") >= percent * F.col("size"))
        votes = grams.where((F.col("leader.id") < F.col("id")) & near).groupBy("id", F.col("leader.id").alias("lead")).count()
        chosen = votes.groupBy("id").agg(F.max_by("lead", F.struct("count", -F.col("lead"))).alias("a"))
        chosen = stage(chosen.select("a", F.col("id").alias("b")), "chosen")
        star = stage(_plausible(chosen, heads, percent), "star")
        first = stage(_verified(star, named, n, percent), "links")
        grouped = components(first)

        placed = grams.join(grouped, "id", "left").select(
            "gram", "n", "id", "size", "upto", F.coalesce("component", "id").alias("class")
        )
        # All pairs are only looked at in grams of one block.
        block = placed.where(F.col("n") <= BLOCK_ROWS).drop("n")
        left, right = block.alias("l"), block.alias("r")
        partner = (F.col("l.size") <= F.col("r.upto")) & (F.col("r.size") <= F.col("l.upto")) & (F.col("l.class") != F.col("r.class"))
        open_ = left.join(right, (F.col("l.gram") == F.col("r.gram")) & partner, "left_semi")
        rows = stage(open_.union(placed.where(F.col("n") > BLOCK_ROWS).drop("n")), "open")
        # Grams with the same members are one, the first: a digest of the members tells.
        mixed = rows.groupBy("gram").agg(
            F.min("class").alias("x"), F.max("class").alias("y"), F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("one"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("two"),
        ).where("x < y").groupBy("n", "one", "two").agg(F.min("gram").alias("gram"))
        members = stage(rows.join(mixed.select("gram", (F.col("n") > BLOCK_ROWS).alias("many")), "gram"), "members")
        candidates = stage(_tree_pairs(members, heads, percent).distinct(), "candidates")
        candidates = stage(_plausible(candidates, heads, percent), "plausible")
        second = _verified(candidates, named, n, percent)
        found = components(first.union(second).union(tied.select("a", "b")))
        out = sizes.join(found, "id", "left").select(
            "id", "size", F.coalesce("component", "id").alias("component")
        )
        return keep(out, "jaccard")


def near_copies(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``documents``: doc_id, n_shingles, component_id."""
    return jaccard_join(docs.select(F.col("doc_id").alias("id"), "text"), n, percent).select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id")
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, columns unchanged, without documents linked to one with a smaller id.

    Rows without id, words or text stay. Rows that share an id stay or go together.
    """
    found = jaccard_join(docs.select(F.col("doc_id").alias("id"), "text"), n, percent)
    with scope() as keep:
        gone = keep(found.where("component < id").select(F.col("id").alias("__copy")).distinct(), "gone")
    return docs.join(small_side(gone, 32), docs["doc_id"] == F.col("__copy"), "left_anti")
