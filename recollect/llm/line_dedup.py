"""Lines that many documents repeat, found in sorted streams of hashes and returned as bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import bounded_batches, measured_side, slices
from recollect.operators.skew import lookup_join
from recollect.operators.staging import scope, stage

# Code points of a key, and documents that hold it, from which its lines are repeats.
LEAST_LENGTH = 40
LEAST_DOCUMENTS = 5
# Stripped from both ends of a line.
_BLANK = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
# A document is its id, or the absence of one; a version is one of its texts.
_DOCUMENT = ["known", "doc", "version"]
# Places of a row's verdict: decided in its partition, or open as part of the first or last group.
_DECIDED, _FIRST, _LAST = 0, 1, 2


def line_keys(text: bytes, least: int = LEAST_LENGTH) -> dict[bytes, list[int]]:
    """Keys of at least ``least`` code points and the numbers of the lines that have them."""
    found: dict[bytes, list[int]] = {}
    for place, line in enumerate(text.split(b"\n")):
        if len(line) >= least:
            key = line.strip(_BLANK).lower()
            if len(key) >= least and len(key.translate(None, _CONTINUATION)) >= least:
                found.setdefault(key, []).append(place)
    return found


def _hashed(docs: DataFrame, least: int) -> DataFrame:
    """One row per document and key: 128-bit hash, document, version and the lines' places."""
    schema = T.StructType([
        *[T.StructField(name, T.LongType()) for name in ("high", "low")],
        *docs.select(_DOCUMENT).schema.fields, T.StructField("places", T.ArrayType(T.IntegerType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                digests, rows, places = [], [], []
                for row, text in enumerate(batch.column(3)):
                    found = line_keys(text.as_py() or b"", least)
                    digests += map(xxhash.xxh3_128_digest, found)
                    places += found.values()
                    rows += [row] * len(found)
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(halves[:, 0]), pa.array(halves[:, 1]), *[batch.column(k).take(at) for k in range(3)],
                    pa.array(places, pa.list_(pa.int32())),
                ], names=schema.names)

    return bounded_batches(docs.select(*_DOCUMENT, "text")).mapInArrow(run, schema)


@dataclass
class _Open:
    """The group of equal hashes at the end of what a task has read."""

    key: tuple[int, int]
    is_first: bool
    first: tuple[int, int]
    last: tuple[int, int, int] = (0, 0, 0)
    documents: int = 0
    held: list[pa.RecordBatch] = field(default_factory=list)

    def ends(self) -> list[int]:
        return [*self.key, *self.first, *self.last[:2], self.documents]

    def add(self, rows: pa.RecordBatch, fresh: np.ndarray, again: np.ndarray, part: int, least: int) -> Iterator[pa.RecordBatch]:
        """Take the next rows of the group; ``fresh`` marks new documents, ``again`` repeated rows."""
        rank = self.documents + np.cumsum(fresh) - 1
        self.documents = int(rank[-1]) + 1
        self.last = tuple(rows.column(name)[-1].as_py() for name in _DOCUMENT)
        wanted = ~again & ((rank > 0) | self.is_first)
        kept = rows.select([*_DOCUMENT, "places"]).filter(pa.array(wanted))
        if self.is_first:
            yield _verdict(kept, part, _FIRST, rank[wanted] == 0)
        elif kept.num_rows:
            self.held.append(kept)
        yield from self.decided(part, least)

    def decided(self, part: int, least: int) -> Iterator[pa.RecordBatch]:
        """What is held, once enough documents have it."""
        if self.documents >= least:
            for rows in self.held:
                yield _verdict(rows, part, _DECIDED, np.zeros(rows.num_rows, bool))
            self.held = []


def _stream(batches: Iterator[pa.RecordBatch], part: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows to be dropped from a sorted partition, and a row that describes its first and last group.

    Rows come by hash, within it by falling document. The first document of a group keeps its
    lines. Those of the others are repeats once ``least`` documents were met; until then they are
    held. Groups that a batch holds as a whole are judged together. A partition's first group may
    have begun before it, so its rows leave undecided, and so do the held rows of its last group.
    """
    now: _Open | None = None
    first: list[int] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        high, low, known, doc, version = (batch.column(k).to_numpy() for k in range(5))
        starts = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
        fresh = starts | np.append(True, (known[1:] != known[:-1]) | (doc[1:] != doc[:-1]))
        again = ~fresh & np.append(False, version[1:] == version[:-1])
        if now is not None and now.key == (high[0], low[0]):
            starts[0] = False
            fresh[0] = now.last[:2] != (known[0], doc[0])
            again[0] = now.last == (known[0], doc[0], version[0])
        cuts = np.append(np.flatnonzero(starts), len(starts))

        def open_group(at: int, is_first: bool) -> _Open:
            return _Open((int(high[at]), int(low[at])), is_first, (int(known[at]), int(doc[at])))

        if cuts[0] > 0:
            yield from now.add(batch.slice(0, cuts[0]), fresh[:cuts[0]], again[:cuts[0]], part, least)
        if len(cuts) == 1:
            continue
        begin = 0
        if now is None:
            now, begin = open_group(0, True), 1
            yield from now.add(batch.slice(0, cuts[1]), fresh[:cuts[1]], again[:cuts[1]], part, least)
            if len(cuts) == 2:
                continue
        first = first or now.ends()
        start, last = cuts[begin], cuts[-2]
        if last > start:
            inside = slice(start, last)
            heads = cuts[begin:-2] - start
            seen = np.cumsum(fresh[inside])
            group = np.cumsum(starts[inside]) - 1
            total = np.add.reduceat(fresh[inside].astype(np.int64), heads)
            repeats = (total >= least)[group] & (seen > seen[heads][group]) & ~again[inside]
            rows = batch.slice(start, last - start).select([*_DOCUMENT, "places"]).filter(pa.array(repeats))
            yield _verdict(rows, part, _DECIDED, np.zeros(rows.num_rows, bool))
        now = open_group(last, False)
        yield from now.add(batch.slice(last), fresh[last:], again[last:], part, least)
    if now is not None:
        for rows in now.held:
            yield _verdict(rows, part, _LAST, np.zeros(rows.num_rows, bool))
        yield _summary([first or now.ends(), now.ends()], part)


_OUT = [*_DOCUMENT, "places", "part", "place", "leads", "ends"]


def _verdict(rows: pa.RecordBatch, part: int, place: int, leads: np.ndarray) -> pa.RecordBatch:
    count = rows.num_rows
    return pa.RecordBatch.from_arrays([
        *rows.columns, pa.array(np.full(count, part), pa.int32()), pa.array(np.full(count, place), pa.int32()),
        pa.array(leads), pa.nulls(count, pa.list_(pa.int64())),
    ], names=_OUT)


def _summary(ends: list[list[int]], part: int) -> pa.RecordBatch:
    """The first and the last group of a partition, twice the same if it has one group."""
    flat = [ends[0] + ends[-1]]
    return pa.RecordBatch.from_arrays([
        pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())),
        pa.array([part], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.bool_()), pa.array(flat, pa.list_(pa.int64())),
    ], names=_OUT)


def across_partitions(parts: list[tuple[int, list[int]]], least: int) -> list[tuple[int, int, bool]]:
    """Open groups that many documents hold: part, place, and whether its first document keeps its lines.

    ``parts`` has the first and last group of each partition, in order. Neighbours with equal
    hashes are one group; a document that ends one and begins the next counts once.
    """
    chains: list[list[tuple[int, int, list[int]]]] = []
    for part, ends in parts:
        half = len(ends) // 2
        first, last = ends[:half], ends[half:]
        for place, group in ((_FIRST, first), (_LAST, last)):
            if place == _LAST and first[:2] == last[:2]:
                continue
            if chains and chains[-1][-1][2][:2] == group[:2]:
                chains[-1].append((part, place, group))
            else:
                chains.append([(part, place, group)])
    out = []
    for chain in chains:
        groups = [group for _, _, group in chain]
        total = sum(group[6] for group in groups) - sum(a[4:6] == b[2:4] for a, b in zip(groups, groups[1:]))
        if total >= least:
            out += [(part, place, group[2:4] == groups[0][2:4]) for part, place, group in chain]
    return out


def _bitmaps(dropped: DataFrame) -> DataFrame:
    """Per document and version the compressed bitmap of the lines that stay, from its dropped places.

    Bit k, the highest of a byte first, is line k; lines behind the last byte stay.
    """
    grouped = dropped.groupBy(*_DOCUMENT).agg(F.flatten(F.collect_list("places")).alias("places"))
    schema = T.StructType([*grouped.schema.fields[:-1], T.StructField("bitmap", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for places in batch.column(3):
                at = places.values.to_numpy()
                keep = np.ones(8 * (int(at.max()) // 8 + 1), bool)
                keep[at] = False
                packed.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=schema.names)

    return grouped.mapInArrow(run, schema)


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, known, doc, version and the text as bytes."""
    return docs.select(
        F.col(key).alias("key"), F.col(key).isNotNull().cast("int").alias("known"),
        F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("doc"), F.xxhash64(text).alias("version"),
        F.col(text).cast("binary").alias("text"),
    )


def keep_bitmaps(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
    least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """Columns known, doc, version, bitmap: the lines that stay in documents that lose some.

    ``key`` is an integer; a null key counts as one document below all others (known 0). Rows that
    share a key are one document with several versions, told apart by a hash of the text. A key of
    a line is the stripped, lower-cased line, compared by 128 bits. Each document sends a key
    once. The rows are range-partitioned by hash, document and version, so a line of any
    frequency is cut over many tasks; each task streams its sorted range, and what ranges know of
    the groups they share is two rows per partition on the driver. Documents without repeats have
    no row.
    """
    with scope() as keep:
        hashed = stage(_hashed(_documents(docs, key, text), least_length), "lines")
        order = ["high", "low", F.desc("known"), F.desc("doc"), "version"]
        ranges = hashed.repartitionByRange(*order).sortWithinPartitions(*order)
        schema = T.StructType([
            *hashed.select(*_DOCUMENT, "places").schema.fields, T.StructField("part", T.IntegerType()),
            T.StructField("place", T.IntegerType()), T.StructField("leads", T.BooleanType()),
            T.StructField("ends", T.ArrayType(T.LongType())),
        ])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _stream(batches, TaskContext.get().partitionId(), least_documents)

        found = stage(ranges.mapInArrow(run, schema), "repeats")
        ends = found.where(F.col("ends").isNotNull()).select("part", "ends").orderBy("part").collect()
        shared = across_partitions([(row["part"], row["ends"]) for row in ends], least_documents)
        # At most two rows per partition.
        verdicts = docs.sparkSession.createDataFrame(shared, "part int, place int, spares boolean")
        rows = found.where(F.col("ends").isNull()).join(F.broadcast(verdicts), ["part", "place"], "left")
        stays = F.col("spares") & F.col("leads")
        dropped = rows.where((F.col("place") == _DECIDED) | (F.col("spares").isNotNull() & ~stays))
        return keep(_bitmaps(dropped.select(*_DOCUMENT, "places")), "bitmaps")


def _joined(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    small = measured_side(bitmaps, F.octet_length("bitmap") + F.lit(96))
    if small is not None:
        return docs.join(small, _DOCUMENT, "left")
    return lookup_join(docs, bitmaps, _DOCUMENT, spread=["key", "version"])


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The text without dropped lines, its lines before dropping, and how many go."""
    if bitmap is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    stays = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:len(lines)].tolist()
    stays += [1] * (len(lines) - len(stays))
    left = [line for line, stay in zip(lines, stays) if stay]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def _applied(docs: DataFrame, bitmaps: DataFrame, out: str, made) -> DataFrame:
    """Columns key, n_lines, n_dropped and ``out``, which ``made`` derives from the kept bytes."""
    source = _joined(docs, bitmaps).select("key", "text", "bitmap")
    schema = T.StructType([
        source.schema["key"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
        T.StructField("out", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                rows = [
                    kept_lines(text.as_py() or b"", bitmap.as_py())
                    for text, bitmap in zip(batch.column(1), batch.column(2))
                ]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([row[1] for row in rows], pa.int64()),
                    pa.array([row[2] for row in rows], pa.int64()), pa.array([made(row[0]) for row in rows], pa.string()),
                ], names=schema.names)

    return bounded_batches(source).mapInArrow(run, schema).withColumnRenamed("out", out)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """Per row: the key, n_lines, n_dropped and the ``text`` without repeated lines.

    Null and empty texts are one empty line. Repeated rows get the same result each.
    """
    bitmaps = keep_bitmaps(docs, key, text, **limits)
    found = _applied(_documents(docs, key, text), bitmaps, "text", lambda kept: kept.decode("utf-8", "replace"))
    return found.withColumnRenamed("key", key)


def line_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, n_lines, n_dropped, kept_sha256."""
    bitmaps = keep_bitmaps(docs)
    found = _applied(_documents(docs, "doc_id", "text"), bitmaps, "kept_sha256", lambda kept: hashlib.sha256(kept).hexdigest())
    return found.withColumnRenamed("key", "doc_id")
