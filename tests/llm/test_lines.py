"""Line dedup against a plain version, with groups cut over partitions."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.llm import line_dedup as ld

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=5, length=40):
    """(doc, lines, dropped, digest) of each (doc, text) row."""
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(line.strip(BLANK).translate(LOWER), set()).add(doc)
    rank = lambda doc: (doc is not None, doc or 0)
    last = {key: max(docs, key=rank) for key, docs in holders.items() if len(docs) >= least and len(key) >= length}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stays = [x for x in lines if last.get(x.strip(BLANK).translate(LOWER), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, partitions=3):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, places int")
    return sorted(map(tuple, ld.line_digests(docs.repartition(partitions)).collect()), key=str)


def texts(seed, count=120):
    rng = random.Random(seed)
    pool = [f"Line {k} é " + "x" * rng.randint(25, 45) for k in range(12)]
    pool += ["", " ", "short", "É" * 40, "e" * 39, "e" * 40, " " * 45, "A" * 60, "a" * 60 + " \t", "\x0b" + "a" * 60, "y" * 50 + "\r"]
    rows = []
    for doc in range(count):
        rows.append((doc, "\n".join(rng.choice(pool + [f"own line {doc} " * 4]) for _ in range(rng.randint(0, 9)))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_version(spark, seed):
    rows = texts(seed)
    assert found(spark, rows) == plain(rows)


def test_nulls_repeated_rows_versions_and_empty_tables(spark):
    line = "the same line that stands in many of these documents"
    rows = [(k, line) for k in range(6)] + [(5, line)] * 3 + [(5, line + "\nmore"), (None, line), (None, "z\n" + line), (None, None), (9, None), (8, "")]
    assert found(spark, rows) == plain(rows)
    few = [(1, line), (2, line), (3, line), (4, line), (4, line), (4, line + "\n")]
    assert found(spark, few) == plain(few) and all(r[2] == 0 for r in found(spark, few))
    # The missing id is the fifth document.
    assert found(spark, few + [(None, line)]) == plain(few + [(None, line)])
    assert ld.line_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_and_one_line_in_all(spark):
    line = "A line of the licence that every single document holds."
    rows = [(k, f"{line}\nown {k}\n{line.upper()}") for k in range(400)] + [(1000, "\n".join([line, "word " * 20] * 5000))]
    got = found(spark, rows, 8)
    assert got == plain(rows)
    assert sum(r[2] for r in got) == 800


@pytest.mark.parametrize("cut", [1, 2, 3, 5, 7])
def test_groups_over_any_partitions_and_batches(cut):
    rng = random.Random(cut)
    rows = []
    for key in range(9):
        for doc in rng.sample(range(30), rng.randint(1, 12)):
            for version in range(rng.choice([1, 1, 2])):
                rows += [(key, 0, 1, doc, version)] * rng.choice([1, 1, 3])
    rows.sort(key=lambda r: (r[0], -r[3], r[4]))
    expected = set()
    for key in range(9):
        docs = {r[3] for r in rows if r[0] == key}
        expected |= {(key, r[3], r[4]) for r in rows if r[0] == key and len(docs) >= 5 and r[3] != max(docs)}
    size = -(-len(rows) // (2 * cut + 1))
    out, ends = [], []
    for part, start in enumerate(range(0, len(rows), size)):
        chunk = rows[start:start + size]
        columns = list(zip(*chunk))
        batch = pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
             pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array([[r[0]] for r in chunk], pa.list_(pa.int32()))],
            names=["high", "low", "known", "doc", "version", "places"])
        pieces = [batch.slice(k, cut) for k in range(0, batch.num_rows, cut)]
        for made in ld._stream(iter(pieces), part, 5):
            for row in made.to_pylist():
                (ends.append((part, row["ends"])) if row["ends"] else out.append(row))
    verdicts = {(part, place): spares for part, place, spares in ld.across_partitions(ends, 5)}
    got = set()
    for row in out:
        key = (row["part"], row["place"])
        if row["place"] == 0 or (key in verdicts and not (verdicts[key] and row["leads"])):
            got.add((row["places"][0], row["doc"], row["version"]))
    assert got == expected


def test_bitmaps_and_whole_texts(spark):
    rows = texts(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in ld.without_repeats(docs).collect()}
    maps = {r["doc"]: bytes(r["bitmap"]) for r in ld.keep_bitmaps(docs).collect()}
    assert set(maps) == {doc for doc, row in kept.items() if row[2]}
    for doc, text in rows:
        assert kept[doc] == (lambda t: (t[0].decode(), *t[1:]))(ld.kept_lines(text.encode(), maps.get(doc)))


def test_without_broadcast(spark, monkeypatch):
    from recollect.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = texts(4, 60) + [(None, None)]
    assert found(spark, rows) == plain(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ld.keep_bitmaps(docs.withColumn("places", F.lit(0))).columns == ["known", "doc", "version", "bitmap"]
