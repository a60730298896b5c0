import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recollect.operators import feed as FD


def shard_list(spark, n, rows=10):
    return spark.createDataFrame([(i, rows + i) for i in range(n)], "shard_no bigint, n_rows bigint")


@pytest.mark.parametrize("n", [7, 8, 9, 17])
def test_surplus_shards_go_unread(spark, n):
    plan = FD.plan_readers(shard_list(spark, n), world_size=8, num_workers=2, seed=42, epoch=3)
    rows = sorted(plan.collect(), key=lambda r: r.shard_no)
    used = n - n % 8
    for r in rows:
        assert r.used == (r.shard_no < used)
        if r.used:
            assert (r.rank, r.worker) == (r.shard_no % 8, r.shard_no // 8 % 2)
            assert r.seed == 42 + 300 + r.rank * 10 + r.worker
        else:
            assert r.rank is None and r.turn is None
    lost = FD.unread_rows(plan).first()
    assert (lost.shards_unread, lost.rows_unread) == (n - used, sum(10 + i for i in range(used, n)))


def test_turns_in_order_and_shuffled(spark):
    shards = shard_list(spark, 40)
    def turns(**more):
        plan = FD.plan_readers(shards, world_size=2, num_workers=2, **more).collect()
        return {(r.rank, r.worker, r.turn): r.shard_no for r in plan}
    ordered = turns()
    assert [ordered[0, 1, t] for t in range(10)] == list(range(2, 40, 4))
    a, b = turns(shuffle=True, epoch=0), turns(shuffle=True, epoch=1)
    assert a == turns(shuffle=True, epoch=0) and a != b and a.keys() == ordered.keys()
    assert sorted(a.values()) == sorted(ordered.values())


def test_batches_follow_shard_order(spark):
    rows = spark.range(103).select(F.col("id").alias("row_no"), F.floor(F.col("id") / 10).alias("shard_no"))
    rows = rows.withColumn("row_in_shard", F.col("row_no") % 10)
    plan = FD.plan_readers(FD.shard_sizes(rows), world_size=2, num_workers=2)
    got = FD.batches_in_order(rows, plan, 7).collect()
    readers = {}
    for shard in range(10):
        readers.setdefault((shard % 2, shard // 2 % 2), []).extend(range(shard * 10, shard * 10 + 10))
    want = {}
    for reader, ids in readers.items():
        for place, row in enumerate(ids[: len(ids) // 7 * 7]):
            want[row] = (*reader, place // 7, place)
    assert {r.row_no: (r.rank, r.worker, r.batch_id, r.place) for r in got} == want
    kept = FD.batches_in_order(rows, plan, 7, drop_last=False).count()
    assert kept == 100


def test_shuffled_batches_are_reproducible_and_complete(spark):
    rows = spark.range(400).select(F.col("id").alias("row_no"), F.floor(F.col("id") / 50).alias("shard_no"))

    def run(epoch):
        plan = FD.plan_readers(FD.shard_sizes(rows), world_size=2, num_workers=1, epoch=epoch, shuffle=True)
        out = FD.shuffled_batches(rows, plan, ["row_no"], 30).collect()
        return {r.row_no: (r.rank, r.batch_id, r.place) for r in out}

    first, again, other = run(0), run(0), run(1)
    assert first == again and first != other
    sizes = Counter(v[:2] for v in first.values())
    assert set(sizes.values()) == {30} and len(sizes) == 2 * (200 // 30)
    places = [p for _, p in sorted((v[2], k) for k, v in first.items() if v[0] == 0)]
    assert places != sorted(places)


@pytest.mark.parametrize("n", [5, 8, 16, 83])
def test_rebalance(spark, n):
    rows = spark.range(n).repartition(3)
    got = sorted((r.id, r.shard_no) for r in FD.rebalance(rows, ["id"], 8, 40).collect())
    each = n // 8
    want = [(i, 40 + (min(i // each, 8) if each else 0)) for i in range(n)]
    assert got == want
    sizes = Counter(s for _, s in got)
    if each:
        assert [sizes[40 + i] for i in range(8)] == [each] * 8 and sizes.get(48, 0) == n % 8


def test_rebalance_rejects_a_start_that_is_not_a_multiple(spark):
    with pytest.raises(ValueError):
        FD.rebalance(spark.range(3), ["id"], 8, 12)


def test_shard_numbers_and_totals(spark):
    numbered = FD.shard_numbers(spark.range(25).withColumnRenamed("id", "k"), ["k"], 10)
    assert {(r.k, r.row_no, r.shard_no) for r in numbered.collect()} == {(i, i, i // 10) for i in range(25)}
    totals = FD.shard_totals(numbered).first()
    assert (totals.total_rows, totals.num_shards) == (25, 3)
    assert FD.estimate_steps(25, 4, 2) == math.floor(25 / 8)


def drawn(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("buffer", [1, 7, 40, 1000])
def test_buffer_with_replacement(spark, buffer):
    rows = spark.range(403).select(F.col("id").alias("row_no"), F.floor(F.col("id") / 50).alias("shard_no"))
    rows = rows.withColumn("row_in_shard", F.col("row_no") % 50)
    plan = FD.plan_readers(FD.shard_sizes(rows), world_size=2, num_workers=2, epoch=1, shuffle=True)
    got = FD.buffered_batches(rows, plan, 30, buffer, drop_last=False).collect()
    streams = {}
    for r in sorted(plan.where("used").collect(), key=lambda r: r.turn):
        first = r.shard_no * 50
        streams.setdefault((r.rank, r.worker, r.seed), []).extend(range(first, first + r.n_rows))
    want = {}
    for (rank, worker, seed), stream in streams.items():
        slots, out = [], []
        for turn, row in enumerate(stream):
            if turn < buffer:
                slots.append(row)
                continue
            slot = int(drawn(seed, turn)[:8], 16) % buffer
            out.append(slots[slot])
            slots[slot] = row
        out += [slots[i] for i in sorted(range(len(slots)), key=lambda i: drawn(seed, i))]
        assert sorted(out) == sorted(stream)
        want.update({row: (rank, worker, place // 30, place) for place, row in enumerate(out)})
        for place, row in enumerate(out):
            assert place > stream.index(row) - buffer
        if buffer == 1:
            assert out == stream
    assert {r.row_no: (r.rank, r.worker, r.batch_id, r.place) for r in got} == want


def test_buffer_drops_the_last_rows_and_needs_a_size(spark):
    rows = spark.range(100).select(F.col("id").alias("row_in_shard"), F.lit(0).alias("shard_no"))
    plan = FD.plan_readers(FD.shard_sizes(rows))
    assert FD.buffered_batches(rows, plan, 30, 10).count() == 90
    with pytest.raises(ValueError):
        FD.buffered_batches(rows, plan, 30, 0)
