"""Keyed state of many users: exact, in few accesses, and in parts that stay small."""

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.operators import metrics as M
from recollect.streaming import shards as ST
from recollect.streaming import user_scores as US


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Map(dict):
    accesses = 0

    def getValue(self, key):
        self.accesses += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.accesses += 1
        self[key] = value

    def removeKey(self, key):
        self.accesses += 1
        del self[key]


class Handle:
    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Map()


def one_bucket(n, bucket=5):
    uids = np.arange(-1000, 3000 * n)
    return uids[US.buckets_of(US.spread_uids(uids)) == bucket][:n]


def step(state, rows, bucket=5):
    """Rows out of one step of (uid, score, label, times)."""
    user = US.spread_uids(np.array([r[0] for r in rows]))
    key = US.sort_keys(np.array([r[1] for r in rows], float), np.zeros(len(rows), bool))
    label, times = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    counts = np.stack([user, key, (label == 1) * times, (label == 0) * times, times], axis=1)
    packed = [US.summed(half, 2).tobytes() for half in (counts[::2], counts[1::2]) if len(half)]
    return list(state.handleInputRows((bucket,), iter([pd.DataFrame({"counts": packed})]), None))


def brute(rows):
    """Sum of AUC times rows, and of rows, over users of both classes."""
    users = defaultdict(lambda: defaultdict(Counter))
    for uid, score, label, times in rows:
        users[uid][score][label] += times
    total = weight = 0
    for scores in users.values():
        p, n = (sum(c[label] for c in scores.values()) for label in (1, 0))
        if p and n:
            below = wins = 0
            for score in sorted(scores):
                wins += scores[score][1] * below
                below += scores[score][0]
            total += wins / (p * n) * (p + n)
            weight += p + n
    return total, weight


@pytest.mark.parametrize("slice_, part, users, times", [(3, 2, 5, 1), (7, 4, 40, 1), (20_000, 2048, 50, 1), (4, 3, 6, 2**33)])
def test_state_of_a_bucket_is_exact_over_all_steps(monkeypatch, slice_, part, users, times):
    monkeypatch.setattr(US, "SLICE", slice_)
    monkeypatch.setattr(US, "PART_SCORES", part)
    rng = np.random.default_rng(users)
    uids, seen, total, weight = one_bucket(users), [], 0.0, 0
    state = US.UserScores()
    state.init(Handle())
    for _ in range(10):
        rows = [
            (int(rng.choice(uids)), float(rng.integers(-4, 9)) / 8, int(rng.integers(0, 2)), int(rng.integers(1, 4)) * times)
            for _ in range(rng.integers(1, 50))
        ]
        seen += rows
        out = step(state, rows)
        total += sum(o.more_weighted_auc.sum() for o in out)
        weight += sum(int(o.more_impressions.sum()) for o in out)
        want = brute(seen)
        assert total == pytest.approx(want[0]) and weight == want[1]
        changes = [u for o in out for u, n in zip(o.uid, o.n) if n == 0]
        assert sorted(changes) == sorted({r[0] for r in rows})
        assert sum(int(o.n.sum()) for o in out) == sum(r[3] for r in rows)
    assert sum(n for n, *_ in state.blocks.values()) == state.shape.get()[1] == len({r[:2] for r in seen})
    assert max(n for n, *_ in state.blocks.values()) <= slice_


def test_users_share_calls_and_a_step_touches_only_its_own_parts(monkeypatch):
    monkeypatch.setattr(US, "PART_SCORES", 64)
    uids = one_bucket(600).tolist()
    state = US.UserScores()
    state.init(Handle())
    step(state, [(u, s / 4, s % 2, 1) for u in uids for s in range(4)])
    # A user's own access costs far more than its few scores.
    assert state.blocks.accesses < len(uids) / 4
    state.blocks.accesses, before = 0, dict(state.blocks)
    step(state, [(uids[0], 0.9, 1, 1)])
    assert state.blocks.accesses == 2
    assert sum(before.get(k) != v for k, v in state.blocks.items()) == 1


def test_rows_are_counted_by_bucket_before_the_shuffle():
    n = 5000
    batch = pa.RecordBatch.from_pydict({
        "uid": pa.array([None if i % 50 == 0 else i % 900 for i in range(n)], pa.int64()),
        "label": pa.array([None if i % 7 == 0 else i % 2 for i in range(n)], pa.int32()),
        "score": pa.array([None if i % 11 == 0 else (i % 13) / 13 for i in range(n)], pa.float64()),
    })
    want = Counter()
    for r in batch.to_pylist():
        for place, hit in enumerate((r["label"] == 1, r["label"] == 0, True)):
            want[r["uid"], r["score"], place] += hit
    got, buckets = Counter(), []
    for out in US.count_batches([batch.slice(0, 2000), batch.slice(2000, 0), batch.slice(2000)]):
        for row in out.to_pylist():
            buckets.append(row["bucket"])
            counts = np.frombuffer(row["counts"], np.int64).reshape(-1, 5)
            uids = [None] * len(counts) if row["bucket"] == US.NO_USER else US.uids_of(counts[:, 0]).tolist()
            for uid, score, values in zip(uids, US.scores_of(counts[:, 1]).to_pylist(), counts[:, 2:].tolist()):
                for place, value in enumerate(values):
                    got[uid, score, place] += value
    assert len(set(buckets)) == len(buckets) < 900
    assert +got == +want


def test_streamed_users_without_id_and_in_many_buckets(spark, tmp_path):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 40 != 0, F.hash("id") % 700).cast("bigint").alias("uid"),
        (F.hash(F.col("id") * 3) % 3 == 0).cast("int").alias("label"),
        (F.pmod(F.hash(F.col("id") * 7), F.lit(30)) / 30.0).alias("score"), F.floor(F.col("id") / 3000).alias("part"),
    )
    for part in range(2):
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ST.stream_shards(spark, f"{tmp_path}/in", rows.drop("part").schema)
    ST.run_step_metrics(stream, f"{tmp_path}/m", f"{tmp_path}/ck").awaitTermination()
    got = ST.accumulated_metrics(spark, f"{tmp_path}/m").orderBy("step").collect()
    assert [r.step for r in got] == [0, 1]
    for r in got:
        assert r.user_auc_so_far == pytest.approx(M.gauc(rows.where(F.col("part") <= r.step)).first().gauc)
