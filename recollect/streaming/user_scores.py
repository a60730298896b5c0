"""Keyed state that keeps every user's ranking exact while scores keep arriving."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The code travels to the executors by value; they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTS_SCHEMA = "bucket int, counts binary"
RESULT_SCHEMA = (
    "uid bigint, score double, pos bigint, neg bigint, n bigint, "
    "more_weighted_auc double, more_impressions bigint"
)
# Scores that are held in memory at a time.
SLICE = 20_000
# Scores that a part of a bucket's state has on average before the parts are halved.
PART_SCORES = 2048
# Rows of a step that one task counts before it passes them on.
HELD_ROWS = 200_000
# Fixed value: the users of a stream are dealt into 2^10 buckets, by which its state is laid out.
BUCKET_BITS = 10
# Fixed value: the bucket of the rows without a user.
NO_USER = 1 << BUCKET_BITS
_NULL_KEY = np.iinfo(np.int64).min
_LOW_BITS = np.int64(np.iinfo(np.int64).max)
_SIGN = np.uint64(1 << 63)
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
# A product of counts up to this needs no more than 64 bits.
_SAFE = float(1 << 62)


def sort_keys(scores: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Integers in the order of the scores: a missing score first, NaN last, both zeros equal."""
    plain = np.where(np.isnan(scores), np.nan, scores + 0.0)
    bits = plain.view(np.int64)
    return np.where(missing, _NULL_KEY, np.where(bits < 0, bits ^ _LOW_BITS, bits))


def scores_of(keys: np.ndarray) -> pa.Array:
    """Inverse of :func:`sort_keys`."""
    bits = np.where(keys < 0, keys ^ _LOW_BITS, keys)
    missing = keys == _NULL_KEY
    return pa.array(np.where(missing, 0, bits).view(np.float64), mask=missing)


def spread_uids(uids: np.ndarray) -> np.ndarray:
    """Evenly spread integers, one for each user id: their order is the order of the state."""
    h = uids.astype(np.int64).view(np.uint64)
    for factor in _MIX:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(33)) ^ _SIGN).view(np.int64)


def uids_of(users: np.ndarray) -> np.ndarray:
    """Inverse of :func:`spread_uids`."""
    h = users.astype(np.int64).view(np.uint64) ^ _SIGN
    for factor in reversed(_MIX):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(pow(factor, -1, 1 << 64))
    return (h ^ (h >> np.uint64(33))).view(np.int64)


def buckets_of(users: np.ndarray) -> np.ndarray:
    return ((users.view(np.uint64) ^ _SIGN) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def parts_of(users: np.ndarray, depth: int) -> np.ndarray:
    """Number of each user's part of a bucket with 2^depth parts; no two depths share a number."""
    rest = (users.view(np.uint64) ^ _SIGN) << np.uint64(BUCKET_BITS)
    return ((rest >> np.uint64(1)) >> np.uint64(63 - depth)).astype(np.int64) | (1 << depth)


def summed(rows: np.ndarray, keys: int) -> np.ndarray:
    """Rows sorted by their first ``keys`` columns, equal ones as one with the other columns added up."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort([rows[:, c] for c in reversed(range(keys))])]
    first = np.append(True, (rows[1:, :keys] != rows[:-1, :keys]).any(axis=1))
    out = rows[first]
    out[:, keys:] = np.add.reduceat(rows[:, keys:], np.flatnonzero(first), axis=0)
    return out


def count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, rows of user, sort key, pos, neg, n): what crosses the shuffle instead of the rows."""
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        rows = summed(np.concatenate(held), 3)
        ends = np.append(np.flatnonzero(np.diff(rows[:, 0])) + 1, len(rows))
        begins = np.append(0, ends[:-1])
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array(rows[begins, 0], pa.int32()),
            "counts": pa.array([rows[a:b, 1:].tobytes() for a, b in zip(begins, ends)], pa.binary()),
        })

    for batch in batches:
        if not batch.num_rows:
            continue
        score = batch.column("score").cast(pa.float64())
        keys = sort_keys(
            np.array(pc.fill_null(score, 0.0).to_numpy(zero_copy_only=False)),
            pc.is_null(score).to_numpy(zero_copy_only=False),
        )
        label = pc.fill_null(batch.column("label").cast(pa.int64()), -1).to_numpy()
        uid = batch.column("uid")
        users = spread_uids(pc.fill_null(uid, 0).to_numpy())
        buckets = np.where(pc.is_null(uid).to_numpy(zero_copy_only=False), NO_USER, buckets_of(users))
        held.append(np.stack([buckets, users, keys, label == 1, label == 0, np.ones_like(keys)], axis=1))
        size += len(keys)
        if size >= HELD_ROWS:
            yield packed()
            held, size = [], 0
    if held:
        yield packed()


def _place_above(rows: np.ndarray, last: np.ndarray, keys: int) -> int:
    """Number of sorted ``rows`` that do not come after ``last``."""
    low, high = 0, len(rows)
    for c in range(keys):
        column = rows[low:high, c]
        low, high = low + np.searchsorted(column, last[c], "left"), low + np.searchsorted(column, last[c], "right")
    return int(high)


def merge(old: Iterator[np.ndarray], new: np.ndarray, keys: int = 1) -> Iterator[np.ndarray]:
    """Sorted rows in blocks, and further sorted rows, as one list: a slice at a time, equal keys added up.

    The first ``keys`` columns are the key.
    """
    while True:
        taken, size = [new[:0]], 0
        while size < SLICE and (block := next(old, None)) is not None:
            taken.append(np.atleast_2d(np.asarray(block, np.int64)))
            size += len(taken[-1])
        kept = np.concatenate(taken)
        # Past the stored scores the rest of the new ones follows, in slices too.
        upto = _place_above(new, kept[-1], keys) if len(kept) else min(len(new), SLICE)
        both, new = np.concatenate([kept, new[:upto]]), new[upto:]
        if not len(both):
            return
        yield summed(both, keys)


def _tally(starts: np.ndarray, pos: np.ndarray, neg: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """(pos, neg, wins) of each user in a slice; ``open_`` is what the first one has from earlier slices."""
    sizes = np.diff(np.append(starts, len(pos)))
    upto = np.cumsum(neg) - neg
    below = upto - np.repeat(upto[starts], sizes)
    below[:sizes[0]] += int(open_[1])
    # Pairs may be more than 64 bits hold; Python integers hold them.
    won = pos * below if float(pos.sum()) * float(below.max()) < _SAFE else pos.astype(object) * below
    sums = np.stack([np.add.reduceat(x, starts).astype(object) for x in (pos, neg, won)], axis=1)
    sums[0] += open_
    return sums


def _weighted_auc(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """AUC times rows, and rows, of users with (pos, neg, wins); 0 for a user of one class."""
    pairs = sums[:, 0] * sums[:, 1]
    both = pairs > 0
    rows = np.where(both, sums[:, 0] + sums[:, 1], 0)
    weighted = np.zeros(len(sums))
    weighted[both] = (sums[both, 2] / pairs[both] * rows[both]).astype(np.float64)
    return weighted, rows.astype(np.int64)


def changes(slices: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(users, change of AUC times rows, change of rows) of sorted (user, key, pos, neg, pos before, neg before).

    A user may go on over any number of slices.
    """
    none = np.zeros(3, object)
    last, now, before = None, none, none

    def change(users, now, before):
        (auc, rows), (auc_before, rows_before) = _weighted_auc(now), _weighted_auc(before)
        return users, auc - auc_before, rows - rows_before

    for piece in slices:
        users = piece[:, 0]
        if last is not None and users[0] != last:
            yield change(np.array([last]), now[None], before[None])
            now, before = none, none
        starts = np.append(0, np.flatnonzero(np.diff(users)) + 1)
        sums = _tally(starts, piece[:, 2], piece[:, 3], now), _tally(starts, piece[:, 4], piece[:, 5], before)
        if len(starts) > 1:
            yield change(users[starts[:-1]], sums[0][:-1], sums[1][:-1])
        last, now, before = users[-1], sums[0][-1], sums[1][-1]
    if last is not None:
        yield change(np.array([last]), now[None], before[None])


class UserScores(StatefulProcessor):
    """Count every user's scores over all steps and say by how much the users' AUC sums changed.

    The key is a bucket of users, as a call and each access to the state cost far more than the few
    scores that a user has. A bucket's state is cut into parts, runs of users in spread order, and a
    step reads and writes only the parts of its own users; when parts get large they are halved. A
    part is a sorted list in blocks, merged a slice at a time, so memory holds a few slices and
    the bucket's own counts of the step however many scores a user has. The rows out are the step's counts
    per user and score, and for each of its users one row without counts that has the change of
    (AUC times rows) and of rows; it is 0 while a user has one class only.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shape = handle.getValueState("shape", "depth int, scores bigint")
        # Block 0 of a part says how many more there are; these lie at 1, 2.. if side is 1, else at -1, -2..
        self.blocks = handle.getMapState(
            "blocks", "part bigint, place int", "n bigint, more int, side int, data binary"
        )

    def _block(self, part: int, place: int) -> tuple[np.ndarray, int, int]:
        """Rows of a block as (user, key, pos, neg, pos, neg), its ``more`` and ``side``."""
        found = self.blocks.getValue((part, place))
        if found is None:
            return np.zeros((0, 6), np.int64), 0, -1
        n, more, side, data = found
        rows = np.frombuffer(pa.decompress(bytes(data), 32 * n, "zstd", asbytes=True), np.int64)
        return rows.reshape(4, n).T[:, [0, 1, 2, 3, 2, 3]], more, side

    def _put(self, part: int, place: int, rows: np.ndarray, more: int = 0, side: int = 0) -> None:
        data = pa.compress(np.ascontiguousarray(rows[:, :4].T).tobytes(), "zstd", asbytes=True)
        self.blocks.updateValue((part, place), (len(rows), more, side, data))

    def _read(self, parts: Iterable[int], moved: bool) -> Iterator[np.ndarray]:
        """Blocks of parts, in order. Those that are not overwritten at the end are removed."""
        for part in parts:
            rows, more, side = self._block(part, 0)
            self.sides[part] = side
            self.scores -= len(rows)
            if moved and len(rows):
                self.blocks.removeKey((part, 0))
            yield rows
            for place in range(side, side * (more + 1), side):
                rows = self._block(part, place)[0]
                self.scores -= len(rows)
                self.blocks.removeKey((part, place))
                yield rows

    def _write(self, slices: Iterable[np.ndarray], depth: int) -> Iterator[np.ndarray]:
        """Pass slices on and store them by parts."""
        part, first, rest, more = None, None, None, 0

        def end() -> None:
            if part is not None:
                if len(rest):
                    self._put(part, side * (more + 1), rest)
                self._put(part, 0, first, more + (len(rest) > 0), side)

        for piece in slices:
            self.scores += len(piece)
            parts = parts_of(np.ascontiguousarray(piece[:, 0]), depth)
            for rows in np.split(piece, np.flatnonzero(np.diff(parts)) + 1):
                own = int(parts_of(rows[:1, 0].copy(), depth)[0])
                if own != part:
                    end()
                    # The other side than the one that is still being read.
                    part, side, more = own, -self.sides.pop(own, -1), 0
                    first, rows = rows[:SLICE], rows[SLICE:]
                    rest = rows[:0]
                rest = np.concatenate([rest, rows])
                while len(rest) >= SLICE:
                    more += 1
                    self._put(part, side * more, rest[:SLICE])
                    rest = rest[SLICE:]
            yield piece
        end()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        packed = [np.frombuffer(data, np.int64).reshape(-1, 5) for part in rows for data in part["counts"]]
        counts = summed(np.concatenate(packed), 2)
        depth, self.scores = self.shape.get() if self.shape.exists() else (0, 0)
        deeper = depth
        while self.scores + len(counts) > PART_SCORES << deeper:
            deeper += 1
        moved, self.sides = deeper > depth, {}
        touched = np.unique(counts[:, 0])
        parts = range(1 << depth, 2 << depth) if moved else np.unique(parts_of(touched, depth)).tolist()
        new = np.pad(counts[:, :4], ((0, 0), (0, 2)))
        merged = merge(self._read(parts, moved), new, 2)
        ready, size = [], 0
        for users, auc, seen in changes(self._write(merged, deeper)):
            own = np.isin(users, touched, assume_unique=True)
            ready.append((users[own], auc[own], seen[own]))
            size += len(ready[-1][0])
            if size >= SLICE:
                yield self._rows_out(key[0], *map(np.concatenate, zip(*ready)))
                ready, size = [], 0
        if size:
            yield self._rows_out(key[0], *map(np.concatenate, zip(*ready)))
        self.shape.update((deeper, self.scores))
        for start in range(0, len(counts), SLICE):
            part = counts[start:start + SLICE]
            yield self._rows_out(key[0], part[:, 0], 0.0, 0, part)

    def _rows_out(self, bucket: int, users, auc, seen, counts: np.ndarray | None = None) -> pd.DataFrame:
        uid = pd.array([None] * len(users), "Int64") if bucket == NO_USER else uids_of(users)
        out = {"uid": uid, "score": None, "pos": 0, "neg": 0, "n": 0}
        if counts is not None:
            out["score"] = scores_of(counts[:, 1]).to_pandas()
            out.update(zip(("pos", "neg", "n"), counts[:, 2:].T))
        return pd.DataFrame(out | {"more_weighted_auc": auc, "more_impressions": seen})

    def close(self) -> None:
        pass


def counted_users(scores: DataFrame) -> DataFrame:
    """Stream of (uid, label, score) as counts per step and changes of every user's AUC sums."""
    counts = scores.select("uid", "label", "score").mapInArrow(count_batches, COUNTS_SCHEMA)
    return counts.groupBy("bucket").transformWithStateInPandas(UserScores(), RESULT_SCHEMA, "Update", "None")
