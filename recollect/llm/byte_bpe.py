"""Byte-level BPE encoding and decoding by replaying merges over a corpus of words."""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import bounded_batches, give_back_memory

# Bytes of text whose words are merged together, and bytes of encoded words that a task remembers.
CORPUS_BYTES = 3 << 19
MEMORY_BYTES = 16 << 20
# A single space between two other characters. No match of a usual pre-split pattern crosses it.
_GAP = re.compile(r" (?<=\S )(?=\S)")


class Merges:
    """Ranks of byte tokens, and the merge replay over a set of words.

    The rank of a pair is the rank of its joined bytes, so any split of a token may form it.
    """

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {
            base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())
        }
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.words_of = regex.compile(pattern).findall
        single = [bytes([k]) for k in range(256)]
        self.of_byte = np.array([self.ranks[k] for k in single], dtype=np.int64)
        self.of_two = np.array([self.ranks.get(a + b, -1) for a in single for b in single], dtype=np.int64)
        left, right, ranks = self._all_pairs()
        # Pairs by their left and by their right token: where a token's pairs begin, the other tokens, the ranks.
        self.pairs = self._by(left, right, ranks), self._by(right, left, ranks)
        # Tokens that form a pair whose rank is not above their own.
        self.early = {*left[ranks <= left].tolist(), *right[ranks <= right].tolist()}
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.bytes = 0

    def _all_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left and right token of every pair that forms a token, and its rank."""
        of = self.ranks
        lefts, rights, ranks = array("q"), array("q"), array("q")
        for token, rank in of.items():
            for k in range(1, len(token)):
                left, right = of.get(token[:k]), of.get(token[k:])
                if left is not None and right is not None:
                    lefts.append(left)
                    rights.append(right)
                    ranks.append(rank)
        return np.frombuffer(lefts, np.int64), np.frombuffer(rights, np.int64), np.frombuffer(ranks, np.int64)

    def _by(self, token: np.ndarray, other: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs ordered by ``token``, then ``other``, and where the pairs of every token begin."""
        order = np.lexsort((other, token))
        return np.searchsorted(token[order], np.arange(max(self.ranks.values()) + 2)), other[order], ranks[order]

    def _ranks(self, now: int, other: np.ndarray, leads: bool) -> np.ndarray:
        """Rank of the pair of token ``now`` with each of ``other``, -1 if they don't merge; ``now`` leads or follows."""
        begins, others, ranks = self.pairs[0 if leads else 1]
        start, stop = begins[now], begins[now + 1]
        if start == stop:
            return np.full(len(other), -1)
        keys = others[start:stop]
        at = np.minimum(keys.searchsorted(other), stop - start - 1)
        return np.where(keys[at] == other, ranks[start:stop][at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed token ids of every word; no word is empty.

        All words form one corpus of linked positions. ``places`` is the inverted index: it maps
        the rank of a pair to the positions where such a pair begins. Ranks are applied from the
        smallest, each to all its positions at once; a merge looks only at the two neighbours of
        the position it changed. Words don't touch, so for each of them this is the order
        "smallest rank first, then leftmost". Where a merge would make a pair that comes before
        the rest of its rank, only the leftmost position of each word is merged in that step.
        """
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(word) for word in words])
        starts = np.concatenate([[0], ends[:-1]])
        word_of = np.repeat(np.arange(len(words)), np.diff(np.append(starts, ends[-1])))
        token = np.append(self.of_byte[raw], -1)
        # Both ends have a spare position that no merge reaches: index -1 is "no neighbour".
        pair = np.append(self.of_two[raw[:-1] * 256 + raw[1:]], [-1, -1])
        pair[ends - 1] = -1
        after = np.append(np.arange(1, len(raw) + 1), -1)
        after[ends - 1] = -1
        before = np.append(np.arange(-1, len(raw) - 1), -1)
        before[starts] = -1
        begins = np.flatnonzero(pair >= 0)
        begins = begins[np.argsort(pair[begins], kind="stable")]
        queue, cuts = np.unique(pair[begins], return_index=True)
        places = {rank: [x] for rank, x in zip(queue.tolist(), np.split(begins, cuts[1:]))}
        queue = queue.tolist()
        while queue:
            now = heapq.heappop(queue)
            at = np.concatenate(places.pop(now))
            at = at[pair[at] == now]
            if not len(at):
                continue
            at.sort()
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            # In a run of overlapping pairs every second one merges, from the left.
            joined = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if joined.any():
                run = np.arange(len(at))
                at = at[(run - np.maximum.accumulate(np.where(joined, 0, run))) % 2 == 0]
            right, left = after[after[at]], before[at]
            if now in self.early:
                made_right, made_left = self._made(now, token, left, right)
            if now in self.early and (
                ((made_right >= 0) & (made_right <= now)).any() or ((made_left >= 0) & (made_left <= now)).any()
                or 0 <= int(self._ranks(now, np.array([now]), True)[0]) <= now
            ):
                kept = np.concatenate([[True], word_of[at[1:]] != word_of[at[:-1]]])
                rest = at[~kept]
                at, right, left = at[kept], right[kept], left[kept]
                self._add(places, queue, np.full(len(rest), now), rest)
            gone = after[at]
            token[at], token[gone] = now, -1
            pair[gone] = -1
            after[at] = right
            before[right[right >= 0]] = at[right >= 0]
            left = before[at]  # the neighbour may have been merged in the same step
            made_right, made_left = self._made(now, token, left, right)
            pair[at] = made_right
            has_left = left >= 0
            pair[left[has_left]] = made_left[has_left]
            made, where = np.concatenate([made_right, made_left]), np.concatenate([at, left])
            self._add(places, queue, made[made >= 0], where[made >= 0])
        whole = token >= 0
        packed = token[whole].astype("<u4").tobytes()
        stops = 4 * np.cumsum(np.add.reduceat(whole[:-1].astype(np.int64), starts))
        return [packed[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def _made(
        self, now: int, token: np.ndarray, left: np.ndarray, right: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs that token ``now`` forms with its right and its left neighbours."""
        # Place -1, no neighbour, holds no token.
        return self._ranks(now, token[right], True), self._ranks(now, token[left], False)

    @staticmethod
    def _add(places: dict[int, list[np.ndarray]], queue: list[int], ranks: np.ndarray, where: np.ndarray) -> None:
        """Enter positions in the index under the ranks of their pairs."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, where = ranks[order], where[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[[0, *cuts]].tolist(), np.split(where, cuts) if len(cuts) else [where]):
            if rank in places:
                places[rank].append(part)
            else:
                places[rank] = [part]
                heapq.heappush(queue, rank)

    def _learn(self, chunks: set[str], heads: set[str]) -> dict[str, bytes]:
        """Encode unknown chunks of text, each with the space before it, and the words ``heads``, all as one corpus.

        Returns the ids of ``heads``, which are not remembered.
        """
        spaced, words, ranks = self.spaced, self.words, self.ranks
        # A chunk of letters is one word; others are split. Words with a space are kept as chunks.
        fresh: dict[str, bytes] = {}
        fresh_words: dict[str, bytes] = {}
        fresh_heads: dict[str, bytes] = {}
        split = {}
        first = {}
        for chunk in chunks:
            if chunk.isalpha():
                raw = f" {chunk}".encode()
                if raw in ranks:
                    spaced[chunk] = ranks[raw].to_bytes(4, "little")
                else:
                    fresh[chunk] = raw
            else:
                split[chunk] = [(True, w[1:]) if w[0] == " " else (False, w) for w in self.words_of(f" {chunk}")]
        for found in split.values():
            for has_space, text in found:
                known, new = (spaced, fresh) if has_space else (words, fresh_words)
                if text not in new and text not in known:
                    raw = (f" {text}" if has_space else text).encode()
                    if raw in ranks:
                        known[text] = ranks[raw].to_bytes(4, "little")
                    else:
                        new[text] = raw
        for text in heads:
            raw = text.encode()
            if raw in ranks:
                first[text] = ranks[raw].to_bytes(4, "little")
            else:
                fresh_heads[text] = raw
        done = iter(self.replay([*fresh.values(), *fresh_words.values(), *fresh_heads.values()]))
        for known, new in ((spaced, fresh), (words, fresh_words), (first, fresh_heads)):
            known.update(zip(new, done))
        for chunk, found in split.items():
            spaced[chunk] = b"".join([(spaced if has_space else words)[text] for has_space, text in found])
        return first

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; the words of all texts are merged together."""
        split = [_GAP.split(text or "") for text in texts]
        if self.bytes > MEMORY_BYTES:
            self.forget()
        fresh = set()
        for chunks in split:
            fresh.update(chunks[1:])
        fresh.difference_update(self.spaced)
        # No space precedes the first chunk of a text.
        found = {head: self.words_of(head) for head in {chunks[0] for chunks in split}}
        ids = self._learn(fresh, {word for words in found.values() for word in words})
        # A chunk is remembered as text and as ids; its words may be, too.
        self.bytes += 2 * sum(map(len, fresh)) + 160 * len(fresh)
        heads = {head: b"".join([ids[word] for word in words]) for head, words in found.items()}
        known = self.spaced.__getitem__
        return [heads[chunks[0]] + b"".join(map(known, chunks[1:])) for chunks in split]

    def forget(self) -> None:
        """Drop the remembered words; a worker outlives its task and shouldn't hold them."""
        self.spaced.clear()
        self.words.clear()
        self.bytes = 0

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def _merges(rank_file: bytes, pattern: str) -> Merges:
    return Merges(rank_file, pattern)


def _mapped(df: DataFrame, column: Column, keep: list[str], out: list[str], work, forget) -> DataFrame:
    """``keep`` columns of ``df`` and binary columns ``out``, which ``work`` makes of some values.

    ``forget`` is called when a task ends.
    """
    kept = [F.col(name).alias(f"_k{i}") for i, name in enumerate(keep)]
    source = df.select(*kept, column.alias("_in"))
    made = [T.StructField(f"_o{i}", T.BinaryType()) for i in range(len(out))]
    schema = T.StructType([*source.schema.fields[:-1], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            start = 0
            for stop in _cuts(whole.column(len(keep))):
                batch = whole.slice(start, stop - start)
                columns = [pa.array(x, pa.binary()) for x in work(batch.column(len(keep)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)
                start = stop
        forget()
        give_back_memory()

    done = bounded_batches(source).mapInArrow(run, schema)
    return done.select(
        *[F.col(f"_k{i}").alias(name) for i, name in enumerate(keep)],
        *[F.col(f"_o{i}").alias(name) for i, name in enumerate(out)],
    )


def _cuts(values: pa.Array) -> list[int]:
    """Ends of runs of rows that hold about CORPUS_BYTES each."""
    sizes = np.nan_to_num(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(float))
    part = np.cumsum(sizes) // CORPUS_BYTES
    ends = np.flatnonzero(np.diff(part) > 0) + 1
    return [*ends.tolist(), len(values)] if len(values) else []


def _shared(df: DataFrame, rank_path: str):
    with open(rank_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(
    df: DataFrame, text: str, rank_path: str, pattern: str, keep: list[str], ids: str = "ids",
    decoded: str | None = None,
) -> DataFrame:
    """Columns ``keep`` and binary ``ids``: the token ids as little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is encoded on its own, as the public library does: a word that is a
    token stays whole, any other is merged by rank. No special tokens. A task merges each distinct
    word of its texts once and keeps the results for the texts that follow; nothing is shuffled,
    so a hot source or copy costs no more than other rows. Null counts as the empty text, which
    has no ids. The rank file is read by the driver; its size does not depend on the data. With
    ``decoded`` the ids are decoded again in the same pass, into that column.
    """
    shared = _shared(df, rank_path)

    def work(texts: list[str | None]) -> list[list[bytes]]:
        merges = _merges(shared.value, pattern)
        packed = merges.encode(texts)
        return [packed, [merges.decode(x) for x in packed]] if decoded else [packed]

    return _mapped(df, F.col(text), keep, [ids, decoded] if decoded else [ids], work, lambda: _merges(shared.value, pattern).forget())


def decode(
    df: DataFrame, ids: str, rank_path: str, keep: list[str], out: str = "decoded"
) -> DataFrame:
    """Columns ``keep`` and binary ``out``: the bytes of the tokens in ``ids``; null gives no bytes."""
    shared = _shared(df, rank_path)

    def work(values: list[bytes | None]) -> list[list[bytes]]:
        merges = _merges(shared.value, "")
        return [[merges.decode(packed or b"") for packed in values]]

    return _mapped(df, F.col(ids), keep, [out], work, lambda: None)


def encode_digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the packed ids and of the bytes decoded from them."""
    encoded = encode(docs, "text", rank_path, pattern, ["doc_id"], decoded="decoded")
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
