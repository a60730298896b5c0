"""Collocations: phrases counted level by level as pairs of ranked units, in dense and in sparse tiles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import SLICE_BYTES, bounded_batches, give_back_memory, slices
from recollect.operators.skew import lookup_join
from recollect.operators.staging import scope, stage

# Occurrences that a phrase needs, words of the longest one, and phrases returned per language.
LEAST_COUNT = 30
LONGEST = 4
REPORTED = 2000
# Units (words, or phrases that may grow) that every task knows by their rank, and the most bytes
# that one and its language may have; their product bounds what is broadcast.
RANKED, RANKED_BYTES = 1 << 16, 96
# Bits of the filter by which a task passes over units that aren't frequent. It is as long as
# sixteen times their number, within these bounds; too short a filter only lets more pairs through.
FILTER_BITS = (1 << 16, 1 << 27)
# Units along one side of a tile, and the occurrences from which it is counted densely.
TILE = 256
DENSE = TILE * TILE // 8
# Words that a task counts together, and bytes of words without a rank that it remembers.
FLUSH_WORDS = 3_000_000
MEMORY_BYTES = 64 << 20
SLICE_ROWS = 50_000
UNDEFINED = "und"
_BREAK = b"\xff"  # occurs in no UTF-8 text
_MAP = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _BREAK * 10
)
_ODD, _FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_ALL, _TAIL = (1 << 64) - 1, (1 << 32) - 1


def words_of(text: bytes) -> pa.DictionaryArray:
    """Lower-cased words of a text, with a break as a word of its own between the pieces it falls into."""
    raw = np.frombuffer(text.translate(_MAP), np.uint8)
    blank, cut = raw == 32, raw == 255
    begins = cut.copy()
    begins[:1] = True
    begins[1:] |= blank[:-1] | cut[:-1]
    starts = np.flatnonzero(begins[~blank]).astype(np.int32)
    letters = raw[~blank]
    offsets = np.append(starts, np.int32(len(letters)))
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return found.dictionary_encode()


def extended(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases followed by a word, from the hashes of both."""
    mixed = (phrase * _ODD) ^ (word + (phrase >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _FACTOR
    return mixed ^ (mixed >> np.uint64(30))


@lru_cache(maxsize=4096)
def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang)


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=_seed(lang))


def phrase_hash(lang: str, phrase: bytes) -> int:
    """The hash that ``extended`` gives word by word."""
    words = [word_hash(lang, word) for word in phrase.split(b" ")]
    found = words[0]
    for word in words[1:]:
        mixed = (found * int(_ODD) ^ word + (found >> 29)) & _ALL
        mixed = (mixed ^ mixed >> 31) * int(_FACTOR) & _ALL
        found = mixed ^ mixed >> 30
    return found


@dataclass
class Level:
    """Frequent phrases of one length: those with a rank, by falling count, and a filter of all."""

    ranked: list[tuple[str, bytes]]
    filter: np.ndarray

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes % np.uint64(64 * len(self.filter))
        return (self.filter[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


class _Words(dict):
    """Ids of one language's words; 0 for a break and for words that can't be part of a frequent phrase."""

    def __init__(self, counter: PhraseCounter, lang: str):
        super().__init__({_BREAK: 0})
        self.counter, self.lang = counter, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.counter.new_word(self.lang, word)
        return number


class PhraseCounter:
    """Counts phrases with one word more than the deepest level given, in runs of texts.

    Ids of a level begin at 1 in the order of its ranks; units without a rank get ids behind them,
    valid until the counter forgets its words or, for phrases, within one count.
    """

    def __init__(self, levels: list[Level]):
        self.levels = levels
        self.filter = memoryview(levels[0].filter) if levels else None
        places = [{unit: k + 1 for k, unit in enumerate(level.ranked)} for level in levels]
        self.pairs, self.hashes = [], []
        for depth, level in enumerate(levels):
            self.hashes.append(np.array([0, *(phrase_hash(*unit) for unit in level.ranked)], np.uint64))
            # Pairs of ranked units that make a ranked one, sorted.
            found = []
            for k, (lang, phrase) in enumerate(level.ranked if depth else []):
                head, _, word = phrase.rpartition(b" ")
                a, b = places[depth - 1].get((lang, head)), places[0].get((lang, word))
                if a and b:
                    found.append((a << 32 | b, k + 1))
            table = np.array(sorted(found), np.int64).reshape(-1, 2)
            self.pairs.append((np.append(table[:, 0], -1), np.append(table[:, 1], 0)))
        self.forget()

    def forget(self) -> None:
        """Keep only the words with a rank."""
        ranked = self.levels[0].ranked if self.levels else []
        self.words: dict[str, _Words] = {}
        self.langs, self.names = ["", *(lang for lang, _ in ranked)], [b"", *(word for _, word in ranked)]
        self.fresh: list[int] = []
        self.bytes = 0
        for k, (lang, word) in enumerate(ranked):
            self.of(lang)[word] = k + 1
        self.sequence: list[np.ndarray] = []
        self.length = 0

    def of(self, lang: str) -> _Words:
        return self.words.get(lang) or self.words.setdefault(lang, _Words(self, lang))

    def new_word(self, lang: str, word: bytes) -> int:
        self.bytes += len(word) + 100
        if self.levels:
            hashed = word_hash(lang, word)
            place = hashed % (64 * len(self.filter))
            if not self.filter[place >> 6] >> (place & 63) & 1:
                return 0
            self.fresh.append(hashed)
        self.langs.append(lang)
        self.names.append(word)
        return len(self.names) - 1

    def add(self, lang: str, text: bytes) -> None:
        """Append a text, or several with a break between them."""
        found = words_of(text)
        _, ends, letters = found.dictionary.buffers()
        ends, letters = np.frombuffer(ends, np.int32)[:len(found.dictionary) + 1].tolist(), letters.to_pybytes()
        distinct = [letters[a:b] for a, b in zip(ends, ends[1:])]
        ids = np.fromiter(map(self.of(lang).__getitem__, distinct), np.int64, len(distinct))
        self.sequence.append(ids[found.indices.to_numpy()])
        self.sequence.append(np.zeros(1, np.int64))
        self.length += len(found) + 1

    def counts(self) -> Iterator[tuple[list[str], list[bytes | None], np.ndarray]]:
        """Language, phrase and occurrences of what was added since the last call, in slices.

        Single words come with the number of all words of each language, under no phrase.
        """
        words = np.concatenate([*self.sequence, np.zeros(1, np.int64)])
        self.sequence, self.length = [], 0
        if not self.levels:
            times = np.bincount(words, minlength=len(self.names))
            keys = np.flatnonzero(times)
            keys = keys[keys > 0]
            times = times[keys]
            found: Counter[str] = Counter()
            for k, n in zip(keys.tolist(), times.tolist()):
                found[self.langs[k]] += n
            yield [*found], [None] * len(found), np.array([*found.values()], np.int64)
            names = []
        else:
            keys, times, names = self._phrases(words)
        del words
        for k in range(0, len(keys), SLICE_ROWS):
            part = keys[k:k + SLICE_ROWS]
            langs = [self.langs[k] for k in (part & _TAIL).tolist()]
            phrases = self._joined(part, names) if self.levels else [self.names[k] for k in part.tolist()]
            yield langs, phrases, times[k:k + SLICE_ROWS]
        if self.bytes > MEMORY_BYTES:
            self.forget()

    def _phrases(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Pairs of a unit and the word behind it, their occurrences, and the names of the units."""
        word_hashes = np.concatenate([self.hashes[0], np.array(self.fresh, np.uint64)])
        units, hashes, names = words, word_hashes, self.names
        for depth in range(1, len(self.levels)):
            at, heads, tails = _neighbours(units, words, depth)
            keys, back = np.unique(heads << 32 | tails, return_inverse=True)
            level = self.levels[depth]
            known, numbers = self.pairs[depth]
            place = np.searchsorted(known[:-1], keys)
            number = np.where(known[place] == keys, numbers[place], 0)
            made = extended(hashes[keys >> 32], word_hashes[keys & _TAIL])
            new = np.flatnonzero((number == 0) & level.may_have(made))
            number[new] = len(level.ranked) + 1 + np.arange(len(new))
            hashes = np.concatenate([self.hashes[depth], made[new]])
            names = [b"", *(phrase for _, phrase in level.ranked), *self._joined(keys[new], names)]
            units = np.zeros(len(words), np.int64)
            units[at] = number[back]
        _, heads, tails = _neighbours(units, words, len(self.levels))
        return *count_pairs(heads, tails, len(self.levels[-1].ranked), len(self.levels[0].ranked)), names

    def _joined(self, keys: np.ndarray, names: list[bytes]) -> list[bytes]:
        words = self.names
        return [names[a] + b" " + words[b] for a, b in zip((keys >> 32).tolist(), (keys & _TAIL).tolist())]


def _neighbours(units: np.ndarray, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a unit of ``length`` words and the one a word later are both frequent; unit and next word.

    A phrase can't be more frequent than the phrases in it, so all frequent ones are among these.
    """
    at = np.flatnonzero((units[:-1] > 0) & (units[1:] > 0))
    return at, units[at], words[at + length]


def count_pairs(heads: np.ndarray, tails: np.ndarray, ranked_heads: int, ranked_tails: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, as head << 32 | tail, and how often each occurs.

    Ids up to the two limits are ranks. Pairs of ranks lie in square tiles; a tile with DENSE
    pairs or more is counted by direct address. All other pairs are sorted.
    """
    direct = (heads <= ranked_heads) & (tails <= ranked_tails)
    across = ranked_tails // TILE + 1
    tile = np.where(direct, heads // TILE * across + tails // TILE, 0)
    direct &= (np.bincount(tile[direct], minlength=1) >= DENSE)[np.minimum(tile, tile[direct].max(initial=0))]
    keys, times = np.unique(heads[~direct] << 32 | tails[~direct], return_counts=True)
    found = [(keys, times)]
    order = np.flatnonzero(direct)
    order = order[np.argsort(tile[order], kind="stable")]
    numbers, starts = np.unique(tile[order], return_index=True)
    for number, part in zip(numbers.tolist(), np.split(order, starts[1:]) if len(numbers) else []):
        cells = np.bincount(heads[part] % TILE * TILE + tails[part] % TILE, minlength=TILE * TILE)
        at = np.flatnonzero(cells)
        row, column = number // across * TILE + at // TILE, number % across * TILE + at % TILE
        found.append((row << 32 | column, cells[at]))
    return np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])


def _counted(texts: DataFrame, levels: list[Level]) -> DataFrame:
    """Columns lang, phrase, n of all phrases one word longer than ``levels`` may know; null phrase: all words."""
    shared: Broadcast = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PhraseCounter(shared.value)

        def flush() -> Iterator[pa.RecordBatch]:
            for langs, phrases, times in counter.counts():
                yield pa.RecordBatch.from_arrays([
                    pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(times, pa.int64()),
                ], names=["lang", "phrase", "n"])

        for whole in batches:
            for batch in slices(whole, 1, 2 * SLICE_BYTES):
                texts_of: dict[str, list[bytes]] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    texts_of.setdefault(lang, []).append(text)
                for lang, found in texts_of.items():
                    counter.add(lang, _BREAK.join(found))
                    if counter.length >= FLUSH_WORDS:
                        yield from flush()
        if counter.length:
            yield from flush()
        give_back_memory()

    parts = bounded_batches(texts).mapInArrow(run, "lang string, phrase binary, n long")
    return parts.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))


def _level(frequent: DataFrame) -> Level:
    """What tasks need to know of a staged table of frequent phrases; its size has a bound."""
    count = frequent.count()
    bits = min(max(1 << max(16 * count - 1, 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    short = F.octet_length("lang") + F.octet_length("phrase") <= RANKED_BYTES
    top = frequent.where(short).orderBy(F.desc("n"), "lang", "phrase").limit(RANKED).select("lang", "phrase").collect()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [phrase_hash(lang, p.encode()) % bits for lang, p in zip(*(c.to_pylist() for c in batch.columns))]
            place = np.array(hashes, np.uint64)
            yield pa.RecordBatch.from_arrays([
                pa.array((place >> np.uint64(6)).astype(np.int64)),
                pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64)),
            ], names=["place", "bits"])

    words = frequent.select("lang", "phrase").mapInArrow(run, "place long, bits long")
    found = words.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Level([(row["lang"], row["phrase"].encode()) for row in top], table)


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, longest: int = LONGEST) -> DataFrame:
    """Columns lang, phrase, words, n: every phrase of up to ``longest`` words that occurs ``least`` times.

    The row with no phrase has the number of all words of its language. Each length reads the texts
    once. Tasks add up the pairs of a unit and the word behind it before they are summed by key, so
    a common phrase is one row per task. Frequent pairs are ranked and are the units of the next length.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNDEFINED)).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    with scope() as keep:
        levels: list[Level] = []
        tables: list[DataFrame] = []
        for words in range(1, longest + 1):
            counted = _counted(texts, levels)
            counted = counted.where((F.col("n") >= least) | F.col("phrase").isNull())
            table = stage(counted.select("lang", "phrase", F.lit(words).alias("words"), "n"), "phrases")
            tables.append(table)
            if words < longest:
                levels.append(_level(table.where(F.col("phrase").isNotNull())))
        out = tables[0]
        for table in tables[1:]:
            out = out.union(table)
        return keep(out, "phrases")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, reported: int = REPORTED,
    longest: int = LONGEST,
) -> DataFrame:
    """Columns lang, rank, phrase, a, l, r, n, score: the best phrases of two or more words per language.

    A phrase scores floor(2000000 * a / (l + r)) at its worst cut in two parts. It is left out if a
    longer phrase around it has at least 80 % of its occurrences. Null texts have no words; null
    languages are "und". Repeated rows count as often as they occur.
    """
    found = phrases(docs, text, lang, least, longest)
    counts = found.where(F.col("phrase").isNotNull()).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    candidates = found.where(F.col("words") > 1).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    size = F.size("w")
    joined = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(0).alias("side"), joined(F.lit(1), k).alias("part")),
        F.struct(k.alias("k"), F.lit(1).alias("side"), joined(k + 1, size - k).alias("part")),
    )))
    parts = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    known = lookup_join(parts, counts, ["lang", "part"], "inner", spread=["phrase", "k", "side"])
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda length: F.transform(
        F.sequence(F.lit(1), size - length + 1), lambda start: joined(start, length)
    )))
    around = candidates.where(size > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("f"))
    rows = known.select("lang", "phrase", "a", "k", "side", "f").unionByName(around, allowMissingColumns=True)
    at = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    gathered = rows.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.max(F.when(F.col("k").isNull(), F.col("f"))).alias("longer"),
        *[at(k, side).alias(f"{'lr'[side]}{k}") for k in range(1, longest) for side in (0, 1)],
    )
    score = lambda k: F.expr(
        f"(2000000 * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))"
    )
    scored = [
        F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, longest)
    ]
    lowest = F.least(*scored) if len(scored) > 1 else scored[0]
    alone = F.col("longer").isNull() | (100 * _exact("longer") < 80 * _exact("a"))
    kept = gathered.where(alone).withColumn("best", lowest).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of each share of a language, so that no task orders a whole language.
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    shared = kept.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
    best = shared.where(F.col("rank") <= reported).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    totals = found.where(F.col("phrase").isNull()).select("lang", "n")
    return best.where(F.col("rank") <= reported).join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
