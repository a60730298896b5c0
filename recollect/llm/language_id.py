"""Language of whole texts from a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import bounded_batches, give_back_memory, hash_share, slices

# Bounds of the labelled sample: texts of one language, their bytes and the longest text, and the
# languages that are learned, the commonest first. Beyond MANY_LANGUAGES each gets fewer texts.
SAMPLE_TEXTS = 400
SAMPLE_BYTES = 4 << 20
SAMPLE_TEXT_BYTES = 1 << 20
LANGUAGES, MANY_LANGUAGES = 1000, 50
UNDEFINED = "und"
# Bytes per window: longer runs of letters are cut, every byte stays in one window.
WINDOW = 24
# Bytes of words and their results that a task remembers.
MEMORY_BYTES = 24 << 20
# Runs of letters: a-z and everything beyond ASCII, in texts whose A-Z are lower-cased.
_WORDS = re.compile(rb"[a-z\x80-\xff]+").findall


@dataclass
class ByteNetwork:
    """Weights of the network; ``languages`` names the outputs in order.

    ``inputs[d]`` has a row per byte: its share of the update, reset and candidate gates in
    direction d (forward, backward). ``states[d]`` does the same for the previous state.
    """

    languages: list[str]
    inputs: list[np.ndarray]
    states: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], width: int, rng: np.random.Generator) -> ByteNetwork:
        def draw(rows: int, cols: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, (rows, cols)).astype(np.float32)

        return cls(
            languages, [draw(256, 3 * width, 0.3) for _ in "fb"],
            [draw(width, 3 * width, 1 / np.sqrt(width)) for _ in "fb"],
            draw(2 * width, len(languages), 0.3), np.zeros(len(languages), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, self.out, self.bias]

    def run(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[list[tuple]], list]:
        """Log-free probabilities (word, position, language) and what back-propagation needs.

        ``codes`` holds a word per row, padded; the backward direction reads each row reversed
        within its length. States stop changing after a row's end.
        """
        count, steps = codes.shape
        flipped = _flip(codes, lengths)
        traces, hidden = [], []
        for d, seen in enumerate((codes, flipped)):
            width = self.states[d].shape[0]
            state = np.zeros((count, width), np.float32)
            trace, states = [], np.empty((count, steps, width), np.float32)
            for t in range(steps):
                given = self.inputs[d][seen[:, t]]
                before = state @ self.states[d]
                gates = 1 / (1 + np.exp(-(given[:, :2 * width] + before[:, :2 * width])))
                update = gates[:, :width] * (lengths > t)[:, None]
                reset, inner = gates[:, width:], before[:, 2 * width:]
                candidate = np.tanh(given[:, 2 * width:] + reset * inner)
                trace.append((state, update, reset, inner, candidate))
                state = state + update * (candidate - state)
                states[:, t] = state
            traces.append(trace)
            hidden.append(states if d == 0 else _flip(states, lengths))
        both = np.concatenate(hidden, axis=2)
        score = both @ self.out + self.bias
        score = np.exp(score - score.max(axis=2, keepdims=True))
        return score / score.sum(axis=2, keepdims=True), traces, [codes, flipped, both]

    def gradients(self, codes: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[list, float]:
        """Gradients of the mean cross-entropy over all positions, through all time steps."""
        probability, traces, (codes, flipped, both) = self.run(codes, lengths)
        count, steps = codes.shape
        inside = np.arange(steps) < lengths[:, None]
        total = inside.sum()
        picked = np.take_along_axis(probability, target[:, None, None], axis=2)[:, :, 0]
        loss = float(-(np.log(picked + 1e-9) * inside).sum() / total)
        error = probability.copy()
        error[np.arange(count), :, target] -= 1
        error *= (inside / total)[:, :, None]
        flat = error.reshape(-1, error.shape[2])
        out = both.reshape(-1, both.shape[2]).T @ flat
        back = error @ self.out.T
        width = self.states[0].shape[0]
        inputs, states = [], []
        for d, seen in enumerate((codes, flipped)):
            due = back[:, :, d * width:(d + 1) * width]
            due = due if d == 0 else _flip(due, lengths)
            carried = np.zeros((count, width), np.float32)
            by_state = np.zeros_like(self.states[d])
            by_step = np.empty((count, steps, 3 * width), np.float32)
            for t in reversed(range(steps)):
                state, update, reset, inner, candidate = traces[d][t]
                carried = carried + due[:, t]
                slope = carried * update * (1 - candidate**2)
                from_update = carried * (candidate - state) * update * (1 - update)
                from_reset = slope * inner * reset * (1 - reset)
                by_step[:, t] = np.concatenate([from_update, from_reset, slope], axis=1)
                by_before = np.concatenate([from_update, from_reset, slope * reset], axis=1)
                by_state += state.T @ by_before
                carried = carried * (1 - update) + by_before @ self.states[d].T
            by_byte = np.zeros_like(self.inputs[d])
            order = np.argsort(seen, axis=None, kind="stable")
            values, cuts = np.unique(seen.ravel()[order], return_index=True)
            by_byte[values] = np.add.reduceat(by_step.reshape(-1, 3 * width)[order], cuts)
            inputs.append(by_byte)
            states.append(by_state)
        return [*inputs, *states, out, flat.sum(axis=0)], loss

    def word_sums(self, words: list[bytes], batch: int = 2048) -> np.ndarray:
        """For each word the sum of its positions' probabilities, one column per language."""
        pieces = [(i, piece) for i, word in enumerate(words) for piece in windows(word)]
        pieces.sort(key=lambda piece: len(piece[1]))
        sums = np.zeros((len(words), len(self.languages)), np.float32)
        for k in range(0, len(pieces), batch):
            codes, lengths = pad([word for _, word in pieces[k:k + batch]])
            probability = self.run(codes, lengths)[0]
            inside = np.arange(codes.shape[1]) < lengths[:, None]
            np.add.at(sums, [i for i, _ in pieces[k:k + batch]], (probability * inside[:, :, None]).sum(axis=1))
        return sums


def windows(word: bytes) -> list[bytes]:
    """A run of letters in pieces of up to WINDOW bytes; no piece begins inside a character."""
    if len(word) <= WINDOW:
        return [word]
    out, start = [], 0
    while len(word) - start > WINDOW:
        stop = start + WINDOW
        while stop > start + WINDOW - 4 and word[stop] & 0xC0 == 0x80:
            stop -= 1
        out.append(word[start:stop])
        start = stop
    return [*out, word[start:]]


def _flip(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Reverse each row within its length; what lies behind stays."""
    place = np.arange(rows.shape[1])
    at = np.where(place < lengths[:, None], lengths[:, None] - 1 - place, place)
    return rows[np.arange(len(rows))[:, None], at]


def pad(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(word) for word in words])
    inside = np.arange(lengths.max()) < lengths[:, None]
    codes = np.zeros(inside.shape, np.uint8)
    codes[inside] = np.frombuffer(b"".join(words), np.uint8)
    return codes, lengths


def fit(
    texts: dict[str, list[bytes]], width: int = 16, steps: int = 500, batch: int = 384, seed: int = 7
) -> ByteNetwork:
    """Train on pieces of words drawn evenly from the languages, by back-propagation through time with Adam."""
    rng = np.random.default_rng(seed)
    languages = sorted(texts)
    words = [
        [piece for text in texts[lang] for word in _WORDS(text.lower()) for piece in windows(word)] or [b" "]
        for lang in languages
    ]
    net = ByteNetwork.fresh(languages, width, rng)
    if len(languages) < 2:
        return net
    weights = net.weights()
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    for step in range(1, steps + 1):
        target = rng.integers(len(languages), size=batch)
        codes, lengths = pad([words[k][rng.integers(len(words[k]))] for k in target])
        slopes, _ = net.gradients(codes, lengths, target)
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, slopes, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def train(labelled: DataFrame, key: str, sample_texts: int = SAMPLE_TEXTS) -> ByteNetwork | None:
    """Fit a network to columns ``text`` and ``lang``; None without a labelled text.

    About ``sample_texts`` texts of each language are used, fewer where they are long or there are
    many languages, chosen by a hash of ``key``. LANGUAGES, SAMPLE_BYTES and MANY_LANGUAGES bound
    the driver's share whatever the table's size. Texts beyond SAMPLE_TEXT_BYTES and without
    letters are not learned from.
    """
    usable = labelled.select(key, "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    )
    counts = usable.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes")
    ).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    part = min(1.0, MANY_LANGUAGES / len(counts))
    shares = {row["lang"]: part * min(sample_texts / row["n"], SAMPLE_BYTES / row["bytes"]) for row in counts}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    chosen = F.coalesce(hash_share(F.col(key), share[F.col("lang")]), F.lit(False))
    rows = usable.where(chosen).select(
        "lang", F.col("text").cast("binary").alias("text")
    ).collect()
    texts: dict[str, list[bytes]] = {}
    for lang, text in sorted((row["lang"], bytes(row["text"])) for row in rows):
        texts.setdefault(lang, []).append(text)
    return fit(texts) if texts else None


class Reader:
    """Applies a network to texts; words seen before are not run again."""

    def __init__(self, net: ByteNetwork):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.bytes = 0
        self.sums = np.zeros((0, len(self.net.languages)), np.float32)
        self.sizes = np.zeros(0, np.int64)

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        """Mean over all labelled positions of each text, zeros where there are none."""
        found = np.zeros((len(texts), len(self.net.languages)))
        for start in range(0, len(texts), 100):
            split = [_WORDS((text or b"").lower()) for text in texts[start:start + 100]]
            if self.bytes > MEMORY_BYTES:
                self.forget()
            fresh = list(dict.fromkeys(w for words in split for w in words if w not in self.place))
            if fresh:
                self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
                self.sums = np.concatenate([self.sums, self.net.word_sums(fresh)])
                self.sizes = np.concatenate([self.sizes, [len(w) for w in fresh]])
                self.bytes += sum(map(len, fresh)) + (120 + 4 * len(self.net.languages)) * len(fresh)
            for k, words in enumerate(split):
                if words:
                    at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                    found[start + k] = self.sums[at].sum(axis=0, dtype=np.float64) / self.sizes[at].sum()
        return found


@lru_cache(maxsize=2)
def _reader(packed: bytes) -> Reader:
    return Reader(pickle.loads(packed))


def with_language(docs: DataFrame, net: ByteNetwork | None, keep: dict[str, Column], text: str | None = None) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` for each row of ``docs``, from its whole ``text``.

    Every byte of a run of letters gets a probability per language from the network, which reads
    the run in both directions; the document's probability is their mean, ``lang_pred`` the
    largest (the first by name on ties) and ``score`` that mean. A text that is null or has no
    letter is "und" with score 0, as is every text if there was nothing to learn from. Equal words
    of a task are run once; nothing is shuffled. ``text`` names a column that returns the text
    itself, which crosses to Python only once.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    source = docs.select(
        *[column.alias(f"_k{i}") for i, column in enumerate(keep.values())],
        letters.alias("_letters"), F.col("text").alias("_in"),
    )
    names = [F.col(f"_k{i}").alias(name) for i, name in enumerate(keep)]
    names += [F.col("_in").alias(text)] if text else []
    if net is None:
        return source.select(*names, F.lit(UNDEFINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    packed, languages = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net)), net.languages
    fields = source.schema.fields
    schema = T.StructType([
        *fields[:-2], *(fields[-1:] if text else []), T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1):
                given, has = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2).to_pylist()
                texts = [x if known else None for x, known in zip(given.cast(pa.binary()).to_pylist(), has)]
                probability = _reader(packed.value).probabilities(texts)
                best = probability.argmax(axis=1)
                lang = [languages[k] if known else UNDEFINED for k, known in zip(best, has)]
                score = np.where(has, np.clip(probability[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-2], *([given] if text else []), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=schema.names,
                )
        _reader(packed.value).forget()
        give_back_memory()

    found = bounded_batches(source).mapInArrow(run, schema)
    return found.select(*names, F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def held_out(key: str = "doc_id", remainder: int = 2) -> Column:
    """True for keys whose CRC-32, taken of the key as text, leaves ``remainder`` modulo 4."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(crc % 4 == remainder, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learned from rows that are not held out."""
    net = train(docs.where(~held_out() & F.col("doc_id").isNotNull()), "doc_id")
    return with_language(docs, net, {"doc_id": F.col("doc_id"), "held_out": held_out()})


def keep_identified(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """Rows of ``docs``, columns unchanged, whose language is known with ``least_score`` or more.

    Rows with an unknown language, so without text or letters, go; so do those on which the
    network is undecided. Where no label gave a network, all rows with letters stay.
    """
    net = train(docs.where(~held_out() & F.col("doc_id").isNotNull()), "doc_id")
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    others = {f"c{i}": docs[name] for i, name in enumerate(docs.columns) if name != "text"}
    found = with_language(docs, net, others, "text")
    known = found.where((F.col("lang_pred") != UNDEFINED) & (F.col("score") >= least_score))
    return known.select(*["text" if name == "text" else F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])
