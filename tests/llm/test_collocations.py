"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from recollect.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, reported=2000):
    total, counts = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[k:k + m])) for m in range(1, 5) for k in range(len(words) - m + 1))
    counts = {key: n for key, n in counts.items() if n >= least}
    out = []
    for lang in total:
        kept = []
        for (other, w), a in counts.items():
            if other != lang or len(w) < 2:
                continue
            cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            inside = any(
                o == lang and len(v) > len(w) and 100 * n >= 80 * a and any(v[i:i + len(w)] == w for i in range(len(v)))
                for (o, v), n in counts.items()
            )
            if not inside:
                kept.append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:reported], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def texts(seed, count=700):
    rng = random.Random(seed)
    words = ["The", "of", "été", "quick", "Brown", "fox", "a", "b c", "\x1cx", "ZÉ", "w" * 120, *(f"rare{k}" for k in range(50))]
    fixed = ["new york city hall", "in order to", "of the", "a a a a"]
    rows = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(0, 25)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words[:11] if rng.random() < 0.9 else words))
            parts.append(rng.choice([*[" "] * 12, "  ", "\t", ". ", "\n", ", ", " ! "]))
        rows.append(("".join(parts), rng.choice(["en", "en", "en", "fr", None, "und"])))
    return rows


def found(spark, rows, **limits):
    docs = spark.createDataFrame([(t, lang, 1) for t, lang in rows], "text string, lang string, n int").repartition(3)
    return sorted(tuple(r) for r in co.collocations(docs, **limits).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_counts(spark, seed):
    rows = texts(seed)
    want = plain(rows)
    assert len(want) >= 20 and found(spark, rows) == want


def test_few_ranks_short_filter_and_small_runs(spark, monkeypatch):
    """Units beyond the ranks, a crowded filter, dense tiles and several runs in a task give the same."""
    rows = texts(3, 150)
    want = plain(rows, 5, 10)
    assert found(spark, rows, least=5, reported=10) == want
    import pyspark.cloudpickle as cloudpickle

    for name, value in (("RANKED", 7), ("FILTER_BITS", (64, 64)), ("TILE", 4), ("DENSE", 3), ("FLUSH_WORDS", 90), ("MEMORY_BYTES", 500)):
        monkeypatch.setattr(co, name, value)
    cloudpickle.register_pickle_by_value(co)  # the changed values travel to the workers
    try:
        assert found(spark, rows, least=5, reported=10) == want
    finally:
        cloudpickle.unregister_pickle_by_value(co)


def test_nulls_repeated_rows_empty_and_long_texts(spark):
    rows = [(None, None), ("", "en"), (". . .", None)] + [("same words here", "fr")] * 31 + [("left right " * 40_000, "xx")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:3]) == [] and co.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_pairs_in_dense_and_sparse_tiles():
    rng = np.random.default_rng(0)
    heads, tails = rng.zipf(1.3, 60_000).clip(1, 5000), rng.zipf(1.3, 60_000).clip(1, 5000)
    keys, times = co.count_pairs(heads, tails, 3000, 700)
    assert dict(zip(keys.tolist(), times.tolist())) == Counter((heads << 32 | tails).tolist())
    assert len(co.count_pairs(heads[:0], tails[:0], 10, 10)[0]) == 0


def test_hashes_agree():
    words = [b"a", b"bc", "é".encode()]
    found = np.array([co.word_hash("en", words[0])], np.uint64)
    for word in words[1:]:
        found = co.extended(found, np.array([co.word_hash("en", word)], np.uint64))
    assert int(found[0]) == co.phrase_hash("en", b" ".join(words))
