import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators import frequency as FR
from recollect.operators import vocabulary as VO

USERS = "uid bigint, hist_items array<bigint>, hist_cates array<bigint>"


def freq_table(spark, counts, feature="hist_items"):
    return spark.createDataFrame(
        [(feature, i + 1, c) for i, c in enumerate(counts)], "feature string, id bigint, freq bigint"
    )


def test_frequencies_of_scalars_and_lists_in_one_pass(spark):
    df = spark.createDataFrame([(1, [5, 5, 0], [1]), (1, [], None), (-2, None, [1])], USERS)
    got = {(r.feature, r.id): r.freq for r in FR.id_frequency(df, ["uid"], ["hist_items", "hist_cates"]).collect()}
    assert got == {("uid", 1): 2, ("uid", -2): 1, ("hist_items", 5): 2, ("hist_items", 0): 1, ("hist_cates", 1): 2}
    with pytest.raises(ValueError, match="nope"):
        FR.feature_ids(df, ["nope"])


def test_summary(spark):
    row = FR.frequency_summary(freq_table(spark, [7, 7] + [1] * 20)).first()
    assert (row.unique_count, row.total_occurrences, row.top1_freq, row.top1_value, row.min_freq) == (22, 34, 7, 1, 1)
    assert row.top10_coverage == "64.71%"
    ranked = FR.sort_by_frequency(freq_table(spark, [1, 3, 3])).collect()
    assert [r.id for r in ranked] == [2, 3, 1]


@pytest.mark.parametrize("seed", range(4))
def test_coverage_matches_a_search_in_the_cumulative_ratio(spark, seed):
    rng = np.random.default_rng(seed)
    counts = sorted((rng.pareto(1.0, 300) * 3 + 1).astype(int).tolist(), reverse=True)
    cumulative = np.cumsum(counts)
    got = {r.level: r for r in FR.coverage_levels(freq_table(spark, counts), [*S.COVERAGE_LEVELS, 100]).collect()}
    for level in S.COVERAGE_LEVELS:
        i = int(np.argmax(cumulative * 100 > level * cumulative[-1]))
        assert (got[level].min_freq, got[level].num_items) == (counts[i], i + 1)
        assert got[level].cumulative_ratio == pytest.approx(cumulative[i] / cumulative[-1])
    assert got[100].num_items == len(counts)


def test_log_histogram(spark):
    bins = sorted(FR.log_histogram(freq_table(spark, [1, 1, 2, 9, 10, 100]), 4).collect(), key=lambda r: r.bin)
    assert [b.n_ids for b in bins] == [3, 1, 1, 1]
    assert bins[0].low_edge == 1 and bins[-1].high_edge == pytest.approx(100)
    assert bins[0].log_count == pytest.approx(math.log10(4))
    assert bins[0].center == pytest.approx(10**0.25)
    bare = FR.log_histogram(freq_table(spark, [1, 1000]), 5, add_one=False).collect()
    assert sorted(r.log_count for r in bare) == [0.0] * 5
    assert [r.n_ids for r in FR.log_histogram(freq_table(spark, [4, 4])).collect()] == [2]


def test_vocabulary_is_sorted_shared_and_without_zero(spark):
    users = spark.createDataFrame([(3, [9, 0, -(2**60)], [2, 2, 0])], USERS)
    items = spark.createDataFrame([(4, 7), (9, 2)], "iid bigint, cate bigint")
    vocab = VO.build_vocabulary(
        FR.feature_ids(users, ["uid"], S.HISTORY_COLUMNS), FR.feature_ids(items, ["iid", "cate"])
    )
    assert sorted((r.vocab, r.idx, r.id) for r in vocab.collect()) == [
        ("hist_cates", 1, 2), ("hist_cates", 2, 7),
        ("hist_items", 1, -(2**60)), ("hist_items", 2, 4), ("hist_items", 3, 9), ("uid", 1, 3),
    ]
    assert {r.vocab: r.size for r in VO.vocabulary_sizes(vocab).collect()} == {"hist_cates": 2, "hist_items": 3, "uid": 1}


@pytest.mark.parametrize("shuffled", [False, True])
def test_mapping_of_scalars_and_lists(spark, request, shuffled):
    if shuffled:
        request.getfixturevalue("no_broadcast")
    big = 2**53 + 1
    vocab = spark.createDataFrame(
        [("hist_items", 5, 1), ("hist_items", big, 2), ("hist_cates", 5, 1), ("uid", 1, 1)],
        "vocab string, id bigint, idx bigint",
    )
    users = spark.createDataFrame(
        [(1, [5, 0, 6, big, 5], [5]), (2, [], None), (3, [0] * 50, [6])], USERS
    )
    lists = VO.index_lists(users, "uid", S.HISTORY_COLUMNS, vocab, hot_rows=10)
    got = {r.uid: (r.hist_items_idx, r.hist_cates_idx) for r in lists.collect()}
    assert got == {1: ([1, 0, 0, 2, 1], [1]), 2: ([], []), 3: ([0] * 50, [0])}
    scalars = VO.index_ids(
        spark.createDataFrame([(big, 1), (big - 1, 2)], "iid bigint, uid bigint"), ["iid", "uid"], vocab, hot_rows=1
    )
    assert sorted((r.iid_idx, r.uid_idx) for r in scalars.collect()) == [(0, 0), (2, 1)]
    counts = VO.occurrence_counts(lists, "hist_items_idx")
    assert {r.idx: r.n for r in VO.dense_counts(counts, vocab, "iid").collect()} == {0: 52, 1: 2, 2: 1}
    assert {r.idx: r.n for r in VO.occurrence_counts(scalars, "uid_idx").collect()} == {0: 1, 1: 1}


def test_reduced_vocabulary_keeps_frequent_ids_and_all_targets(spark):
    freq = freq_table(spark, [50, 30, 15, 3, 1, 1])
    targets = spark.createDataFrame([("iid", 6), ("iid", 99)], "feature string, id bigint")
    assert sorted(r.id for r in VO.reduced_vocabulary(freq, targets).collect()) == [1, 2, 3, 6, 99]
