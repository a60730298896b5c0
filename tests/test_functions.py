import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X
from recollect.functions import sequences as Q
from recollect.functions import vectors as V

LISTS = "uid bigint, hist_items array<bigint>, hist_cates array<bigint>"


@pytest.mark.parametrize("items", [[], [5], [1, 2, 3, 4], [1, 2, 3, 4, 5], None])
def test_histories_are_cut_and_padded_on_the_left(spark, items):
    cates = None if items is None else [10 * i for i in items]
    row = Q.fit_histories(spark.createDataFrame([(1, items, cates)], LISTS), 4).first()
    kept = (items or [])[-4:]
    assert row.hist_items == [0] * (4 - len(kept)) + kept
    assert row.hist_cates == [0] * (4 - len(kept)) + [10 * i for i in kept]


def test_short_list_is_the_newest_end(spark):
    df = spark.createDataFrame([(1, list(range(1, 8)), list(range(11, 18)))], LISTS)
    row = Q.add_content_keys(Q.add_short(Q.fit_histories(df, 10), 3)).first()
    assert row.short_items == row.short_items_c == [5, 6, 7]
    assert row.short_cates == [15, 16, 17]
    assert row.hist_items_c == [0, 0, 0, 1, 2, 3, 4, 5, 6, 7]


def test_lists_of_unequal_length_are_set_apart(spark):
    df = spark.createDataFrame([(1, [1, 2], [1]), (2, [1], [1]), (3, None, None)], LISTS)
    good, bad = Q.split_misaligned(df)
    assert [r.uid for r in bad.collect()] == [1]
    assert sorted(r.uid for r in good.collect()) == [2, 3]


def test_lists_of_unequal_length_are_not_fitted(spark):
    rows = [(1, [1, 2, 3], [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4, 5], [1, 2]), (3, [7], [8]), (4, [], None), (5, [1], None)]
    df = spark.createDataFrame(rows, LISTS)
    fitted = {r.uid: (r.hist_items, r.hist_cates) for r in Q.fit_histories(df, 4).collect()}
    assert fitted == {3: ([0, 0, 0, 7], [0, 0, 0, 8]), 4: ([0] * 4, [0] * 4)}
    assert sorted(r.uid for r in Q.split_misaligned(df)[1].collect()) == [1, 2, 5]


def test_masks(spark):
    df = spark.createDataFrame([(1, list(range(1, 1001)), [])], LISTS)
    assert df.select(Q.mask_ids("hist_items", lambda x, i: x > 3)).first()[0] == [1, 2, 3] + [0] * 997
    masked = df.select(Q.mask_random("hist_items", 0.1, F.col("uid"), 7).alias("m"))
    zeros = [r.m.count(0) for r in (masked.first(), masked.first())]
    assert zeros[0] == zeros[1] and 50 < zeros[0] < 150


def test_quantise_cuts_toward_zero_in_float32(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.uniform(-1.3, 1.3, 500), [0.0, 1.0, -1.0, 2.0, -2.0]]).astype(np.float32)
    want = np.trunc(np.clip(values, np.float32(-1), np.float32(1)) * np.float32(127)).astype(np.int8)
    df = spark.createDataFrame([([float(v) for v in values],)], "v array<float>")
    row = df.select(V.quantise("v").alias("q"), V.dequantise(V.quantise("v")).alias("x")).first()
    assert row.q == want.tolist()
    assert row.x == (want.astype(np.float32) / np.float32(127)).tolist()


def test_cosine_and_ranking_value(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [2.0, 2.0])],
        "a array<double>, b array<double>",
    )
    rows = df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).withColumn("r", V.rank_value(F.col("c"))).collect()
    assert [r.c for r in rows] == [0.0, 0.0, pytest.approx(1.0)]
    assert [r.r for r in rows[:2]] == [-1.1, -1.1]
    assert df.select(V.normalise(F.col("b"))).first()[0] == [0.0, 1.0]
    ordered = spark.sql("select array(0.1D, 0.5D, 0.1D) c").select(V.sorted_similarities(F.col("c"))).first()[0]
    assert [(x.cos, x.pos) for x in ordered] == [(0.5, 1), (0.1, 2), (0.1, 0)]


def test_tiers_close_on_the_right(spark):
    cases = {-1.0: 0, -0.95: 1, -0.9: 1, 0.0: 10, 0.05: 11, 0.3: 13, 1.0: 20}
    df = spark.createDataFrame([(c,) for c in cases], "c double").withColumn("t", X.tier(F.col("c")))
    assert {r.c: r.t for r in df.collect()} == cases
    assert X.tier_count(0.1) == 22


def test_scalar_helpers(spark):
    row = spark.sql("select array(1.0D, 2.0D) v, 0.12345D p, 1.5D big").select(
        X.softmax(F.col("v")).alias("s"), X.percent_text(F.col("p")).alias("t"),
        X.clip01(F.col("big")).alias("c"), X.log_count(F.lit(0), 10, False).alias("zero"),
        X.log_count(F.lit(99), 10).alias("two"),
    ).first()
    e = math.exp(1)
    assert row.s == pytest.approx([1 / (1 + e) + 1e-7, e / (1 + e) + 1e-7])
    assert (row.t, row.c, row.zero) == ("12.35%", 1.0, 0.0) and row.two == pytest.approx(2)


def test_names_round_trip_and_groups(spark):
    df = spark.createDataFrame([(1, 2)], ["129_1", "205"])
    readable = S.to_readable(df)
    assert readable.columns == ["uid", "iid"]
    assert S.to_source(readable).columns == ["129_1", "205"]
    assert S.group_columns(spark.range(1).select(*[F.lit(0).alias(c) for c in S.COLUMN_GROUPS["target"]]), "target").columns \
        == ["iid", "cate", "i1", "i2", "iid_c"]
