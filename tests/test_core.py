"""Running totals and skew-safe joins against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from recollect.operators.ordering import running_totals, with_index
from recollect.operators import vocabulary as VO
from recollect.operators.skew import hot_keys, lookup_join, salt_many


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_is_dense_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = random.Random(1).sample(range(-10**17, 10**17), 5000)
        df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(7)
        got = {r.id: r.idx for r in with_index(df, ["id"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {v: k for k, v in enumerate(sorted(ids), 1)}


def test_groups_that_span_partitions_are_carried(spark):
    """One group holds most rows, so its running sum crosses every partition border."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("hot", i, i % 7) for i in range(3000)] + [(f"g{i % 40}", i, 1) for i in range(600)]
        df = spark.createDataFrame(rows, "g string, o int, v bigint").repartition(5)
        out = running_totals(df, ["o"], {"s": F.col("v"), "n": F.lit(1)}, ["g"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    total, seen = defaultdict(int), Counter()
    want = {}
    for g, o, v in sorted(rows):
        total[g] += v
        seen[g] += 1
        want[g, o] = (total[g], seen[g])
    assert {(r.g, r.o): (r.s, r.n) for r in out} == want


def test_null_groups_and_empty_input(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, o int")
    got = sorted((r.g or "", r.o, r.idx) for r in with_index(df, ["o"], ["g"]).collect())
    assert got == [("", 1, 1), ("", 2, 2), ("a", 1, 1)]
    assert with_index(df.where("o > 5"), ["o"]).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup_equals_plain_join(spark, no_broadcast, how):
    """A third of the rows share one key; its lookup rows (two of them) reach every piece."""
    left = spark.range(3000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k")
    )
    right = spark.createDataFrame([(1, "a"), (1, "b"), (5, "c"), (7777, "d")], "k bigint, v string")
    got = lookup_join(left, right, "k", how, hot_rows=100)
    assert sorted(map(tuple, got.select("row", "k", "v").collect()), key=str) == sorted(
        map(tuple, left.join(right, "k", how).select("row", "k", "v").collect()), key=str
    )
    assert "_salt" in plan_of(got) and "_salt" not in got.columns


def test_hot_key_is_spread_evenly(spark):
    left = spark.range(3000).select(F.col("id").alias("row"), F.lit(1).alias("k"))
    hot = hot_keys(left, ["k"], 300)
    assert hot.collect()[0]["_salt_parts"] == 10
    sizes = [r["count"] for r in salt_many(left, ["k"], hot, ["row"]).groupBy("_salt").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 400


def test_small_lookup_is_left_to_broadcast(spark):
    left = spark.range(10).select(F.col("id").alias("k"))
    right = spark.range(3).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    assert "_salt" not in plan_of(lookup_join(left, right, "k"))


def test_chained_lookups_grow_linearly(spark, no_broadcast):
    """Counting keys in the first table keeps a chain of lookups from doubling its plan."""
    base = spark.range(10).select("id", *[(F.col("id") % 3).alias(f"k{i}") for i in range(6)])
    df, sizes = base, []
    for i in range(6):
        table = spark.range(3).select(F.col("id").alias(f"k{i}"), F.lit(i).alias(f"v{i}"))
        df = lookup_join(df, table, f"k{i}", "left", base.columns, count_in=base)
        sizes.append(plan_of(df).count("Range ("))
    steps = [b - a for a, b in zip(sizes, sizes[1:])]
    assert len(set(steps)) == 1


def test_stacked_lookup_moves_rows_once(spark, no_broadcast):
    rows = spark.range(300).select(
        "id", (F.col("id") % 7).alias("uid"), F.when(F.col("id") % 5 > 0, F.lit(3)).alias("iid"),
        (F.col("id") % 4).alias("cate"), F.concat(F.lit("wide"), F.col("id").cast("string")).alias("text"),
    )
    known = spark.createDataFrame(
        [("uid", 3, 1), ("uid", 5, 2), ("hist_items", 3, 9), ("hist_cates", 2, 4)], "vocab string, id bigint, idx bigint"
    )
    columns = ["uid", "iid", "cate"]
    stacked = VO.index_ids(rows, columns, known, hot_rows=50, key=["id"])
    plain = VO.index_ids(rows, columns, known, hot_rows=50)
    names = sorted(plain.columns)
    assert sorted(stacked.select(names).collect()) == sorted(plain.select(names).collect())

    def moves(df):
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return sum("text#" in columns for columns in re.findall(r"\) Exchange\nInput[^:]*: \[(.*?)\]\n", plan))

    assert (moves(stacked), moves(plain)) == (1, 3)
    assert stacked.where("iid is null and iid_idx = 0").count() == 60
