"""Shape of the plans that have to hold at any size."""

import re

from pyspark.sql import functions as F

import pytest

import __spark_entry__ as entry
from recollect.operators import search as R
from recollect.plans import views as V

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "sample_join", "pad_truncate", "id_freq_list", "vocab_merged", "remap_hist", "search_content",
    "search_hard", "auc", "gauc", "batches", "rebalance",
])
def test_no_cartesian_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_single_partition_exchanges_are_aggregates_only(spark):
    """Rows reach one task only as partial aggregates or as a table of partitions."""
    for name in ("sample_join", "pad_truncate", "remap_hist", "search_content", "search_soft", "search_hard"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        for part in re.split(r"Exchange SinglePartition", plan)[1:]:
            below = part.split("\n")[1]
            assert "Aggregate" in below, below


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["id_freq_list"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert not any("l_comment" in r or "l_tax" in r for r in reads)
    assert "LessThan(o_orderdate" in plan


def test_histories_are_whole(spark, tmp_path):
    """A user with more entries than readers keep has them all in list, frequency and vocabulary."""
    for name in ("customer", "lineitem", "orders", "part", "embeddings"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "orders":
            rows = rows.withColumn("o_custkey", F.lit(1).cast("bigint"))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    entries = V.history(spark, str(tmp_path)).count()
    assert entries > 1000
    lists = V.users(spark, str(tmp_path)).where("uid = 2").select(F.size("hist_items")).first()[0]
    assert lists == entries
    counted = QUERIES["id_freq_list"](spark, str(tmp_path)).where("feature = 'hist_items'")
    assert counted.agg(F.sum("freq")).first()[0] == entries


def test_content_search_shuffles_each_side_once(spark, no_broadcast):
    """Histories and samples meet without a further shuffle after they are grouped by user."""
    samples = V.samples(spark, SF).select(*V.FULL_KEY, "uid", "iid")
    plan = final_plan(R.search_content(
        samples, V.users(spark, SF), V.quantised(spark, SF), V.TOP, V.MAX_LEN, V.SHORT
    ))
    assert plan.count("ArrowEvalPython") >= 1
    assert "hashpartitioning(uid" in plan and "_chunk" in plan
    assert not re.search(r"hashpartitioning\([^)]*_chunk", plan)
