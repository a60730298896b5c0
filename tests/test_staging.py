"""What staged tables leave on disk, and how often a feature table makes its input."""

import re
import time
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recollect.functions.ranking import Pooling
from recollect.operators import features as FE
from recollect.operators import staging
from recollect.plans import views as V


def shuffle_files(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {p.name for d in dirs for p in Path(str(d)).rglob("shuffle_*.data")}


def test_staging_frees_what_it_shuffled(spark):
    before, setting = shuffle_files(spark), spark.conf.get(staging._CLEANUP, None)
    df = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 700).alias("k")).agg(F.sum("id").alias("s"))
    out = staging.stage(df, "freed")
    for _ in range(50):  # files are deleted by another thread
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(staging._CLEANUP, None) == setting
    # A frame that was staged can be computed again.
    assert out.agg(F.sum("s")).first()[0] == df.agg(F.sum("s")).first()[0] == sum(range(5000))


@pytest.mark.parametrize("method", ["soft", "content", "hard"])
def test_feature_table_makes_its_input_once(spark, tmp_path, no_broadcast, method):
    def noted(df, name):
        seen = f"{tmp_path}/{name}"

        def note(batches):
            for batch in batches:
                with open(seen, "a") as f:
                    f.write(f"{batch.num_rows}\n")
                yield batch

        return df.mapInArrow(note, df.schema), lambda: sum(map(int, Path(seen).read_text().split()))

    vec = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda d: (F.pmod(F.hash("k", d), F.lit(15)) - 7).cast("tinyint"))
    samples, times = noted(spark.range(90).select(
        "id", (F.col("id") % 7).alias("uid"), (F.col("id") % 11).alias("iid"), (F.col("id") % 2).alias("label")
    ), "samples")
    lists = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (F.col("id") * i) % 11)
    users = spark.range(6).select(
        F.col("id").alias("uid"), *[F.lit(i).alias(f"u{i}") for i in range(1, 6)], lists.alias("hist_items"),
        F.transform(lists, lambda i: i % 3 + 1).alias("hist_cates"),
    )
    items = spark.range(1, 10).select(
        F.col("id").alias("iid"), (F.col("id") % 3 + 1).alias("cate"), F.lit(1).alias("i1"), F.lit(2).alias("i2")
    )
    vectors, vector_times = noted(spark.range(1, 9).withColumnRenamed("id", "k").select(F.col("k").alias("iid"), vec.alias("vec")), "vectors")
    cates, cate_times = noted(spark.range(1, 4).withColumnRenamed("id", "k").select(F.col("k").alias("cate"), vec.alias("vec")), "cates")
    soft = {"item_vectors": vectors, "cate_vectors": cates, "item_width": 4, "cate_width": 4} if method == "soft" else {}
    live = len(staging._live)
    table = FE.feature_table(samples, users, items, vectors, method, 3, 5, 2, Pooling(), 4, **soft)
    names = [path.rsplit("/", 1)[1].split("-")[0] for _, path in staging._live[live:]]
    assert sorted(names) == sorted(["vectors", "picks" if method == "soft" else "narrow"])
    rows = table.collect()
    assert sorted(r.id for r in rows) == list(range(90))
    assert times() == 90
    assert vector_times() == 8 * (2 if method == "soft" else 1)
    if method == "soft":
        assert cate_times() == 3


def test_histories_move_an_item_once(spark, tmp_path, no_broadcast):
    """Lists are as the rows say, unknown and twice known items too; the part key stands for the item on the way."""
    old, new = datetime(1999, 5, 1), datetime(2001, 5, 1)
    orders = [(1, 7, old), (2, 7, old), (3, None, old), (4, 8, new)]
    lines = [(2, 30, 1, 1), (1, 10, 1, 2), (1, 20, 1, 1), (2, None, 1, 2), (3, 10, 1, 1), (4, 10, 1, 1)]
    parts = [(10, "Brand#1", "B", 1), (20, "Brand#2", "A", 2), (20, "Brand#2", "B", 2)]
    for name, rows in {
        "orders": [(k, c, d) for k, c, d in orders], "part": parts, "customer": [(7, 1, 5.0, "X"), (8, 2, 5.0, "Y")],
        "lineitem": [(o, p, s, n, 1.0, 2.0, 0.0, 0.0, "R", "O", old) for o, p, s, n in lines],
    }.items():
        spark.createDataFrame(rows, V.TABLES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    users = V.users(spark, str(tmp_path))
    got = {r.uid: (r.hist_items, r.hist_cates) for r in users.collect()}
    assert got == {8: ([21, 21, 11, 31, None], [1, 2, 2, 0, 0]), 9: ([], [])}
    plan = users._jdf.queryExecution().optimizedPlan().toString()
    folded = re.search(r"collect_list\(struct\(([^()]*)\)", plan).group(1)
    assert "partkey" in folded and "item" not in folded
