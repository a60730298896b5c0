import json
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators import metrics as M
from recollect.operators import staging
from recollect.operators.samples import build_samples, split_tables
from recollect.plans import jobs
from recollect.sources import sinks, tables, text
from recollect.streaming import shards as ST
from recollect.streaming import user_scores as US


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def good(parsed):
    return sorted(tuple(r) for r in parsed.good.collect())


def test_user_lines_with_gaps(spark):
    parsed = text.parse_lines(lines(
        spark,
        "1\t2\t3\t4\t5\t6\t7,8\t9,9",
        "  \t ",
        "2\t\t3\t4\t5\t6\t\t",
        "3,99\t1",
        "-58759430334327705\t1\t1\t1\t1\t1\t1\t1\textra\tfields",
        "4\t1\t1\t1\t1\t1\t1,,2\t1",
        "5\t1_0\t1\t1\t1\t1\t1\t1",
        "6\tx\t1\t1\t1\t1\t1\t1",
    ), S.LAYOUTS["users"])
    assert good(parsed) == sorted([
        (1, 2, 3, 4, 5, 6, [7, 8], [9, 9]),
        (2, 0, 3, 4, 5, 6, [0], [0]),
        (3, 1, 0, 0, 0, 0, [0], [0]),
        (-58759430334327705, 1, 1, 1, 1, 1, [1], [1]),
    ])
    assert sorted(r.reason for r in parsed.rejected.collect()) == ["bad field hist_items", "bad field u1", "bad field u1"]
    c = parsed.counts.first()
    assert (c.lines_read, c.lines_blank, c.lines_not_blank, c.lines_short, c.rows_rejected, c.rows_written) == (8, 1, 7, 2, 3, 4)


def test_short_lines_can_be_dropped(spark):
    parsed = text.parse_lines(lines(spark, "1\t2\t3\t4", "1\t2", "\t9\t9\t9\t9"), S.LAYOUTS["items"], fill_missing=False)
    assert good(parsed) == [(1, 2, 3, 4), (9, 9, 9, 9)]
    assert parsed.counts.first().lines_short == 1


def test_labels_and_vectors(spark):
    parsed = text.parse_lines(lines(spark, "0,1\t5\t6", "300,1\t5\t6"), S.LAYOUTS["samples"])
    assert good(parsed) == [([0, 1], 5, 6)]
    parsed = text.parse_lines(
        lines(spark, "7\t0.5\x1d1e-1\x1d-2", "8\t1\x1d2", "9\t1\x1dx\x1d2", "10"), S.LAYOUTS["embeddings"], vector_width=3
    )
    rows = parsed.good.collect()
    assert [r.iid for r in rows] == [7] and rows[0].vec == pytest.approx([0.5, 0.1, -2.0])
    assert parsed.rejected.count() == 3


def test_formatting_is_the_inverse(spark):
    users = spark.createDataFrame([(1, 2, 3, 4, 5, 6, [7, 8], [9, 0])], S.layout_schema(S.LAYOUTS["users"]))
    assert good(text.parse_lines(text.format_lines(users, S.LAYOUTS["users"]), S.LAYOUTS["users"])) == [tuple(users.first())]


SAMPLES = "label_0 array<tinyint>, uid bigint, iid bigint"
USERS = "uid bigint, u1 bigint, u2 bigint, u3 bigint, u4 bigint, u5 bigint, hist_items array<bigint>, hist_cates array<bigint>"
ITEMS = "iid bigint, cate bigint, i1 bigint, i2 bigint"
BIG = 2**53 + 1


def inputs(spark):
    samples = [([1, 0], 1, 10), ([0, 1], 2, 10), ([0, 1], 99, 77), ([0, 1], 1, BIG)] * 5
    users = [(1, 1, 2, 3, 4, 5, [10, BIG], [1, 2]), (2, 0, 0, 0, 0, BIG, [], [])]
    return (
        spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(users, USERS),
        spark.createDataFrame([(10, 1, 2, 3), (BIG, 4, 5, 6)], ITEMS),
    )


def test_join_keeps_unmatched_samples_and_large_ids(spark, no_broadcast):
    rows = {(r.uid, r.iid): r for r in build_samples(*inputs(spark), hot_rows=3).collect()}
    assert rows[99, 77].hist_items is None and (rows[99, 77].u5, rows[99, 77].cate) == (0, 0)
    assert rows[1, BIG].hist_items == [10, BIG] and rows[2, 10].u5 == BIG
    assert build_samples(*inputs(spark)).count() == 20
    samples, users, items = inputs(spark)
    assert build_samples(samples, users, items.union(items)).count() == 35


def test_split_names():
    assert split_tables("test")[0] == "test_samples"
    with pytest.raises(ValueError):
        split_tables("dev")


def test_split_rows_are_numbered_without_sort_or_sample(spark, tmp_path, no_broadcast):
    """Numbers come from file sizes and positions; wide rows move straight to the task of their shard."""
    source = f"{tmp_path}/raw"
    samples, users, items = inputs(spark)
    for name, df in zip(("train_samples", "train_user_features", "item_features"), (samples.repartition(3), users, items)):
        S.to_source(df).write.parquet(f"{source}/{name}.parquet")
    rows, shards = jobs.split_rows(spark, source, "train", 6)
    placed = sinks.place_shards(rows, "row_no", (0, shards))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" in plan
    got = placed.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.row_no for r in got) == list(range(20)) and all(r.shard_no == r.row_no // 6 for r in got)
    assert len({(r.shard_no, r.task) for r in got}) == shards == 4
    stored = spark.read.parquet(f"{source}/train_samples.parquet").select("*", "_metadata.file_path", "_metadata.row_index")
    in_order = sorted(stored.collect(), key=lambda r: (r.file_path, r.row_index))
    uid = S.to_source(samples.select("uid")).columns[0]
    assert [r.uid for r in sorted(got, key=lambda r: r.row_no)] == [r[uid] for r in in_order]


def test_split_from_tables_to_shards(spark, tmp_path):
    """Stored tables under their column codes go in; named shards with a sidecar come out."""
    source, out = f"{tmp_path}/raw", f"{tmp_path}/out"
    for name, df in zip(("train_samples", "train_user_features", "item_features"), inputs(spark)):
        S.to_source(df).write.parquet(f"{source}/{name}.parquet")
    meta = jobs.prepare_split(spark, source, out, "train", rows_per_shard=6).first()
    assert (meta.total_rows, meta.num_shards) == (20, 4)
    names = sorted(f for f in os.listdir(f"{out}/train") if f.endswith(".parquet"))
    assert names == [f"train-shard-00000{i}.parquet" for i in range(4)]
    assert [pq.ParquetFile(f"{out}/train/{n}").metadata.num_rows for n in names] == [6, 6, 6, 2]
    column = pq.ParquetFile(f"{out}/train/{names[0]}").metadata.row_group(0).column(0)
    assert column.compression == "ZSTD" and not any("DICT" in e for e in column.encodings)
    with open(f"{out}/train/metadata.json") as f:
        assert json.load(f)["total_rows"] == 20
    assert tables.steps_per_epoch(tables.read_metadata(spark, f"{out}/train"), 3, 2).first().steps == 3
    shards = tables.read_shards(spark, f"{out}/train", "train")
    assert shards.columns[:-2] == S.SAMPLE_COLUMNS
    assert {r.shard_file: r.n_rows for r in tables.shard_rows(shards).collect()} == dict(zip(names, [6, 6, 6, 2]))

    jobs.even_out_tail(spark, f"{out}/train", f"{out}/even", "train", 0)
    even = sorted(os.listdir(f"{out}/even"))
    sizes = [pq.ParquetFile(f"{out}/even/{n}").metadata.num_rows for n in even if n.endswith(".parquet")]
    assert sizes == [2] * 8 + [4]
    key = ["uid", "iid", "label_0"]
    assert sorted(map(str, tables.read_shards(spark, f"{out}/even", "train").select(*key).collect())) == sorted(
        map(str, shards.select(*key).collect())
    )

    jobs.build_statistics(spark, source, f"{out}/stats")
    vocab = tables.read_vocabulary(spark, f"{out}/stats/vocabulary")
    assert sorted(r.id for r in vocab.where("vocab = 'hist_items'").collect()) == [10, BIG]
    reduced = tables.read_vocabulary(spark, f"{out}/stats/vocabulary", reduced=True)
    assert {r.vocab for r in reduced.collect()} == {r.vocab for r in vocab.collect()}
    assert tables.read_frequencies(spark, f"{out}/stats/frequencies", ["u5"]).count() == 2


def test_plain_shard_writer_bounds_file_size(spark, tmp_path):
    sinks.write_shards(spark.range(25).coalesce(1), f"{tmp_path}/s", rows_per_shard=10)
    files = [f for f in os.listdir(f"{tmp_path}/s") if f.endswith(".parquet")]
    assert sorted(pq.ParquetFile(f"{tmp_path}/s/{f}").metadata.num_rows for f in files) == [5, 10, 10]


def test_row_groups_hold_ten_thousand_rows(spark, tmp_path):
    sinks.write_shards(spark.range(25000).coalesce(1), f"{tmp_path}/s")
    file = next(f for f in os.listdir(f"{tmp_path}/s") if f.endswith(".parquet"))
    meta = pq.ParquetFile(f"{tmp_path}/s/{file}").metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [10000, 10000, 5000]


def test_rebalanced_sink_and_compaction(spark, tmp_path):
    sinks.write_rebalanced(spark.range(19), f"{tmp_path}/r", ["id"], 8, 16)
    sinks.name_shards(spark, f"{tmp_path}/r", "test")
    rows = tables.read_shards(spark, f"{tmp_path}/r", "test").collect()
    assert {r.id: r.shard_file for r in rows} == {
        i: f"test-shard-{16 + min(i // 2, 8):06d}.parquet" for i in range(19)
    }
    assert sinks.compact(spark.range(50).repartition(9), f"{tmp_path}/c", 2).first().total_rows == 50
    assert tables.read_parts(spark, f"{tmp_path}/c", f"{tmp_path}/c").count() == 100
    assert tables.preview(spark.range(50)).count() == 5


def test_missing_column_and_missing_sidecar(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    with pytest.raises(ValueError, match="uid"):
        tables.read_typed(spark, f"{tmp_path}/t", ["id", "uid"])
    assert tables.read_metadata(spark, f"{tmp_path}/t").count() == 0


def test_embedding_sink(spark, tmp_path):
    df = spark.createDataFrame([(5, [1, -127]), (2, [0, 3])], "iid bigint, vec array<tinyint>")
    meta = sinks.write_embeddings(df, f"{tmp_path}/e").first()
    assert meta.scale == pytest.approx(1 / 127)
    assert [(r.iid, r.vec) for r in tables.read_embeddings(spark, f"{tmp_path}/e").orderBy("iid").collect()] == [(2, [0, 3]), (5, [1, -127])]


def test_ingest_from_files(spark, tmp_path):
    (tmp_path / "items.txt").write_text("1\t2\t3\t4\n\nbad\t1\t1\t1\n5\t6\t7\t8\r\n")
    parsed = jobs.ingest(spark, f"{tmp_path}/items.txt", "items", f"{tmp_path}/items")
    assert parsed.counts.first().rows_written == 2 and parsed.rejected.count() == 1
    stored = tables.read_typed(spark, f"{tmp_path}/items", S.ITEM_COLUMNS)
    places = tables.with_row_place(spark, f"{tmp_path}/items")
    assert places.count() == 2 and "line_kind" not in places.columns
    # One write has filled all three: what comes back no longer reads the text.
    (tmp_path / "items.txt").write_text("")
    assert [(r.value, r.reason) for r in parsed.rejected.collect()] == [("bad\t1\t1\t1", "bad field iid")]
    assert sorted(r.iid for r in parsed.good.collect()) == [1, 5]
    assert parsed.counts.first().asDict() == {
        "lines_read": 4, "lines_blank": 1, "lines_not_blank": 3, "lines_short": 0, "rows_rejected": 1,
        "rows_written": 2, "rows_full_length": 3,
    }
    assert sorted(map(tuple, stored.collect())) == [(1, 2, 3, 4), (5, 6, 7, 8)]


def test_streamed_metrics_match_batch(spark, tmp_path):
    scores = spark.range(300).select(
        (F.col("id") % 11).alias("uid"), (F.hash("id") % 3 == 0).cast("int").alias("label"),
        (F.pmod(F.hash(F.col("id") * 7), F.lit(50)) / 50.0).alias("score"), (F.col("id") % 3).alias("part"),
    )
    scores.repartition(1).write.partitionBy("part").parquet(f"{tmp_path}/in")
    schema = scores.drop("part").schema
    stream = ST.stream_shards(spark, f"{tmp_path}/in", schema)
    ST.run_confusion(stream, f"{tmp_path}/c", f"{tmp_path}/ck1").awaitTermination()
    key = ["threshold_no", "tp", "fp", "tn", "fn"]
    assert sorted(ST.latest_confusion(spark, f"{tmp_path}/c").select(*key).collect()) == sorted(
        M.confusion(scores).select(*key).collect()
    )
    ST.run_step_metrics(stream, f"{tmp_path}/m", f"{tmp_path}/ck2").awaitTermination()
    last = ST.accumulated_metrics(spark, f"{tmp_path}/m").orderBy(F.desc("step")).first()
    assert last.step == 2
    batch = M.running_metrics(scores, "part").orderBy(F.desc("step")).first()
    for name in ("gauc_so_far", "pair_auc_so_far", "auroc_so_far", "mean_loss"):
        assert last[name] == pytest.approx(batch[name])
    assert last.user_auc_so_far == pytest.approx(M.gauc(scores).first().gauc)


def test_keyed_state_survives_a_restart(spark, tmp_path):
    rows = spark.range(240).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 5).cast("bigint").alias("uid"),
        (F.hash("id") % 3 == 0).cast("int").alias("label"),
        F.when(F.col("id") % 9 == 0, None).otherwise(F.pmod(F.hash(F.col("id") * 7), F.lit(20)) / 20.0 - 0.3).alias("score"),
        F.floor(F.col("id") / 40).alias("part"),
    )
    for part in range(6):
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part in (2, 5):
            stream = ST.stream_shards(spark, f"{tmp_path}/in", rows.drop("part").schema)
            before = len(staging._live)
            ST.run_step_metrics(stream, f"{tmp_path}/m", f"{tmp_path}/ck").awaitTermination()
            assert len(staging._live) == before
    got = ST.accumulated_metrics(spark, f"{tmp_path}/m").orderBy("step").collect()
    assert [r.step for r in got] == list(range(6))
    for r in got:
        upto = rows.where(F.col("part") <= r.step)
        assert r.user_auc_so_far == pytest.approx(M.gauc(upto).first().gauc)


def test_slices_of_sorted_counts_merge_in_order(monkeypatch):
    monkeypatch.setattr(US, "SLICE", 3)
    old = [(k, 1, 2) for k in range(0, 20, 2)]
    new = np.array([(k, 5, 0) for k in (-4, -3, 0, 7, 8, 18, 30, 31, 32, 33)], np.int64)
    got = np.concatenate(list(US.merge(iter(old), new)))
    want = {k: [1, 2] for k, _, _ in old}
    for k, p, _ in new.tolist():
        want[k] = [want.get(k, [0, 0])[0] + p, want.get(k, [0, 0])[1]]
    assert got.tolist() == [[k, *want[k]] for k in sorted(want)]
    assert not list(US.merge(iter(()), new[:0]))
    scores = np.array([-np.inf, -2.5, -0.0, 0.0, 1e-300, 3.0, np.inf, np.nan, 0.0])
    keys = US.sort_keys(scores, np.array([False] * 8 + [True]))
    assert keys[2] == keys[3] and keys[8] < keys[0] and (np.diff(np.delete(keys[:8], 2)) > 0).all()
    assert US.scores_of(keys[[1, 5, 8]]).to_pylist() == [-2.5, 3.0, None]


def test_unordered_shards_can_be_read_as_shards(spark, tmp_path):
    rows = spark.range(1000).repartition(3)
    sinks.write_shards(rows, f"{tmp_path}/out", "test", rows_per_shard=200)
    shards = tables.read_shards(spark, f"{tmp_path}/out", "test", rows.schema)
    assert shards.count() == 1000 and shards.select("id").distinct().count() == 1000
    sizes = [r["count"] for r in shards.groupBy("shard_file").count().collect()]
    assert len(sizes) >= 5 and max(sizes) <= 200


def test_compaction_by_size_keeps_order_and_cuts_large_files(spark, tmp_path):
    source = str(tmp_path / "in")
    for start, rows in ((0, 10), (10, 4000), (4010, 30)):
        part = spark.range(start, start + rows, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
        part.write.mode("append").parquet(source)
    names = sorted(p.name for p in (tmp_path / "in").glob("*.parquet"))
    sizes = {n: (tmp_path / "in" / n).stat().st_size for n in names}
    want = [r.id for n in names for r in spark.read.parquet(f"{source}/{n}").collect()]
    target = 50_000
    files = sinks.compact_to_size(spark, source, str(tmp_path / "out"), target)
    assert files.agg(F.sum("n_rows").alias("n")).first().n == 4040
    written = sorted((tmp_path / "out").glob("part-shard-*.parquet"))
    assert len(written) == -(-sum(sizes.values()) // target)
    assert max(p.stat().st_size for p in written) < 1.5 * target
    got = [r.id for p in written for r in spark.read.parquet(str(p)).collect()]
    assert got == want
    with pytest.raises(ValueError):
        sinks.compact_to_size(spark, source, str(tmp_path / "none"), 0)
