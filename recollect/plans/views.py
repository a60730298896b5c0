"""The order tables seen as behaviour data: samples, users with histories, items, embeddings.

Orders before the split date are history, later ones samples. Ids are shifted by one because
0 is reserved for padding and unseen ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators import embeddings as E

SPLIT_DATE = "2000-01-01"
MAX_LEN, SHORT, TOP, WIDTH = 40, 10, 10, 64
KEY = ["orderkey", "linenumber", "partkey", "suppkey"]
FULL_KEY = [*KEY, "price", "quantity"]


# Columns read, declared so that no file is opened to find them out.
TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
    "embeddings": "vec_id bigint, embedding array<float>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"), (F.col("o_custkey") + 1).alias("uid"), "o_orderdate"
    )
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
        "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    # Both tables grow with the data: neither is to be broadcast, however small a test set is.
    return items.join(orders.hint("merge"), "orderkey").withColumn("iid", F.col("partkey") + 1)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = (F.col("l_returnflag") == "R").cast("int")
    return lines(spark, sf_dir).where(F.col("o_orderdate") >= SPLIT_DATE).select(
        *FULL_KEY, "uid", "iid", label.alias("label"),
        F.array((1 - label).cast("tinyint"), label.cast("tinyint")).alias("label_0"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a score full of ties, in 16 batches."""
    return samples(spark, sf_dir).select(
        *KEY, "uid", "label", (F.col("quantity") / 50.0).alias("score"),
        (F.col("orderkey") % 16).alias("batch_id"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    # The part types are a short fixed list of categories.
    types = part.select(F.array_sort(F.collect_set("p_type"))).scalar()
    return part.select(
        (F.col("p_partkey") + 1).alias("iid"),
        F.array_position(types, F.col("p_type")).cast("bigint").alias("cate"),
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint").alias("i1"),
        F.col("p_size").cast("bigint").alias("i2"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of each user: uid, the columns that order it, item, cate (0 for an unknown item)."""
    # Rows that tie on these keys have the same item, so their order does not show.
    kept = lines(spark, sf_dir).where(F.col("o_orderdate") < SPLIT_DATE)
    # The item is the part key plus one: only one of them moves with the entries.
    categories = items(spark, sf_dir).select((F.col("iid") - 1).alias("partkey"), "cate")
    return kept.select("uid", "o_orderdate", *KEY).join(categories, "partkey", "left").select(
        "uid", "o_orderdate", *KEY, (F.col("partkey") + 1).alias("item"), F.coalesce("cate", F.lit(0)).alias("cate")
    )


def users(spark: SparkSession, sf_dir: str, keep_without_history: bool = True) -> DataFrame:
    """Customers with attributes and behaviour lists, oldest entry first."""
    customer = table(spark, sf_dir, "customer")
    segments = customer.select(F.array_sort(F.collect_set("c_mktsegment"))).scalar()
    nation = F.col("c_nationkey").cast("bigint") + 1
    segment = F.array_position(segments, F.col("c_mktsegment")).cast("bigint")
    attributes = customer.select(
        (F.col("c_custkey") + 1).alias("uid"), nation.alias("u1"), segment.alias("u2"),
        (nation % 7).alias("u3"), (segment % 3).alias("u4"),
        F.floor(F.col("c_acctbal") / 1000).cast("bigint").alias("u5"),
    )
    # A list is what a user's row holds, whole; readers cut it.
    folded = history(spark, sf_dir).groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("o_orderdate", *KEY, "cate"))).alias("h")
    ).select(
        "uid", F.transform("h.partkey", lambda p: p + 1).alias("hist_items"), F.col("h.cate").alias("hist_cates")
    )
    if not keep_without_history:
        return attributes.join(folded, "uid")
    empty = F.array().cast("array<bigint>")
    return attributes.join(folded, "uid", "left").withColumns({
        c: F.coalesce(F.col(c), empty) for c in S.HISTORY_COLUMNS
    })


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") + 1).alias("iid"), F.col("embedding").alias("vec")
    )


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.quantise_table(embeddings(spark, sf_dir))


def category_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the categories: the sum over all their items, scaled to int8 again."""
    parts = quantised(spark, sf_dir).join(items(spark, sf_dir).select("iid", "cate"), "iid").select(
        "cate", F.posexplode("vec").alias("d", "x")
    )
    sums = parts.groupBy("cate", "d").agg(F.sum(F.col("x").cast("bigint")).alias("s"))
    folded = sums.groupBy("cate").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda e: e["s"]).alias("sums")
    )
    top = F.array_max(F.transform("sums", F.abs))
    scaled = F.transform("sums", lambda x: F.when(top == 0, F.lit(0)).otherwise((x * 127.0 / top).cast("tinyint")))
    return folded.select("cate", scaled.cast("array<tinyint>").alias("vec"))


def samples_with_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with the category of their item, 0 for an unknown item."""
    known = items(spark, sf_dir).select("iid", "cate")
    return samples(spark, sf_dir).join(known, "iid", "left").withColumn("cate", F.coalesce("cate", F.lit(0)))
