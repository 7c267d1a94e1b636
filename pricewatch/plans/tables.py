"""The driver's tables seen as price-watching tables.

lineitem is the observation history: one offer per part, a check per shipped line. Parts are the watches, their
target is 20 times the retail price. Events are checks and failures, documents are channel messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MONEY = "decimal(18,2)"
SITES = [("spam-farm", "spam"), (".example.org", "org"), (".example.net", "net")]
KEYWORDS = ["para", "license", "und"]
EXCLUDED = ["@"]
PHRASES = ["plate", "red plate", "widget", "small red widget", "rod", "old rod", "hot old rod", "blue"]
FIRST_HALF = "1998-01-01"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_spread(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """Table for work that is heavy per row. A table in fewer splits than there are cores is spread over them;
    a table in many splits is read as it is, without a shuffle."""
    df = load(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def order_of_lines() -> list[str]:
    return ["l_orderkey", "l_linenumber", "l_suppkey"]


def lines(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """lineitem with money types and `seq`, a struct that makes (part, shipdate, seq) unique."""
    table = load_spread(spark, folder, "lineitem", "l_orderkey") if spread else load(spark, folder, "lineitem")
    return table.select(
        "l_partkey",
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").cast("timestamp").alias("observed_at"),
        F.struct(*order_of_lines()).alias("seq"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_quantity"),
        "l_returnflag",
        "l_linestatus",
    )


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "part").select(
        "p_partkey",
        "p_name",
        "p_brand",
        "p_size",
        (F.col("p_retailprice").cast(MONEY) * 20).cast(MONEY).alias("target_price"),
        (F.col("p_retailprice").cast(MONEY) * 2).cast(MONEY).alias("minimum_price"),
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """offer_key, observed_at, seq, price, target_price, notify_once_in_24h and the line's own columns."""
    watch = parts(spark, folder).select(
        "p_partkey", "p_name", "target_price", (F.col("p_size") % 2 == 0).alias("notify_once_in_24h")
    )
    rows = lines(spark, folder)
    return rows.join(watch, rows.l_partkey == watch.p_partkey).drop("p_partkey").withColumnRenamed("l_partkey", "offer_key")


def messages(spark: SparkSession, folder: str, spread: bool = True) -> DataFrame:
    """Documents as channel messages; time follows the document id."""
    table = load_spread(spark, folder, "documents", "doc_id") if spread else load(spark, folder, "documents")
    return table.select(
        F.col("doc_id").alias("message_id"),
        F.col("source").alias("channel"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60).alias("ts"),
        "text",
    )


def failures(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").where("event_type = 'error'").select(
        "event_id", F.col("ts").cast("timestamp").alias("created_at"), "user_id", "value"
    )
