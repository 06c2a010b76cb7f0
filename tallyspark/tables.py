"""Event streams from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str, m: int = 4) -> DataFrame:
    """Events by day and user, dealt to m partitions by event id."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(
        F.unix_date(F.col("ts").cast("date")).cast("long").alias("window"),
        F.pmod("event_id", F.lit(m)).cast("int").alias("part"),
        F.col("event_id").alias("pos"),
        F.col("user_id").cast("string").alias("key"),
        F.lit(1).cast("long").alias("weight"),
    )


def lineitem(spark: SparkSession, sf_dir: str, m: int = 8, weighted: bool = False) -> DataFrame:
    """Line items by month of shipping and supplier, dealt to m partitions by order."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("window"),
        F.pmod("l_orderkey", F.lit(m)).cast("int").alias("part"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("pos"),
        F.col("l_suppkey").cast("string").alias("key"),
        (F.col("l_quantity").cast("long") if weighted else F.lit(1).cast("long")).alias("weight"),
    )


def orders(spark: SparkSession, sf_dir: str, m: int = 4) -> DataFrame:
    """Orders by month and customer."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return t.select(
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("window"),
        F.pmod("o_orderkey", F.lit(m)).cast("int").alias("part"),
        F.col("o_orderkey").alias("pos"),
        F.col("o_custkey").cast("string").alias("key"),
        F.lit(1).cast("long").alias("weight"),
    )
