"""The supplied tables seen as trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trades_from_events(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select(
        F.col("event_id").alias("agg_trade_id"),
        F.col("value").alias("price"),
        # props is {"k": <int>}; a pattern finds it at a fraction of a JSON parser's cost per row
        F.regexp_extract("props", r'"k"\s*:\s*(-?\d+)', 1).try_cast("double").alias("quantity"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"),
        (F.col("event_id") % 2 == 0).alias("is_buyer_maker"),
        F.col("event_type").alias("symbol"),
    )


def trades_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Many equal times per symbol, and ids that do not follow time."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("agg_trade_id"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("quantity"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
        F.col("o_orderpriority").alias("symbol"),
    )
