"""Trades, bars and pattern rows as unbounded tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlemill.functions.columns import event_time
from candlemill.schemas import STREAM_BAR, STREAM_PATTERN, TRADE, TRADE_MESSAGE
from candlemill.sources.files import name_tags


def topic_options(
    servers: str, topic: str, partitions: Sequence[int] | None = None, max_offsets: int | None = None
) -> dict[str, str]:
    """Options of a topic read from its beginning, all of it or chosen partitions.

    ``max_offsets`` bounds a micro-batch, so that a long backlog is not taken in one.
    """
    options = {"kafka.bootstrap.servers": servers, "startingOffsets": "earliest"}
    if max_offsets is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    if partitions is None:
        return options | {"subscribe": topic}
    return options | {"assign": json.dumps({topic: list(partitions)})}


def read_topic(
    spark: SparkSession, servers: str, topic: str,
    partitions: Sequence[int] | None = None, max_messages: int | None = None,
) -> DataFrame:
    """A look at a topic as text, all of it or, of chosen partitions, the messages at offsets below
    ``max_messages``: nothing beyond them is read. (A partition whose first messages have expired begins later.)
    """
    options = topic_options(servers, topic, partitions)
    if max_messages is not None:
        if partitions is None:
            raise ValueError("max_messages needs the partitions it applies to")
        options["endingOffsets"] = json.dumps({topic: {str(p): max_messages for p in partitions}})
    rows = spark.read.format("kafka").options(**options).load()
    return rows.select("partition", "offset", F.col("value").cast("string").alias("value"))


def _messages(spark: SparkSession, source: str, format: str, options: dict) -> DataFrame:
    """Message bodies in a column ``value``: of a topic, or one per line of the files in a folder."""
    reader = spark.readStream.options(**options)
    if format == "kafka":
        return reader.format("kafka").load().select(F.col("value").cast("string").alias("value"))
    return reader.text(source)


def parse_messages(messages: DataFrame, schema: T.StructType, required: str) -> DataFrame:
    """Rows from JSON text in ``value``.

    Text that is no JSON gives a row of nulls, and a bad field only a null field, so the rows to skip
    are those without the ``required`` field.
    """
    rows = messages.select(F.from_json("value", schema).alias("m")).select("m.*")
    return rows.where(F.col(required).isNotNull())


def read_trades_stream(
    spark: SparkSession,
    source: str = "",
    format: str = "kafka",
    symbol: str | None = None,
    unit: str = "us",
    options: dict | None = None,
) -> DataFrame:
    """Trades with event time ``ts``. ``format``: ``kafka``, ``json`` (lines) or ``csv`` (trade files).

    ``symbol`` names the symbol of input that does not carry one; otherwise CSV files are expected to
    carry it in their name.
    """
    options = dict(options or {})
    if format == "csv":
        rows = spark.readStream.options(**options).schema(TRADE).option("header", "false").csv(source)
        tag = F.lit(symbol) if symbol else name_tags(F.col("_metadata.file_name"))["symbol"]
        rows = rows.withColumn("symbol", tag).withColumnRenamed("timestamp", "ts_int")
        rows = rows.where(F.col("ts_int").isNotNull())
    else:
        rows = parse_messages(_messages(spark, source, format, options), TRADE_MESSAGE, "ts_int")
        if symbol:
            rows = rows.withColumn("symbol", F.lit(symbol))
    return rows.withColumn("ts", event_time("ts_int", unit))


def read_trades_by_partition(
    spark: SparkSession, servers: str, topic: str, partitions: Sequence[int], unit: str = "us",
    max_offsets: int | None = None,
) -> list[DataFrame]:
    """One stream per topic partition (a symbol each), for ``start_pattern_job``; ``max_offsets`` for each."""
    return [
        read_trades_stream(spark, unit=unit, options=topic_options(servers, topic, [p], max_offsets))
        for p in partitions
    ]


def read_bars_stream(
    spark: SparkSession, path: str, symbol: str | None = None, options: dict | None = None
) -> DataFrame:
    """Stored bars, as CSV files with or (given ``symbol``) without a symbol column."""
    fields = [f for f in STREAM_BAR.fields if not (symbol and f.name == "symbol")]
    rows = spark.readStream.options(**(options or {})).schema(T.StructType(fields)).csv(path)
    if symbol:
        rows = rows.withColumn("symbol", F.lit(symbol))
    return rows.select(*STREAM_BAR.names)


def read_patterns_stream(
    spark: SparkSession, source: str = "", format: str = "kafka", options: dict | None = None
) -> DataFrame:
    """Pattern alerts as published by ``sinks.messages.encode_alerts``."""
    return parse_messages(
        _messages(spark, source, format, dict(options or {})), STREAM_PATTERN, "window_start"
    )
