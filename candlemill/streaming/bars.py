"""Bars over event time. The same code runs on bounded input, where every window closes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.schemas import STREAM_BAR


def union_by_symbol(streams: Sequence[DataFrame], delay: str = "5 seconds") -> DataFrame:
    """Streams of one symbol (or topic partition) each, under the slowest one's watermark.

    A single watermark over all symbols follows the fastest, and would drop the trades of a symbol
    that runs behind; here each stream has its own and Spark keeps the smallest.
    """
    return reduce(DataFrame.unionByName, [s.withWatermark("ts", delay) for s in streams])


def stream_klines(
    trades: DataFrame, interval: str = "15 minutes", delay: str | None = "5 seconds"
) -> DataFrame:
    """One row per symbol and window, once the watermark has passed its end; later trades are dropped.

    ``delay=None`` leaves a watermark the input already has.
    """
    if delay is not None:
        trades = trades.withWatermark("ts", delay)
    tick = F.when(F.col("price").isNotNull(), F.struct("ts_int", "agg_trade_id", "price"))
    bars = trades.groupBy(F.window("ts", interval), "symbol").agg(
        F.round(F.min(tick).getField("price"), 4).alias("open_price"),
        F.round(F.max("price"), 4).alias("high_price"),
        F.round(F.min("price"), 4).alias("low_price"),
        F.round(F.max(tick).getField("price"), 4).alias("close_price"),
        F.round(F.sum("quantity"), 1).alias("volume"),
    )
    start = F.col("window.start")
    return bars.select(
        start.alias("window_start"), F.col("window.end").alias("window_end"), "symbol",
        F.to_date(start).alias("landing_date"), *STREAM_BAR.names[4:],
    )
