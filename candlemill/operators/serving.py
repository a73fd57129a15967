"""Shapes the charting queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plot_bars(bars: DataFrame, columns=("open_price", "high_price", "low_price", "close_price", "volume")) -> DataFrame:
    """Bars (or an average, by naming its column) with a readable time, in time order."""
    keys = ["symbol"] if "symbol" in bars.columns else []
    return bars.select(
        F.timestamp_micros("open_time").alias("time"), *keys, *columns
    ).orderBy("time", *keys)


def chart_series(
    rows: DataFrame, symbol: str, t_from: str, t_to: str,
    time: str = "window_start", pattern: str = "engulfing_pattern",
) -> DataFrame:
    """One symbol's bars between two times, with the close repeated where a pattern was found.

    A bound that is no timestamp becomes null and leaves no rows, as a failed parse should. Tables stored by
    ``landing_date`` are only opened at the days between the bounds.
    """
    bounds = [F.try_to_timestamp(F.lit(t)) for t in (t_from, t_to)]
    if "landing_date" in rows.columns:
        rows = rows.where(F.col("landing_date").between(*[b.cast("date") for b in bounds]))
    return (
        rows.where((F.col("symbol") == symbol) & F.col(time).between(*bounds))
        .select(
            F.col(time).alias("time"),
            "open_price", "high_price", "low_price", "close_price", "volume", "ema7", "ema20",
            F.when(F.col(pattern).isNotNull(), F.col("close_price")).alias("engulfing_close"),
        )
        .orderBy("time")
    )
