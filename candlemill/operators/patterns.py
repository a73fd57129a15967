"""Candlestick patterns, as projections over a bar and the one or two bars before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.functions.columns import half_up
from candlemill.operators.chunks import SPAN
from candlemill.operators.indicators import ema, trend

AVERAGES = ["ema7", "ema20"]


def with_trend(
    bars: DataFrame,
    digits: int,
    on: str = "rounded",
    scope: str = "continuous",
    keys: Sequence[str] = ("symbol",),
    span: int = SPAN,
    previous: DataFrame | None = None,
    lags: dict[str, tuple[str, int]] | None = None,
) -> DataFrame:
    """Bars with ema7, ema20 and trend (and ``lags``, as in ``ema``). ``on="raw"`` compares the averages before rounding them."""
    if on == "raw":
        if scope == "day":
            raise ValueError("the day scope carries rounded averages; use on='rounded'")
        df = trend(ema(bars, digits=None, keys=keys, span=span, lags=lags))
        return df.withColumns({n: half_up(n, digits) for n in AVERAGES})
    return trend(
        ema(bars, scope=scope, digits=digits, keys=keys, span=span, previous=previous, lags=lags)
    )


def pattern_one(bars: DataFrame, digits: int = 2, span: int = SPAN) -> DataFrame:
    """Hammer and hanging man."""
    o, c = F.col("open_price"), F.col("close_price")
    body = F.abs(c - o)
    lower = F.least(o, c) - F.col("low_price")
    upper = F.col("high_price") - F.greatest(o, c)
    shape = (body > 0) & (lower >= 2 * body) & (upper <= 0.25 * body)
    label = (
        F.when(shape & (F.col("trend") == "uptrend"), "hanging man")
        .when(shape & (F.col("trend") == "downtrend"), "hammer")
    )
    return with_trend(bars, digits, span=span).select(
        "symbol", "group_id", "group_date", "close_price", "trend", label.alias("pattern")
    )


def pattern_two(
    bars: DataFrame,
    scope: str = "day",
    on: str = "rounded",
    digits: int = 4,
    span: int = SPAN,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Engulfing: a body that reaches past both ends of the opposite body before it, against the trend.

    In the day scope a day's first bar has no bar before it.
    """
    lags = {"_prev_open": ("open_price", 1), "_prev_close": ("close_price", 1)}
    df = with_trend(bars, digits, on, scope, span=span, previous=previous, lags=lags)
    return df.withColumn("pattern", engulfing()).drop(*lags)


def engulfing():
    o, c = F.col("open_price"), F.col("close_price")
    before_o, before_c = F.col("_prev_open"), F.col("_prev_close")
    bullish = (before_c < before_o) & (c > o) & (o < before_c) & (c > before_o)
    bearish = (before_c > before_o) & (c < o) & (o > before_c) & (c < before_o)
    return (
        F.when(bullish & (F.col("trend") == "downtrend"), "bullish engulfing")
        .when(bearish & (F.col("trend") == "uptrend"), "bearish engulfing")
    )


def pattern_three(bars: DataFrame, digits: int = 2, span: int = SPAN) -> DataFrame:
    """Morning and evening stars, plain before doji: a bar that is both is called plain."""
    lags = {
        "_o1": ("open_price", 2), "_c1": ("close_price", 2),
        "_o2": ("open_price", 1), "_c2": ("close_price", 1),
        "_h2": ("high_price", 1), "_l2": ("low_price", 1),
    }
    df = with_trend(bars, digits, span=span, lags=lags)
    o1, c1, o2, c2, h2, l2 = (F.col(n) for n in lags)
    o3, c3 = F.col("open_price"), F.col("close_price")
    middle, half = F.abs(c2 - o2), (o1 + c1) / 2
    small, doji = middle <= 0.5 * F.abs(o1 - c1), middle <= 0.1 * (h2 - l2)
    morning = (
        (c1 < o1) & (c2 < c1) & (o2 < c1) & (c3 > o3) & (c3 >= half)
        & (F.col("trend") == "downtrend")
    )
    evening = (
        (c1 > o1) & (o2 > c1) & (c2 > c1) & (c3 < o3) & (c3 <= half)
        & (F.col("trend") == "uptrend")
    )
    label = (
        F.when(morning & small, "morning star")
        .when(evening & small, "evening star")
        .when(morning & doji, "morning doji star")
        .when(evening & doji, "evening doji star")
    )
    return df.select(
        "symbol", "group_id", "group_date", "close_price", "trend", label.alias("pattern")
    )
