"""Moving averages, exponential averages, RSI, MACD and trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlemill.functions.columns import half_up
from candlemill.functions.recurrences import (
    Averages,
    DayAverages,
    DecimalAverage,
    Macd,
    Rsi,
    trunc_half_up,
)
from candlemill.operators.chunks import (
    CHUNK,
    SPAN,
    bucket_chunk,
    chunk_block,
    chunk_window,
    packed,
    packed_by_rows,
    with_halo,
    without_halo,
)
from candlemill.operators.ordered import scan


def sma(
    bars: DataFrame,
    n: int = 7,
    partial: str = "available",
    digits: int | None = 2,
    value: str = "close_price",
    name: str | None = None,
    keys: Sequence[str] = ("symbol",),
    order: str = "group_id",
    span: int = SPAN,
) -> DataFrame:
    """Mean of the last ``n`` bars.

    The first bars have fewer than ``n``: ``partial="available"`` divides by the bars there are,
    ``"full"`` by ``n`` all the same.
    """
    name = name or {"available": f"sma{n}", "full": f"ma{n}"}[partial]
    w = chunk_window(keys, order).rowsBetween(-(n - 1), 0)
    mean = F.avg(value).over(w) if partial == "available" else F.sum(value).over(w) / n
    led = with_halo(bars, n - 1, [value], keys, order, span)
    rounded = mean if digits is None else F.round(mean, digits)
    return without_halo(led.withColumn(name, rounded)).drop(CHUNK)


def _rounded(df: DataFrame, names: Sequence[str], digits: int | None) -> DataFrame:
    return df if digits is None else df.withColumns({n: half_up(n, digits) for n in names})


def ema(
    bars: DataFrame,
    periods: Sequence[int] = (7, 20),
    scope: str = "continuous",
    seed: str = "sma",
    digits: int | None = 4,
    arithmetic: str = "double",
    seed_column: str | None = None,
    value: str = "close_price",
    keys: Sequence[str] = ("symbol",),
    order: str = "group_id",
    span: int = SPAN,
    previous: DataFrame | None = None,
    lags: dict[str, tuple[str, int]] | None = None,
) -> DataFrame:
    """Exponential averages ``ema<n>``.

    ``seed="sma"``: null for n-1 values, then the mean of the first n. ``"first"``: starts at the
    first value. ``"column"`` (with ``arithmetic="decimal"``, one period): starts at ``seed_column``
    and is kept in 28-digit decimals, two places out.

    ``scope="continuous"`` runs through all rows of a key. ``scope="day"`` starts every
    ``landing_date`` from the rounded average of the last bar of the day before, or afresh if that
    day is missing or ended without one; ``previous`` holds such rows stored by an earlier run.

    ``lags`` (``name: (column, k)``) also adds values of ``k`` bars earlier: of the same day in the day
    scope.
    """
    names = [f"ema{n}" for n in periods]
    if arithmetic == "decimal":
        if seed != "column" or len(periods) != 1 or scope != "continuous":
            raise ValueError("decimal averages take one period, a start column and no day scope")
        return scan(
            bars, DecimalAverage(periods[0]), [value, seed_column],
            {names[0]: T.DoubleType()}, packed(bars, keys, [order], bucket_chunk(order, span)), keys, [order],
        )
    outputs = {n: T.DoubleType() for n in names}
    averages = DayAverages(periods, digits) if scope == "day" else Averages(periods, seed)
    if scope == "continuous":
        chunks = packed(bars, keys, [order], bucket_chunk(order, span))
        raw = scan(bars, averages, [value], outputs, chunks, keys, [order], lags=lags)
        return _rounded(raw, names, digits)
    if scope != "day" or seed != "sma" or digits is None:
        raise ValueError("the day scope carries rounded, mean-started averages")

    def overnight(state, last_null, day, next_day):
        start = averages.start()
        if next_day == day + 1 and not last_null:
            for i, n in enumerate(periods):
                if state[2 * i] >= n:
                    start[2 * i : 2 * i + 2] = [float(n), trunc_half_up(state[2 * i + 1], digits)]
        return start

    given = None
    if previous is not None:
        newest = F.max(F.struct("landing_date", order, *names)).alias("_last")
        state = F.array(*[
            part for n, period in zip(names, periods) for part in (
                F.when(F.col(n).isNotNull(), float(period)).otherwise(0.0),
                F.coalesce(F.col(n), F.lit(0.0)),
            )
        ])
        given = previous.groupBy(*keys).agg(newest).select(*keys, "_last.*").select(
            *keys, F.unix_date("landing_date").cast("long").alias(CHUNK), state.alias("_state")
        )
    raw = scan(
        bars, averages, [value], outputs, packed(bars, keys, [order], F.unix_date("landing_date")), keys, [order],
        between=overnight, given=given, lags=lags, lags_over_chunks=False,
    )
    return _rounded(raw, names, digits)


def ema_chunked(
    rows: DataFrame,
    period: int = 7,
    value: str = "price",
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("timestamp", "agg_trade_id"),
    seed: str = "first",
    chunk_rows: int = 2 * SPAN,
    piece_rows: int | None = None,
) -> DataFrame:
    """Exponential average over rows of any density, such as every single trade.

    Chunks are cut by row count, so one key with most of the rows, or many rows at one instant, is
    spread over the cluster all the same; and their summaries are gathered in two levels. The rows are sorted in as
    many parts as a shuffle has, or in parts of about ``piece_rows``, which takes a count first.
    """
    return scan(
        rows, Averages([period], seed), [value], {f"ema{period}": T.DoubleType()},
        packed_by_rows(rows, keys, order, chunk_rows, piece_rows), keys, order, block=chunk_block(chunk_rows),
    )


def rsi(
    bars: DataFrame,
    period: int = 6,
    value: str = "close_price",
    keys: Sequence[str] = ("symbol",),
    order: str = "group_id",
    span: int = SPAN,
) -> DataFrame:
    return scan(
        bars, Rsi(period), [value], {f"rsi{period}": T.DoubleType()},
        packed(bars, keys, [order], bucket_chunk(order, span)), keys, [order],
    )


def macd(
    bars: DataFrame,
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    digits: int | None = 2,
    value: str = "close_price",
    keys: Sequence[str] = ("symbol",),
    order: str = "group_id",
    span: int = SPAN,
) -> DataFrame:
    """Every column is rounded on its own, from unrounded averages."""
    names = [f"ema{fast}", f"ema{slow}", "macd", "signal", "histogram"]
    raw = scan(
        bars, Macd(fast, slow, signal), [value], {n: T.DoubleType() for n in names},
        packed(bars, keys, [order], bucket_chunk(order, span)), keys, [order],
    )
    return _rounded(raw, names, digits)


def trend(df: DataFrame, fast: str = "ema7", slow: str = "ema20", name: str = "trend") -> DataFrame:
    """Which average is above; null while either is missing and where they are equal."""
    up, down = F.col(fast) > F.col(slow), F.col(fast) < F.col(slow)
    return df.withColumn(name, F.when(up, "uptrend").when(down, "downtrend"))
