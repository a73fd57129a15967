"""Bars of any number of symbols from one stream, each symbol under a watermark of its own.

A watermark of the whole stream follows the symbol that is furthest ahead, and one stream for each symbol does not
go on for thousands of them. Here a symbol's state holds its open windows and how far it is closed: up to its own
latest trade less the delay, up to an end mark in the input, or, once it has been silent for a while, to the end
of its last window. Trades that come for a closed window are given out too, with what closed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from candlemill.schemas import KEYED_ROW, OPEN_WINDOW, STREAM_BAR
from candlemill.sinks.streams import write_bars_sink
from candlemill.streaming.jobs import state_partitions

NO_ID = -(1 << 63)  # sorts before all ids, as a null does
NOT_CLOSED = -(1 << 63)
WATERMARK, END_MARK, IDLE = "watermark", "end mark", "idle"
BAR_ROW, LATE_ROW = "bar", "late"


def windows_of(rows: pd.DataFrame) -> dict[int, list]:
    """Of trades, per window start: first and last priced trade (time, id, price), high, low, volume, trades.

    Without a price, or without a quantity, in a whole window its prices, or its volume, are NaN.
    """
    rows = rows.sort_values(["start", "ts_int", "order_id", "price"], kind="stable")
    quantities = rows.groupby("start")["quantity"]
    volume, trades = quantities.sum(min_count=1), rows.groupby("start").size()
    found = {int(s): [0, 0, np.nan, 0, 0, np.nan, np.nan, np.nan, float(volume[s]), int(trades[s])] for s in trades.index}
    priced = rows[rows["price"].notna()]
    starts, first = np.unique(priced["start"].to_numpy(), return_index=True)
    if len(starts):
        last = np.append(first[1:], len(priced)) - 1
        prices = priced["price"].to_numpy()
        high, low = np.maximum.reduceat(prices, first), np.minimum.reduceat(prices, first)
        time, number = priced["ts_int"].to_numpy(), priced["order_id"].to_numpy()
        for k, start in enumerate(starts.tolist()):
            a, b = first[k], last[k]
            found[start][:8] = [int(time[a]), int(number[a]), float(prices[a]), int(time[b]), int(number[b]), float(prices[b]),
                                float(high[k]), float(low[k])]
    return found


def joined(a: list, b: list) -> list:
    """Two parts of one window."""
    if np.isnan(a[6]) or np.isnan(b[6]):
        ticks = b[:8] if np.isnan(a[6]) else a[:8]
    else:
        ticks = [*min(a[:3], b[:3]), *max(a[3:6], b[3:6]), max(a[6], b[6]), min(a[7], b[7])]
    volume = b[8] if np.isnan(a[8]) else a[8] if np.isnan(b[8]) else a[8] + b[8]
    return [*ticks, volume, a[9] + b[9]]


def output(parts: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([p.get(n) for p in parts], dtype=object) for n in KEYED_ROW.names})


class KeyedBars(StatefulProcessor):
    """Per symbol: its open windows, how far it is closed, and by what."""

    def __init__(self, interval: int, delay: int, idle_ms: int | None):
        self.interval, self.delay, self.idle_ms = interval, delay, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "until long, reason string")
        self.open = handle.getListState("open", OPEN_WINDOW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        until, reason = self.closed.get() if self.closed.exists() else (NOT_CLOSED, None)
        trades, marks = batch[~batch["mark"]], batch[batch["mark"]]
        # rows of one micro-batch have no order, so all are held against what earlier ones closed
        late = trades["start"] + self.interval <= until
        found = self._late(key, trades[late], until, reason)
        windows = {int(start): list(rest) for start, *rest in self.open.get()} if self.open.exists() else {}
        for start, part in windows_of(trades[~late]).items():
            windows[start] = joined(windows[start], part) if start in windows else part
        if len(trades) and (seen := int(trades["ts"].max()) - self.delay) > until:
            until, reason = seen, WATERMARK
        if len(marks) and (said := int(marks["ts"].max())) > until:
            until, reason = said, END_MARK
        found += self._close(key, windows, until)
        self._keep(windows, until, reason)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if windows:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if found:
            yield output(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        windows = {int(start): list(rest) for start, *rest in self.open.get()} if self.open.exists() else {}
        if windows:
            until = max(windows) + self.interval
            found = self._close(key, windows, until)
            self._keep(windows, until, IDLE)
            yield output(found)

    def _keep(self, windows: dict[int, list], until: int, reason: str | None) -> None:
        self.closed.update((until, reason))
        if windows:
            self.open.put([(start, *rest) for start, rest in windows.items()])
        else:
            self.open.clear()

    def _close(self, key, windows: dict[int, list], until: int) -> list[dict]:
        """Takes the windows that are over out of ``windows``."""
        over = sorted(start for start in windows if start + self.interval <= until)
        found = []
        for start in over:
            _, _, open_, _, _, close, high, low, volume, trades = windows.pop(start)
            prices = dict(zip(("open_price", "high_price", "low_price", "close_price", "volume"), (open_, high, low, close, volume)))
            found.append({"kind": BAR_ROW, "symbol": key[0], "start": start, "trades": trades,
                          **{n: None if np.isnan(x) else x for n, x in prices.items()}})
        return found

    def _late(self, key, trades: pd.DataFrame, until: int, reason: str | None) -> list[dict]:
        own = zip(*(trades[n].tolist() for n in ("start", "order_id", "price", "quantity", "ts_int")))
        return [
            {"kind": LATE_ROW, "symbol": key[0], "start": start, "agg_trade_id": None if number == NO_ID else number,
             "price": None if np.isnan(price) else price, "quantity": None if np.isnan(quantity) else quantity,
             "ts_int": time, "closed_until": until, "reason": reason}
            for start, number, price, quantity, time in own
        ]

    def close(self) -> None:
        pass


def keyed_rows(trades: DataFrame, interval_s: int = 900, delay_s: float = 5, idle_s: float | None = None) -> DataFrame:
    """Closed bars and late trades of a stream, in rows of ``KEYED_ROW``; ``keyed_bars`` and ``late_trades`` take them apart.

    A symbol's window closes when the symbol's own latest trade is ``delay_s`` past its end, when an end mark
    (``sinks.messages.encode_end_marks``) for a time at or past its end has come, or when the symbol has been silent for
    ``idle_s`` seconds of processing time. So neither does a symbol that runs behind lose trades to one that is
    ahead, nor one that is idle hold the others back. All rows of a micro-batch are held against what earlier ones closed.

    Trades without a time are left out; a missing or NaN price neither opens nor closes a bar, and a missing
    quantity adds nothing. A trade that comes twice counts twice. A null symbol is a symbol of its own. A symbol's rows
    of one micro-batch go to one task, whose memory ``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger`` bounds.
    """
    interval = interval_s * 1_000_000
    ts = F.unix_micros("ts")
    rows = trades.where(F.col("ts").isNotNull()).select(
        "symbol", ts.alias("ts"), (ts - F.pmod(ts, F.lit(interval))).alias("start"), F.coalesce("ts_int", ts).alias("ts_int"),
        F.coalesce("agg_trade_id", F.lit(NO_ID)).alias("order_id"), "price", "quantity",
        (F.col("agg_trade_id").isNull() & F.col("price").isNull() & F.col("quantity").isNull()).alias("mark"),
    )
    return rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=KeyedBars(interval, int(delay_s * 1_000_000), None if idle_s is None else int(idle_s * 1000)),
        outputStructType=KEYED_ROW,
        outputMode="Append",
        timeMode="None" if idle_s is None else "ProcessingTime",
    )


def _window(interval_s: int) -> dict:
    start = F.timestamp_micros("start")
    return {"window_start": start, "window_end": F.timestamp_micros(F.col("start") + interval_s * 1_000_000), "landing_date": F.to_date(start)}


def keyed_bars(rows: DataFrame, interval_s: int = 900) -> DataFrame:
    """The bars among ``keyed_rows``, in the form of ``stream_klines``."""
    rounded = {n: F.round(n, 1 if n == "volume" else 4) for n in STREAM_BAR.names[4:]}
    return rows.where(F.col("kind") == BAR_ROW).withColumns(_window(interval_s) | rounded).select(*STREAM_BAR.names)


def late_trades(rows: DataFrame, interval_s: int = 900) -> DataFrame:
    """The trades among ``keyed_rows`` that came for a closed window, how far their symbol was closed, and by what."""
    return rows.where(F.col("kind") == LATE_ROW).withColumns(_window(interval_s)).select(
        "symbol", "landing_date", "window_start", "window_end", "agg_trade_id", "price", "quantity", "ts_int",
        F.timestamp_micros("closed_until").alias("closed_until"), "reason",
    )


def start_keyed_job(
    trades: DataFrame, bars_path: str, late_path: str, checkpoint: str, interval_s: int = 900, delay_s: float = 5,
    idle_s: float | None = None, once: bool = False, parallelism: int | None = None,
) -> StreamingQuery:
    """Bars to one table and late trades to another, from one query. A micro-batch that is run again replaces its own rows.

    ``once`` takes what is there now and stops. ``parallelism``, the number of state partitions, is fixed by the first start.
    """
    def both(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            if batch_id and rows.isEmpty():  # a look at the timers; the first one writes, so that the tables are there
                return
            write_bars_sink(keyed_bars(rows, interval_s), bars_path, batch_id)
            write_bars_sink(late_trades(rows, interval_s), late_path, batch_id)
        finally:
            rows.unpersist()

    writer = keyed_rows(trades, interval_s, delay_s, idle_s).writeStream.outputMode("append").foreachBatch(both)
    writer = writer.option("checkpointLocation", checkpoint)
    with state_partitions(trades.sparkSession, parallelism):
        return (writer.trigger(availableNow=True) if once else writer).start()
