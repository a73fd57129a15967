"""The engulfing pattern as a keyed state, and its counterpart on bounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from candlemill.functions.recurrences import Averages, missing, trunc_half_up
from candlemill.operators.chunks import SPAN
from candlemill.operators.patterns import pattern_two
from candlemill.schemas import STREAM_PATTERN

DIGITS = 4
STATE = T.StructType()
for _field in ("count7", "level7", "count20", "level20"):
    STATE = STATE.add(_field, "string")
for _field in ("prev_open", "prev_close"):
    STATE = STATE.add(_field, "double")


def trend_of(fast, slow):
    if missing(fast) or missing(slow) or fast == slow:
        return None
    return "uptrend" if fast > slow else "downtrend"


def engulfing_of(before_open, before_close, open_, close, trend):
    if any(missing(x) for x in (before_open, before_close, open_, close)):
        return None
    red_then_green = before_close < before_open and close > open_
    green_then_red = before_close > before_open and close < open_
    if red_then_green and open_ < before_close and close > before_open:
        return "bullish engulfing" if trend == "downtrend" else None
    if green_then_red and open_ > before_close and close < before_open:
        return "bearish engulfing" if trend == "uptrend" else None
    return None


class EngulfingProcessor(StatefulProcessor):
    """Per symbol: both averages (unrounded) and the last bar's body. A few numbers, whatever the age."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.averages = Averages([7, 20])
        self.state = handle.getValueState("engulfing", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The windows of one key that closed in this micro-batch come in any order.
        bars = pd.concat(list(rows)).sort_values("window_start", ignore_index=True)
        if self.state.exists():
            *levels, before_open, before_close = self.state.get()
        else:
            levels, before_open, before_close = self.averages.start(), None, None
        closes = [None if missing(c) else float(c) for c in bars["close_price"]]
        (fast, slow), levels = self.averages.run(closes, list(levels))
        trends, labels = [], []
        for open_, close, f, s in zip(bars["open_price"], closes, fast, slow):
            trends.append(trend_of(f, s))
            labels.append(engulfing_of(before_open, before_close, open_, close, trends[-1]))
            before_open, before_close = open_, close
        last = [float("nan") if missing(x) else float(x) for x in (before_open, before_close)]
        self.state.update((*levels, *last))
        for name, values in (("ema7", fast), ("ema20", slow)):
            bars[name] = [None if v is None else trunc_half_up(v, DIGITS) for v in values]
        bars["trend"], bars["engulfing_pattern"] = trends, labels
        yield bars[STREAM_PATTERN.names]

    def close(self) -> None:
        pass


def stream_patterns(bars: DataFrame) -> DataFrame:
    """Bars with averages, trend (on unrounded averages) and pattern, on a stream."""
    return bars.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=EngulfingProcessor(),
        outputStructType=STREAM_PATTERN,
        outputMode="Append",
        timeMode="None",
    )


def bounded_patterns(bars: DataFrame, interval_s: int = 900, span: int = SPAN) -> DataFrame:
    """What ``stream_patterns`` gives, for bars that are all there: spread over chunks of a symbol."""
    bucket = F.expr(f"unix_seconds(window_start) div {int(interval_s)}")
    found = pattern_two(bars.withColumn("group_id", bucket), scope="continuous", on="raw", digits=DIGITS, span=span)
    return found.withColumnRenamed("pattern", "engulfing_pattern").select(*STREAM_PATTERN.names)
