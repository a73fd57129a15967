"""Declared schemas; nothing in the library infers one."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    """Fields from ``name type, ...`` (type names as Spark's JSON schemas spell them)."""
    schema = T.StructType()
    for field in text.split(", "):
        schema = schema.add(*field.split(" "))
    return schema


TRADE = _struct(
    "agg_trade_id long, price double, quantity double, first_trade_id long, "
    "last_trade_id long, timestamp long, is_buyer_maker boolean, is_best_match boolean"
)
TRADE_MESSAGE = _struct(
    "agg_trade_id long, price double, quantity double, first_trade_id long, "
    "last_trade_id long, ts_int long, is_buyer_maker boolean, is_best_match boolean, symbol string"
)
BAR = _struct(
    "group_id long, group_date string, open_time long, open_price double, high_price double, "
    "low_price double, close_price double, volume double, close_time long, "
    "landing_date date, symbol string"
)
STREAM_BAR = _struct(
    "window_start timestamp, window_end timestamp, symbol string, landing_date date, "
    "open_price double, high_price double, low_price double, close_price double, volume double"
)
STREAM_PATTERN = T.StructType(
    STREAM_BAR.fields
    + _struct("ema7 double, ema20 double, trend string, engulfing_pattern string").fields
)
# What a symbol keeps of a window that is open, and what it gives out: closed bars and late trades.
OPEN_WINDOW = _struct(
    "start long, first_time long, first_id long, open_price double, last_time long, last_id long, close_price double, "
    "high_price double, low_price double, volume double, trades long"
)
KEYED_ROW = _struct(
    "kind string, symbol string, start long, open_price double, high_price double, low_price double, "
    "close_price double, volume double, trades long, agg_trade_id long, price double, quantity double, "
    "ts_int long, closed_until long, reason string"
)
