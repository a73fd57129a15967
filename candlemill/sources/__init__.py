"""Readers."""

from candlemill.sources.files import (
    between_dates,
    read_landing,
    read_text_trades,
    read_trades_csv,
    read_trades_zip,
)
from candlemill.sources.streams import (
    read_bars_stream,
    read_patterns_stream,
    read_topic,
    read_trades_by_partition,
    read_trades_stream,
    topic_options,
)

__all__ = [
    "between_dates", "read_bars_stream", "read_landing", "read_patterns_stream", "read_text_trades",
    "read_topic", "read_trades_by_partition", "read_trades_csv", "read_trades_stream", "read_trades_zip", "topic_options",
]
