"""Structured Streaming: bars, patterns and the live job."""

from candlemill.streaming.bars import stream_klines, union_by_symbol
from candlemill.streaming.jobs import (
    bounded_pattern_job,
    start_pattern_job,
    state_partitions,
    stream_metrics,
    watch_progress,
)
from candlemill.streaming.keyed import keyed_bars, keyed_rows, late_trades, start_keyed_job
from candlemill.streaming.patterns import EngulfingProcessor, bounded_patterns, stream_patterns

__all__ = [
    "EngulfingProcessor", "bounded_pattern_job", "bounded_patterns", "keyed_bars", "keyed_rows",
    "late_trades", "start_keyed_job", "start_pattern_job", "state_partitions",
    "stream_klines", "stream_metrics", "stream_patterns", "union_by_symbol", "watch_progress",
]
