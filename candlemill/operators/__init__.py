"""DataFrame -> DataFrame steps."""

from candlemill.operators.bars import bucket_stats, klines
from candlemill.operators.indicators import ema, ema_chunked, macd, rsi, sma, trend
from candlemill.operators.patterns import pattern_one, pattern_three, pattern_two, with_trend
from candlemill.operators.profile import (
    describe_trades,
    last_bar,
    latest,
    matching,
    null_profile,
    page,
    page_total,
    partition_counts,
    row_counts,
    sample_trades,
    symbols,
    unequal_matches,
)
from candlemill.operators.projections import (
    add_ingest_columns,
    add_time_bucket,
    backfill_nulls,
    cast_trades,
    only_patterns,
    tag_run,
)
from candlemill.operators.serving import chart_series, plot_bars

__all__ = [
    "add_ingest_columns", "add_time_bucket", "backfill_nulls", "bucket_stats", "cast_trades",
    "chart_series", "describe_trades", "ema", "ema_chunked", "klines", "last_bar", "latest", "macd",
    "matching", "null_profile", "only_patterns", "page", "page_total", "partition_counts",
    "pattern_one", "pattern_three", "pattern_two", "plot_bars", "row_counts", "rsi",
    "sample_trades", "sma", "symbols", "tag_run", "trend", "unequal_matches", "with_trend",
]
