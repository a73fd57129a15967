"""Writers."""

from candlemill.sinks.messages import encode_alerts, encode_end_marks, encode_trades, rejected_trades
from candlemill.sinks.streams import (
    write_bars_sink,
    write_messages,
    write_stream_files,
    write_warehouse,
)
from candlemill.sinks.tables import (
    replace_table,
    upsert_partitions,
    upsert_table,
    write_landing,
)

__all__ = [
    "encode_alerts", "encode_end_marks", "encode_trades", "rejected_trades", "replace_table", "upsert_partitions", "upsert_table",
    "write_bars_sink", "write_landing", "write_messages", "write_stream_files", "write_warehouse",
]
