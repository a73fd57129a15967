"""The live job: trades to bars to patterns, with three outputs from one query."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from candlemill.operators.projections import only_patterns
from candlemill.schemas import STREAM_BAR
from candlemill.sinks.messages import encode_alerts
from candlemill.sinks.streams import write_bars_sink, write_messages
from candlemill.streaming.bars import stream_klines, union_by_symbol
from candlemill.streaming.patterns import bounded_patterns, stream_patterns


def start_pattern_job(
    trades: DataFrame | Sequence[DataFrame],
    bars_path: str,
    patterns_path: str,
    alerts_target: str,
    checkpoint: str,
    interval: str = "15 minutes",
    delay: str | None = "5 seconds",
    alerts_only_patterns: bool = True,
    alerts_format: str = "json",
    alerts_options: dict | None = None,
    keyed_alerts: bool = True,
    once: bool = False,
    parallelism: int | None = None,
) -> StreamingQuery:
    """Start it. ``trades`` is one stream, whose symbols must keep pace with one another, or a list of streams, one
    for each symbol or topic partition: each then has a watermark of its own and the slowest one counts,
    so that a symbol that runs hours behind loses nothing.

    Bars are columns of the pattern rows, so a micro-batch is computed once, kept, and
    written three times; each write can be repeated after a failure without doubling rows (a topic
    gets at-least-once). ``once`` takes what is there now and stops: windows the watermark has not
    passed stay open, so for input that has an end use ``bounded_pattern_job``.

    ``parallelism`` is the number of state partitions (the session's shuffle partitions unless given),
    fixed for good by the first start with a checkpoint; the topic's partitions are a good measure.
    """

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            write_bars_sink(rows.select(*STREAM_BAR.names), bars_path, batch_id)
            write_bars_sink(rows, patterns_path, batch_id)
            alerts = only_patterns(rows, "engulfing_pattern") if alerts_only_patterns else rows
            messages = encode_alerts(alerts, keyed_alerts)
            write_messages(messages, alerts_target, batch_id, alerts_format, alerts_options)
        finally:
            rows.unpersist()

    if not isinstance(trades, DataFrame):
        trades, delay = union_by_symbol(trades, delay or "0 seconds"), None
    watch_progress(trades.sparkSession)
    patterns = stream_patterns(stream_klines(trades, interval, delay))
    writer = patterns.writeStream.outputMode("append").foreachBatch(fan_out)
    writer = writer.option("checkpointLocation", checkpoint)
    with state_partitions(trades.sparkSession, parallelism):
        return (writer.trigger(availableNow=True) if once else writer).start()


@contextmanager
def state_partitions(spark: SparkSession, number: int | None) -> Iterator[None]:
    """Queries started inside keep their state in ``number`` partitions."""
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    if number is not None:
        spark.conf.set(setting, str(number))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def bounded_pattern_job(trades: DataFrame, interval_s: int = 900) -> DataFrame:
    """The same rows for trades that are all there; the end of the input closes every window."""
    bars = stream_klines(trades, f"{interval_s} seconds", delay=None)
    return bounded_patterns(bars, interval_s)


class ProgressTotals(StreamingQueryListener):
    """Adds up what every micro-batch of every query reports (Spark keeps only the last hundred reports)."""

    def __init__(self):
        self.of: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = self.of.setdefault(str(p.runId), {"rows_read": 0, "rows_dropped_late": 0, "batch": -1})
        own["rows_read"] += p.numInputRows
        own["rows_dropped_late"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        own["batch"] = p.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


_totals: dict[str, ProgressTotals] = {}


def watch_progress(spark: SparkSession) -> ProgressTotals:
    """Count the progress of all queries that this session starts from now on."""
    app = spark.sparkContext.applicationId
    if app not in _totals:
        _totals[app] = ProgressTotals()
        spark.streams.addListener(_totals[app])
    return _totals[app]


def stream_metrics(query: StreamingQuery, patience_s: float = 10.0) -> dict[str, int]:
    """Rows read, and rows dropped because their window had closed, since the query started.

    ``watch_progress`` must have been called before the start (``start_pattern_job`` does). Reports reach it a
    moment after their micro-batch, so this waits for the latest.
    """
    session = SparkSession.active()
    totals = _totals.get(session.sparkContext.applicationId)
    if totals is None:
        raise RuntimeError("call watch_progress before starting the query")
    last, until = query.lastProgress, time.monotonic() + patience_s
    nothing = {"rows_read": 0, "rows_dropped_late": 0, "batch": -1}
    while (found := totals.of.get(str(query.runId), nothing))["batch"] < (last.batchId if last else -1):
        if time.monotonic() > until:
            raise TimeoutError("the latest report has not arrived")
        time.sleep(0.05)
    return {n: found[n] for n in ("rows_read", "rows_dropped_late")}
