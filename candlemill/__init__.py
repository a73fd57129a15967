"""candlemill: trade ticks to bars, indicators, candlestick patterns and alerts, as Spark jobs.

* ``candlemill.sources``    files, archives, landing tables, message streams
* ``candlemill.operators``  DataFrame -> DataFrame steps (bars, indicators, patterns, profiles)
* ``candlemill.streaming``  the same steps on unbounded input
* ``candlemill.sinks``      partitioned tables, encoded messages, streaming sinks
* ``candlemill.plans``      whole jobs: one day, a date range, the live pattern job
"""

from candlemill.session import drop_staged, prepare, session, stage

__all__ = ["drop_staged", "prepare", "session", "stage"]
