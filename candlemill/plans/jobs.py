"""Whole batch jobs: files to landing, trades, bars and pattern tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.functions.columns import event_time
from candlemill.operators.bars import klines
from candlemill.operators.patterns import pattern_two
from candlemill.operators.projections import (
    BAR_SECONDS,
    add_ingest_columns,
    add_time_bucket,
    tag_run,
)
from candlemill.schemas import TRADE
from candlemill.session import stage
from candlemill.sinks.tables import PARTITIONS, upsert_partitions, write_landing
from candlemill.sources.files import between_dates, read_trades_csv, read_trades_zip

READERS = {"csv": read_trades_csv, "zip": read_trades_zip}
LANDING, TRADES = "landing/aggtrades", "transform/aggtrades"
BARS, PATTERNS = "serving/klines", "serving/pattern_two"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def land(spark: SparkSession, source: str, root: str, start=None, end=None,
         symbols: Sequence[str] | None = None, unit: str = "us", format: str | None = None) -> None:
    """Files or archives into the landing folder, any number of symbols and days at once.

    Names carry the symbol and the day; trades of a file without a day in its name (a month file) are
    landed by the day they happened.

    ``format`` is ``csv`` or ``zip``; it may be left out where the path ends in one of these. A row of which no
    field parses means that the input is no trade file, and fails the job.
    """
    format = format or source.lower().rpartition(".")[2]
    if format not in READERS:
        raise ValueError(f"state the format of {source}: csv or zip")
    trades = READERS[format](spark, source, tag_from_name=True)
    unreadable = F.forall(F.array(*[F.col(n).isNull() for n in TRADE.names]), lambda x: x)
    trades = trades.where(F.when(unreadable, F.raise_error(F.lit(f"no field of a row in {source} parses"))).otherwise(F.lit(True)))
    named, outside = F.col("landing_date"), F.lit(False)
    if start is not None:
        outside = outside | (named < F.lit(str(start)).cast("date"))
    if end is not None:
        outside = outside | (named > F.lit(str(end)).cast("date"))
    happened = F.to_date(event_time("timestamp", unit))
    wanted = between_dates(
        # on the name alone, so that files of other days need not be opened
        trades.where(named.isNull() | ~outside)
        .withColumn("landing_date", F.coalesce(named, happened)),
        start, end, symbols,
    )
    write_landing(add_ingest_columns(wanted), f"{root}/{LANDING}")


def transform(spark: SparkSession, root: str, start=None, end=None,
              symbols: Sequence[str] | None = None, interval_s: int = BAR_SECONDS,
              unit: str = "us", ids_follow_time: bool = False) -> None:
    """Landed trades to the trade table and to bars, for every symbol and day at once."""
    landed = between_dates(spark.read.parquet(f"{root}/{LANDING}"), start, end, symbols)
    bucketed = tag_run(add_time_bucket(landed, interval_s, unit))
    upsert_partitions(bucketed, f"{root}/{TRADES}", together=False)
    trades = between_dates(spark.read.parquet(f"{root}/{TRADES}"), start, end, symbols)
    bars = klines(trades, interval_s, ("landing_date", "symbol"), unit=unit,
                  ids_follow_time=ids_follow_time)
    upsert_partitions(bars, f"{root}/{BARS}")


def _last_stored(spark: SparkSession, root: str, day: date) -> DataFrame | None:
    """The pattern rows of ``day`` from an earlier run, copied out before the table is written to."""
    path = f"{root}/{PATTERNS}"
    if not _exists(spark, path):
        return None
    rows = between_dates(spark.read.parquet(path), day, day)
    return stage(rows.select("symbol", "landing_date", "group_id", "ema7", "ema20"), "previous")


def find_patterns(spark: SparkSession, root: str, start: date | None = None,
                  end: date | None = None, symbols: Sequence[str] | None = None,
                  scope: str = "day") -> None:
    """Bars to pattern rows.

    Within the range the days of a symbol follow from one another in one job; the day before the range
    is taken from what an earlier run stored.
    """
    bars = between_dates(spark.read.parquet(f"{root}/{BARS}"), start, end, symbols)
    previous = None
    if scope == "day" and start is not None:
        previous = _last_stored(spark, root, start - timedelta(days=1))
        if previous is not None and symbols is not None:
            previous = previous.where(F.col("symbol").isin(list(symbols)))
    rows = pattern_two(bars, scope=scope, previous=previous)
    upsert_partitions(rows, f"{root}/{PATTERNS}", PARTITIONS)


def run_range(spark: SparkSession, source: str, root: str, start: date | None = None,
              end: date | None = None, symbols: Sequence[str] | None = None, scope: str = "day",
              interval_s: int = BAR_SECONDS, unit: str = "us",
              ids_follow_time: bool = False, format: str | None = None) -> None:
    """All days of a range in one pass per table; ``scope="continuous"`` carries averages over days
    without the daily rounding and reset, as a job over a whole month does."""
    land(spark, source, root, start, end, symbols, unit, format)
    transform(spark, root, start, end, symbols, interval_s, unit, ids_follow_time)
    find_patterns(spark, root, start, end, symbols, scope)


def run_day(spark: SparkSession, source: str, root: str, day: date,
            symbols: Sequence[str] | None = None, **settings) -> None:
    run_range(spark, source, root, day, day, symbols, **settings)
