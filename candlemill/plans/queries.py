"""One query per operator over the supplied tables. Each takes (session, folder)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from datetime import date
from functools import reduce
from uuid import uuid4

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill import operators as op
from candlemill.functions.columns import shown
from candlemill.plans.jobs import LANDING, PATTERNS, find_patterns, land, run_range, transform
from candlemill.schemas import STREAM_BAR, STREAM_PATTERN, TRADE, TRADE_MESSAGE
from candlemill.session import fresh_path, prepare, stage
from candlemill.sinks import (
    encode_alerts,
    encode_end_marks,
    encode_trades,
    rejected_trades,
    replace_table,
    upsert_partitions,
    write_bars_sink,
    write_landing,
    write_stream_files,
)
from candlemill.sources import read_landing, read_trades_csv, read_trades_stream
from candlemill.sources.files import trades_in_archives
from candlemill.sources.streams import parse_messages, read_bars_stream, read_patterns_stream
from candlemill.sources.testdata import trades_from_events, trades_from_orders
from candlemill.streaming import (
    bounded_pattern_job,
    start_keyed_job,
    start_pattern_job,
    state_partitions,
    stream_klines,
    stream_patterns,
    union_by_symbol,
)

MINUTE, HOUR, DAY = 60, 3600, 86400
EVENT_PARTITIONS = {"click": 0, "error": 1, "purchase": 2, "view": 3}
ALL_EVENT_PARTITIONS = EVENT_PARTITIONS | {"signup": 4}


# ---- inputs -------------------------------------------------------------------------------------

def events(spark: SparkSession, folder: str) -> DataFrame:
    return trades_from_events(prepare(spark), folder)


def dated_events(spark: SparkSession, folder: str) -> DataFrame:
    day = F.to_date(F.timestamp_micros("timestamp"))
    return events(spark, folder).withColumn("landing_date", day)


def hourly_once(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars for what passes over them once, as averages and patterns do, which store chunks of them."""
    return op.klines(events(spark, folder), HOUR, ids_follow_time=True)


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars, written once: moving windows pass over them more than once."""
    return stage(hourly_once(spark, folder), "bars")


def hourly_by_day(spark: SparkSession, folder: str) -> DataFrame:
    return op.klines(dated_events(spark, folder), HOUR, ("landing_date", "symbol"))


def event_stream_rows(spark: SparkSession, folder: str) -> DataFrame:
    trades = events(spark, folder).withColumnRenamed("timestamp", "ts_int")
    return trades.withColumn("ts", F.timestamp_millis(F.expr("ts_int div 1000")))


def text_events(spark: SparkSession, folder: str) -> DataFrame:
    """All-text trades; every tenth price is no number, flags are padded and in any case."""
    bad_price = F.when(F.col("agg_trade_id") % 10 == 0, "n/a")
    return events(spark, folder).select(
        F.col("agg_trade_id").cast("string").alias("agg_trade_id"),
        F.coalesce(bad_price, F.col("price").cast("string")).alias("price"),
        F.col("quantity").cast("string").alias("quantity"),
        F.col("agg_trade_id").cast("string").alias("first_trade_id"),
        F.col("agg_trade_id").cast("string").alias("last_trade_id"),
        F.col("timestamp").cast("string").alias("timestamp"),
        F.when(F.col("is_buyer_maker"), " TRUE").otherwise("false ").alias("is_buyer_maker"),
        F.lit("True").alias("is_best_match"),
        "symbol",
    )


def trade_messages(trades: DataFrame) -> DataFrame:
    """Events as trade messages, in ``value``."""
    text = trades.select(
        *[F.col(c).cast("string").alias(c) for c in ("agg_trade_id", "price", "quantity")],
        F.lit("0").alias("first_trade_id"), F.lit("0").alias("last_trade_id"),
        F.col("timestamp").cast("string").alias("timestamp"),
        F.col("is_buyer_maker").cast("string").alias("is_buyer_maker"),
        F.lit("true").alias("is_best_match"), "symbol",
    )
    return encode_trades(text, ALL_EVENT_PARTITIONS).select("value")


def message_folder(spark: SparkSession, folder: str) -> str:
    """The events as trade messages, one JSON text per line."""
    path = fresh_path(spark, "messages")
    trade_messages(events(spark, folder)).write.text(path)
    return path


# ---- bars and profiles --------------------------------------------------------------------------

def klines_1h(spark, folder):
    return op.klines(events(spark, folder), HOUR)


def klines_15m(spark, folder):
    return op.klines(events(spark, folder), ids_follow_time=True)


def klines_orders_daily(spark, folder):
    return op.klines(trades_from_orders(prepare(spark), folder), DAY, price_scale=2, volume_scale=2)


def bucket_stats(spark, folder):
    return op.bucket_stats(events(spark, folder), HOUR)


def time_columns(spark, folder):
    return op.add_time_bucket(events(spark, folder)).select(
        "agg_trade_id", "timestamp_date", "timestamp_second", "group_id", "group_date"
    )


def ingest_columns(spark, folder):
    same_day = F.col("ingest_date") == F.to_date("ingest_timestamp")
    rows = op.add_ingest_columns(events(spark, folder))
    return rows.select("agg_trade_id", same_day.alias("same_day"))


def ingest_profile(spark, folder):
    """What landing adds: the types, and how many rows have a value."""
    rows = op.add_ingest_columns(events(spark, folder))
    names = ("ingest_date", "ingest_timestamp")
    types = [F.min(F.typeof(n)).alias(f"{n}_type") for n in names]
    fresh = F.count_if(F.abs(F.date_diff(F.current_date(), "ingest_date")) <= 1)
    return rows.agg(*types, *[F.count(n).alias(f"{n}_rows") for n in names], fresh.alias("fresh_rows"))


def shown_prices(spark, folder):
    """Numbers as text."""
    thousands = F.round(F.col("price") * 1000, 2)
    return events(spark, folder).select("agg_trade_id", shown(thousands).alias("price"), shown("quantity", 2).alias("quantity"))


def tag_columns(spark, folder):
    rows = op.tag_run(events(spark, folder), "BTCUSDT", "2025-10-01")
    return rows.select("agg_trade_id", "symbol", "landing_date")


def row_counts(spark, folder):
    return op.row_counts(events(spark, folder), F.col("price") > 50)


def partition_counts(spark, folder):
    return op.partition_counts(dated_events(spark, folder))


def null_profile(spark, folder):
    holes = F.when(F.col("agg_trade_id") % 7 != 0, F.col("price"))
    return op.null_profile(events(spark, folder).withColumn("price", holes))


def describe_trades(spark, folder):
    rows = op.describe_trades(events(spark, folder), ["price", "quantity"])
    return rows.select(
        "summary", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("price", "quantity")]
    )


def symbols(spark, folder):
    return op.symbols(events(spark, folder))


def last_bar(spark, folder):
    return op.last_bar(op.klines(events(spark, folder), HOUR))


def latest_trades(spark, folder):
    return op.latest(events(spark, folder), 20)


def sample_trades(spark, folder):
    return op.sample_trades(events(spark, folder), 0.01)


LISTING = {
    "search": "r#0000001", "columns": ["c_name", "c_mktsegment"], "is_null": {"c_acctbal": False},
}


def paged_listing(spark, folder):
    customers = prepare(spark).read.parquet(f"{folder}/customer.parquet")
    return op.page(customers, "c_acctbal", "c_custkey", 2, 25, True, **LISTING)


def page_total(spark, folder):
    return op.page_total(prepare(spark).read.parquet(f"{folder}/customer.parquet"), **LISTING)


def unequal_matches(spark, folder):
    customers = prepare(spark).read.parquet(f"{folder}/customer.parquet")
    return op.unequal_matches(customers, "c_nationkey")


def backfill_nulls(spark, folder):
    customers = prepare(spark).read.parquet(f"{folder}/customer.parquet").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return op.backfill_nulls(customers, {"c_acctbal": 0.0, "c_mktsegment": "NONE"})


def cast_trades(spark, folder):
    return op.cast_trades(text_events(spark, folder)).select(
        "agg_trade_id", "price", "quantity", "timestamp", "is_buyer_maker", "is_best_match", "symbol"
    )


# ---- indicators ---------------------------------------------------------------------------------

def _of_bar(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("symbol", "group_id", *columns)


def sma7(spark, folder):
    return _of_bar(op.sma(hourly(spark, folder)), "sma7")


def ma7_full(spark, folder):
    return _of_bar(op.sma(hourly(spark, folder), partial="full"), "ma7")


def ema7_ema20(spark, folder):
    return _of_bar(op.ema(hourly_once(spark, folder)), "close_price", "ema7", "ema20")


def ema_first_seed(spark, folder):
    found = op.ema(hourly_once(spark, folder), (7,), seed="first", digits=None)
    return _of_bar(found, F.round("ema7", 6).alias("ema7"))


def ema_column_seed(spark, folder):
    led = stage(op.sma(hourly(spark, folder), partial="full"), "seeded")
    found = op.ema(led, (7,), seed="column", arithmetic="decimal", seed_column="ma7")
    return _of_bar(found, "ma7", "ema7")


def ema_day_carry(spark, folder):
    return _of_bar(op.ema(hourly_by_day(spark, folder), scope="day"), "landing_date", "ema7", "ema20")


def ema_chunked(spark, folder):
    """Over every single trade rather than bars."""
    found = op.ema_chunked(events(spark, folder))
    return found.select("symbol", "agg_trade_id", F.round("ema7", 6).alias("ema7"))


def rsi6(spark, folder):
    return _of_bar(op.rsi(hourly_once(spark, folder)), "rsi6")


def macd(spark, folder):
    names = ("ema12", "ema26", "macd", "signal", "histogram")
    return _of_bar(op.macd(hourly_once(spark, folder)), *names)


def trend_counts(spark, folder):
    rows = op.with_trend(hourly_once(spark, folder), digits=4)
    return rows.groupBy("symbol", "trend").agg(F.count(F.lit(1)).alias("bars"))


# ---- the same over one-minute bars, which cross the borders of chunks --------------------------------

def minutes(spark: SparkSession, folder: str) -> DataFrame:
    return op.klines(events(spark, folder), MINUTE, ids_follow_time=True)


def minutes_by_day(spark: SparkSession, folder: str) -> DataFrame:
    return op.klines(dated_events(spark, folder), MINUTE, ("landing_date", "symbol"))


def sma_minutes(spark, folder):
    return _of_bar(op.sma(stage(minutes(spark, folder), "bars")), "sma7")


def ema_minutes(spark, folder):
    return _of_bar(op.ema(minutes(spark, folder)), "close_price", "ema7", "ema20")


def day_carry_minutes(spark, folder):
    return _of_bar(op.ema(minutes_by_day(spark, folder), scope="day"), "landing_date", "ema7", "ema20")


def rsi_minutes(spark, folder):
    return _of_bar(op.rsi(minutes(spark, folder)), "rsi6")


def macd_minutes(spark, folder):
    return _of_bar(op.macd(minutes(spark, folder)), "ema12", "ema26", "macd", "signal", "histogram")


def engulfing_minutes(spark, folder):
    return op.pattern_two(minutes(spark, folder), scope="continuous")


def stars_minutes(spark, folder):
    return op.pattern_three(minutes(spark, folder))


def flat_trend_minutes(spark, folder):
    """Prices in steps of 25, so that they stand still for stretches; trend on unrounded averages, short chunks."""
    steps = F.floor(F.col("price") / 25) * 25 + F.lit(1.1)
    bars = op.klines(events(spark, folder).withColumn("price", steps), MINUTE, ids_follow_time=True)
    return _of_bar(op.with_trend(bars, digits=4, on="raw", span=512), "close_price", "ema7", "ema20", "trend")


# ---- patterns and serving -----------------------------------------------------------------------

def pattern_hammer(spark, folder):
    return op.pattern_one(hourly_once(spark, folder))


def pattern_engulfing(spark, folder):
    return op.pattern_two(hourly_once(spark, folder), scope="continuous")


def pattern_engulfing_raw(spark, folder):
    return op.pattern_two(hourly_once(spark, folder), scope="continuous", on="raw")


def pattern_engulfing_day(spark, folder):
    return op.pattern_two(hourly_by_day(spark, folder), scope="day")


def pattern_stars(spark, folder):
    return op.pattern_three(hourly_once(spark, folder))


def only_patterns(spark, folder):
    return op.only_patterns(op.pattern_three(hourly_once(spark, folder)))


def plot_bars(spark, folder):
    return op.plot_bars(op.klines(events(spark, folder), HOUR))


def plot_sma(spark, folder):
    return op.plot_bars(op.sma(hourly(spark, folder)), columns=("sma7",))


def chart_series(spark, folder):
    """The symbol comes first: bars and averages of the others are not worked out."""
    clicks = event_stream_rows(spark, folder).where(F.col("symbol") == "click")
    rows = bounded_pattern_job(clicks, HOUR)
    return op.chart_series(rows, "click", "2024-01-05", "2024-01-20 12:00:00")


# ---- files, tables, jobs ------------------------------------------------------------------------

def _trade_file_columns(trades: DataFrame, *more) -> DataFrame:
    return trades.select(
        *more,
        "agg_trade_id", "price", "quantity", F.col("agg_trade_id").alias("first_trade_id"),
        F.col("agg_trade_id").alias("last_trade_id"), "timestamp", "is_buyer_maker",
        F.lit(True).alias("is_best_match"),
    )


def csv_ingest(spark, folder):
    path = fresh_path(prepare(spark), "csv")
    _trade_file_columns(events(spark, folder)).write.csv(path, header=False)
    return read_trades_csv(spark, path)


def _zip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("trades.csv", "\n".join(batch.column("line").to_pylist()) + "\n")
        yield pa.RecordBatch.from_pydict(
            {"path": ["trades.zip"], "content": [packed.getvalue()]},
            schema=pa.schema([("path", pa.string()), ("content", pa.binary())]),
        )


def zip_ingest(spark, folder):
    trades = _trade_file_columns(events(spark, folder))
    lines = trades.select(F.to_csv(F.struct(*TRADE.names)).alias("line"))
    archives = lines.mapInArrow(_zip_batches, "path string, content binary")
    return trades_in_archives(archives)


def landing_read(spark, folder):
    root = fresh_path(prepare(spark), "landing")
    write_landing(dated_events(spark, folder), root)
    return read_landing(spark, root, symbol="view").select(
        "agg_trade_id", "price", "symbol", "landing_date"
    )


def upsert_rows(spark, folder):
    """Every partition is written, then those of one symbol are replaced."""
    root = fresh_path(prepare(spark), "upsert")
    rows = dated_events(spark, folder).select("agg_trade_id", "price", "symbol", "landing_date")
    upsert_partitions(rows, root)
    changed = rows.where(F.col("symbol") == "click").withColumn("price", -F.col("price"))
    upsert_partitions(changed, root)
    return spark.read.parquet(root)


def day_jobs(spark, folder):
    """Landing to patterns over two ranges of days, the second going on from what the first stored."""
    root = fresh_path(prepare(spark), "tables")
    write_landing(dated_events(spark, folder), f"{root}/landing/aggtrades")
    for start, end in ((None, date(2024, 1, 15)), (date(2024, 1, 16), None)):
        transform(spark, root, start, end, interval_s=HOUR)
        find_patterns(spark, root, start, end)
    return spark.read.parquet(f"{root}/{PATTERNS}").select(
        "symbol", "landing_date", "group_id", "close_price", "ema7", "ema20", "trend", "pattern"
    )


def _named_files(trades: DataFrame, root: str, period: Column) -> None:
    """Trade files named by symbol and ``period``, as an exchange publishes them: one for each, wherever its rows are."""
    spark = trades.sparkSession
    rows = _trade_file_columns(trades, "symbol", period.alias("_period"))
    rows.repartition("symbol", "_period").write.partitionBy("symbol", "_period").csv(f"{root}/by-name", header=False)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{root}/in"))
    for symbol in files.listStatus(path(f"{root}/by-name")):
        name = symbol.getPath().getName()
        for part in files.listStatus(symbol.getPath()) if name.startswith("symbol=") else ():
            label = f"{name[7:]}-aggTrades-{part.getPath().getName()[8:]}"
            for number, file in enumerate(files.listStatus(part.getPath())):
                files.rename(file.getPath(), path(f"{root}/in/{label}.{number}.csv"))


def land_days(spark, folder):
    """The job of a range of days from the files on: landed, made into bars, labelled."""
    root = fresh_path(prepare(spark), "lake")
    _named_files(dated_events(spark, folder), root, F.col("landing_date").cast("string"))
    run_range(spark, f"{root}/in/*.csv", root, date(2024, 1, 1), date(2024, 1, 31), interval_s=HOUR)
    return spark.read.parquet(f"{root}/{PATTERNS}").select(
        "symbol", "landing_date", "group_id", "close_price", "ema7", "ema20", "trend", "pattern"
    )


def land_month(spark, folder):
    """Files of a month: each trade lands on the day it happened."""
    root = fresh_path(prepare(spark), "lake")
    _named_files(events(spark, folder), root, F.date_format(F.timestamp_micros("timestamp"), "yyyy-MM"))
    land(spark, f"{root}/in/*.csv", root)
    landed = spark.read.parquet(f"{root}/{LANDING}")
    return landed.select("agg_trade_id", "price", "quantity", "timestamp", "is_buyer_maker", "symbol", "landing_date")


def table_modes(spark, folder):
    """A table that is created, not created again, appended to, and at last replaced."""
    rows = events(prepare(spark), folder).select("agg_trade_id", "price", "symbol")
    name = f"trades_{uuid4().hex}"
    steps = []

    def note(step: str) -> None:
        there = spark.catalog.tableExists(name)
        found = spark.table(name) if there else rows.limit(0)
        steps.append(found.groupBy("symbol").agg(F.count("*").alias("rows"), F.sum(F.floor("price")).alias("prices")).withColumn("step", F.lit(step)))
        steps[-1] = stage(steps[-1], "table-step")

    note("missing")
    replace_table(rows.where("symbol = 'click'"), name, "errorifexists")
    note("created")
    try:
        replace_table(rows, name, "errorifexists")
    except AnalysisException:
        note("kept")
    replace_table(rows.where("symbol = 'view'"), name, "append")
    note("appended")
    replace_table(rows.where("symbol <> 'view'"), name)
    note("replaced")
    spark.sql(f"DROP TABLE {name}")
    return reduce(DataFrame.unionByName, steps)


def sink_days(spark, folder):
    """Bars written by micro-batch, one of them twice: each has the day it was written, none is there twice."""
    path = fresh_path(prepare(spark), "bars-sink")
    bars = stage(stream_klines(event_stream_rows(spark, folder), "1 hour", delay=None), "bars")
    for batch, rows in ((0, "day(landing_date) < 11"), (1, "day(landing_date) >= 11"), (1, "day(landing_date) >= 11")):
        write_bars_sink(bars.where(rows), path, batch)
    today = F.date_diff(F.current_date(), "created_at").between(0, 1)
    return spark.read.parquet(path).groupBy("symbol", "landing_date").agg(
        F.count("*").alias("bars"), F.count_if(today).alias("dated"), F.min(F.typeof("created_at")).alias("created_at_type"))


# ---- messages and streams -----------------------------------------------------------------------

def encode_trade_messages(spark, folder):
    messages = encode_trades(text_events(spark, folder), ALL_EVENT_PARTITIONS)
    return messages.select(
        "key", "partition", F.from_json("value", TRADE_MESSAGE).alias("m")
    ).select("key", "partition", "m.*")


def rejected_trade_counts(spark, folder):
    """With a map that lacks a symbol, and rows that do not parse."""
    rejected = rejected_trades(text_events(spark, folder), EVENT_PARTITIONS)
    return rejected.groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("rows"))


def encode_alert_messages(spark, folder):
    rows = bounded_pattern_job(event_stream_rows(spark, folder), HOUR)
    messages = encode_alerts(op.only_patterns(rows, "engulfing_pattern"))
    return messages.select("key", F.from_json("value", STREAM_PATTERN).alias("m")).select(
        "key", "m.*"
    )


def bounded_engulfing(spark, folder):
    return bounded_pattern_job(event_stream_rows(spark, folder), HOUR)


def _slots(spark: SparkSession) -> int:
    """State partitions: the session's shuffle partitions, but no more than tasks that run at once."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(shuffle, max(spark.sparkContext.defaultParallelism, 1))


def stream_bars(spark, folder):
    """Messages through the stream into files; the windows the watermark has passed."""
    trades = read_trades_stream(spark, message_folder(prepare(spark), folder), "json")
    out = fresh_path(spark, "stream-bars")
    writer = (
        stream_klines(trades, "1 hour", "5 seconds").writeStream.outputMode("append")
        .format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/ck")
        .trigger(availableNow=True)
    )
    with state_partitions(spark, _slots(spark)):
        query = writer.start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def stream_slow_symbol(spark, folder):
    """A stream per symbol, one small file of each at a time. One symbol comes in twice as many files, and so
    runs days behind the others in event time; nothing of it is lost."""
    trades = event_stream_rows(prepare(spark), folder)
    root, streams = fresh_path(spark, "by-symbol"), []
    for symbol in ALL_EVENT_PARTITIONS:
        files = 6 if symbol == "signup" else 3
        span = 30 * DAY * 1_000_000 // files
        first = 1_704_067_200_000_000  # 2024-01-01, where the events begin
        part = F.least(F.greatest(F.floor((F.col("ts_int") - first) / span), F.lit(0)), F.lit(files - 1))
        own = trades.where(F.col("symbol") == symbol).withColumn("_part", part)
        for i in range(files):  # one after the other: the source takes files by age
            own.where(F.col("_part") == i).drop("_part", "ts").coalesce(1).write.mode("append").json(f"{root}/{symbol}")
        options = {"maxFilesPerTrigger": "1"}
        streams.append(read_trades_stream(spark, f"{root}/{symbol}", "json", options=options))
    bars = stream_klines(union_by_symbol(streams), "1 hour", delay=None)
    writer = (
        bars.writeStream.outputMode("append").format("parquet").option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True)
    )
    with state_partitions(spark, _slots(spark)):
        query = writer.start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/rows")


def _keyed_job(spark: SparkSession, folder: str, first, marks: bool) -> str:
    """The keyed job in two runs: over the events for which ``first`` holds, then, from the same checkpoint, over the others."""
    trades, root = events(prepare(spark), folder), fresh_path(spark, "keyed")
    ends = trades.groupBy("symbol").agg(F.expr(f"(max(timestamp) div {HOUR * 1_000_000} + 1) * {HOUR * 1_000_000}").alias("ts_int"))
    for number, part in enumerate((trades.where(first), trades.where(~first))):
        messages = trade_messages(part)
        if marks and number:
            messages = messages.union(encode_end_marks(ends).select("value"))
        messages.write.mode("append").text(f"{root}/in")
        start_keyed_job(
            read_trades_stream(spark, f"{root}/in", "json"), f"{root}/bars", f"{root}/late", f"{root}/ck", HOUR,
            once=True, parallelism=_slots(spark),
        ).awaitTermination()
    return root


def stream_keyed_bars(spark, folder):
    """One stream, in which one symbol comes half a month behind the others, and end marks last: every window closes."""
    middle = 1_705_363_200_000_000  # 2024-01-16
    root = _keyed_job(spark, folder, (F.col("symbol") != "signup") | (F.col("timestamp") < middle), marks=True)
    return spark.read.parquet(f"{root}/bars").select(*STREAM_BAR.names)


def stream_late_trades(spark, folder):
    """Every tenth trade comes after all others: those whose window their symbol had closed by then."""
    root = _keyed_job(spark, folder, F.col("agg_trade_id") % 10 != 0, marks=False)
    return spark.read.parquet(f"{root}/late").drop("created_at", "batch_id")


def _run_pattern_job(spark, folder) -> str:
    trades = read_trades_stream(spark, message_folder(prepare(spark), folder), "json")
    out = fresh_path(spark, "stream-patterns")
    query = start_pattern_job(
        trades, f"{out}/bars", f"{out}/patterns", f"{out}/alerts", f"{out}/ck", "1 hour", once=True,
        parallelism=_slots(spark),
    )
    query.awaitTermination()
    return out


def stream_engulfing(spark, folder):
    out = _run_pattern_job(spark, folder)
    return spark.read.parquet(f"{out}/patterns").select(*STREAM_PATTERN.names)


def stream_alerts(spark, folder):
    out = _run_pattern_job(spark, folder)
    alerts = spark.read.schema("key string, value string").json(f"{out}/alerts/*")
    return parse_messages(alerts, STREAM_PATTERN, "window_start")


def stream_copy(spark, folder):
    trades = read_trades_stream(spark, message_folder(prepare(spark), folder), "json")
    out = fresh_path(spark, "stream-copy")
    picked = trades.select("agg_trade_id", "price", "ts_int", "symbol")
    write_stream_files(picked, f"{out}/rows", f"{out}/ck", once=True).awaitTermination()
    schema = "agg_trade_id bigint, price double, ts_int bigint, symbol string"
    return spark.read.schema(schema).csv(f"{out}/rows")


def _drained(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """What a stream gives for the input there is."""
    out = fresh_path(spark, label)
    writer = stream.writeStream.outputMode("append").format("parquet").trigger(availableNow=True)
    with state_partitions(spark, _slots(spark)):
        query = writer.option("path", f"{out}/rows").option("checkpointLocation", f"{out}/ck").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def stream_trade_files(spark, folder):
    """Trade files as a stream."""
    path = fresh_path(prepare(spark), "csv")
    _trade_file_columns(events(spark, folder)).write.csv(path, header=False)
    trades = read_trades_stream(spark, path, "csv", symbol="BTCUSDT")
    return _drained(spark, trades.select("agg_trade_id", "price", "ts_int", "ts", "symbol"), "trades")


def stream_stored_bars(spark, folder):
    """Patterns on a stream of stored bars."""
    path = fresh_path(prepare(spark), "bars")
    bars = stream_klines(event_stream_rows(spark, folder), "1 hour", delay=None)
    bars.select(*STREAM_BAR.names).write.csv(path)
    return _drained(spark, stream_patterns(read_bars_stream(spark, path)), "patterns")


def stream_read_alerts(spark, folder):
    """Published alerts, read back as a stream."""
    path = fresh_path(prepare(spark), "alerts")
    rows = bounded_pattern_job(event_stream_rows(spark, folder), HOUR)
    encode_alerts(op.only_patterns(rows, "engulfing_pattern")).select("value").write.text(path)
    return _drained(spark, read_patterns_stream(spark, path, "json"), "alerts")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        klines_1h, klines_15m, klines_orders_daily, bucket_stats, time_columns, ingest_columns,
        tag_columns, row_counts, partition_counts, null_profile, describe_trades, symbols, last_bar,
        latest_trades, sample_trades, paged_listing, page_total, unequal_matches, backfill_nulls,
        cast_trades, sma7, ma7_full, ema7_ema20, ema_first_seed, ema_column_seed, ema_day_carry,
        ema_chunked, rsi6, macd, trend_counts, sma_minutes, ema_minutes, day_carry_minutes, rsi_minutes,
        macd_minutes, engulfing_minutes, stars_minutes, flat_trend_minutes, pattern_hammer, pattern_engulfing,
        pattern_engulfing_raw, pattern_engulfing_day, pattern_stars, only_patterns, plot_bars,
        plot_sma, chart_series, csv_ingest, zip_ingest, landing_read, upsert_rows, day_jobs,
        stream_slow_symbol, stream_keyed_bars, stream_late_trades, encode_trade_messages, rejected_trade_counts, encode_alert_messages, bounded_engulfing, stream_bars,
        stream_engulfing, stream_alerts, stream_copy, stream_trade_files, stream_stored_bars,
        stream_read_alerts, ingest_profile, shown_prices, land_days, land_month, table_modes, sink_days,
    )
}
