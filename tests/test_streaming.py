import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlemill.schemas import STREAM_BAR, STREAM_PATTERN
from candlemill.sinks import write_bars_sink, write_stream_files
from candlemill.sources import read_bars_stream, read_patterns_stream, read_trades_stream
from candlemill.streaming import (
    bounded_pattern_job, bounded_patterns, start_pattern_job, stream_klines, stream_metrics, watch_progress,
    stream_patterns, union_by_symbol,
)
from helpers import half_up, slow_ema, wave

T0 = 1_759_276_800_000_000  # 2025-10-01 00:00:00 UTC, in microseconds
MINUTE = 60_000_000


@pytest.fixture(autouse=True)
def few_state_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def trade(i, minute, price, symbol="A", second=0):
    return json.dumps({
        "agg_trade_id": i, "price": price, "quantity": 1.0, "first_trade_id": i,
        "last_trade_id": i, "ts_int": T0 + minute * MINUTE + second * 1_000_000,
        "is_buyer_maker": True, "is_best_match": True, "symbol": symbol,
    })


def drop(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    # the files of a source are taken in order of age
    at = 1_700_000_000 + len(os.listdir(folder))
    os.utime(path, (at, at))


def source(spark, folder):
    return read_trades_stream(spark, str(folder), "json", options={"maxFilesPerTrigger": "1"})


def run_bars(spark, stream, out):
    watch_progress(spark)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/ck").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.schema(STREAM_BAR).parquet(f"{out}/rows").collect()
    return {(r.symbol, r.window_start): r for r in got}, query


def at(minute):
    return datetime(2025, 10, 1) + timedelta(minutes=minute)


def test_windows_order_late_and_malformed(spark, tmp_path):
    folder = tmp_path / "in"
    drop(folder, "1", [
        trade(2, 5, 11.0), trade(1, 1, 10.0), "{not json", '{"ts_int": "x"}', trade(3, 14, 12.12345),
        trade(3, 14, 13.0).replace('"price": 13.0', '"price": "oops"'),  # one bad field: null price
    ])
    drop(folder, "2", [trade(4, 15, 20.0, second=3), trade(5, 14, 9.0, second=59)])  # 4 s late: kept
    drop(folder, "3", [trade(6, 40, 30.0)])
    drop(folder, "4", [trade(7, 41, 31.0)])
    drop(folder, "5", [trade(8, 2, 1.0), trade(9, 42, 32.0)])               # its window has closed
    drop(folder, "6", [trade(10, 50, 33.0)])
    got, query = run_bars(spark, stream_klines(source(spark, folder)), tmp_path / "out")
    first = got[("A", at(0))]
    assert (first.open_price, first.high_price, first.low_price, first.close_price) == (
        10.0, 12.1235, 9.0, 9.0)
    assert first.volume == 5.0 and str(first.landing_date) == "2025-10-01"
    assert first.window_end == at(15)
    assert got[("A", at(15))].open_price == 20.0
    # the last window stays open: the watermark has not passed it
    assert ("A", at(45)) not in got
    assert stream_metrics(query)["rows_dropped_late"] >= 1


def test_a_slow_symbol_keeps_its_trades(spark, tmp_path):
    """B's trades come hours of event time after A's; each symbol has its own watermark."""
    for n in range(4):
        drop(tmp_path / "a", str(n), [trade(n, 300 + 20 * n, 1.0 + n)])
        drop(tmp_path / "b", str(n), [trade(n, 20 * n, 5.0 + n, "B")])
    streams = [source(spark, tmp_path / s) for s in ("a", "b")]
    bars = stream_klines(union_by_symbol(streams), delay=None)
    got, query = run_bars(spark, bars, tmp_path / "out")
    assert [got[("B", at(15 * (20 * n // 15)))].open_price for n in range(3)] == [5.0, 6.0, 7.0]
    assert stream_metrics(query)["rows_dropped_late"] == 0


def history(n=60):
    """Three trades per bar and symbol, and when a bar starts."""
    lines, bars = [], {}
    for s, symbol in enumerate("AB"):
        prices = wave(3 * n, 11 + s)
        for i in range(n):
            trio = prices[3 * i : 3 * i + 3]
            bars[(symbol, at(15 * i))] = (trio[0], max(trio), min(trio), trio[2])
            for j, p in enumerate(trio):
                lines.append((15 * i + 4 * j, trade(10 * i + j, 15 * i + 4 * j, p, symbol)))
    return [line for _, line in sorted(lines)], bars


def expected_patterns(bars):
    want = {}
    for symbol in "AB":
        rows = sorted((k, v) for k, v in bars.items() if k[0] == symbol)
        e7 = slow_ema([v[3] for _, v in rows], 7)
        e20 = slow_ema([v[3] for _, v in rows], 20)
        before = None
        for (key, (o, _, _, c)), f, s in zip(rows, e7, e20):
            trend = None
            if f is not None and s is not None and f != s:
                trend = "uptrend" if f > s else "downtrend"
            label = None
            if before:
                po, pc = before
                if pc < po and c > o and o < pc and c > po and trend == "downtrend":
                    label = "bullish engulfing"
                if pc > po and c < o and o > pc and c < po and trend == "uptrend":
                    label = "bearish engulfing"
            want[key] = (half_up(f, 4), half_up(s, 4), trend, label)
            before = (o, c)
    return want


def picked(rows):
    return {(r.symbol, r.window_start): (r.ema7, r.ema20, r.trend, r.engulfing_pattern) for r in rows}


def test_job_restart_fan_out_and_equality_with_batch(spark, tmp_path):
    lines, bars = history()
    want = expected_patterns(bars)
    assert {"bullish engulfing", "bearish engulfing"} <= {v[3] for v in want.values()}
    folder, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        query = start_pattern_job(
            source(spark, folder), f"{out}/bars", f"{out}/patterns", f"{out}/alerts", f"{out}/ck",
            once=True, parallelism=3,
        )
        assert spark.conf.get("spark.sql.shuffle.partitions") == "2"
        query.awaitTermination()
        states = {o.numShufflePartitions for p in query.recentProgress for o in p.stateOperators}
        assert states == {3}

    half = len(lines) // 2
    drop(folder, "1", lines[:100])
    drop(folder, "2", lines[100:half])   # many windows of a key close in one micro-batch
    run()
    drop(folder, "3", lines[half:])      # a second run goes on from the stored state
    run()
    rows = spark.read.parquet(f"{out}/patterns").collect()
    got = picked(rows)
    assert len(rows) == len(got) >= 2 * 58
    assert got == {k: v for k, v in want.items() if k in got}
    stored = spark.read.parquet(f"{out}/bars")
    assert {(r.symbol, r.window_start): (r.open_price, r.high_price, r.low_price, r.close_price)
            for r in stored.collect()} == {k: v for k, v in bars.items() if k in got}
    assert stored.where("created_at IS NULL").count() == 0

    # alerts are the rows with a pattern, and read back as a stream of their own
    bodies = spark.read.schema("key string, value string").json(f"{out}/alerts/*")
    bodies.select("value").write.text(f"{out}/topic")
    query = (
        read_patterns_stream(spark, f"{out}/topic", "json").writeStream.format("parquet")
        .option("path", f"{out}/read").option("checkpointLocation", f"{out}/ck2")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    alerts = spark.read.schema(STREAM_PATTERN).parquet(f"{out}/read").collect()
    assert picked(alerts) == {k: v for k, v in got.items() if v[3]}

    # bounded input closes every window, over chunks of any size
    for i, text in enumerate((lines,)):
        drop(tmp_path / "all", str(i), text)
    batch = spark.read.text(str(tmp_path / "all")).select(
        F.from_json("value", "agg_trade_id long, price double, quantity double, ts_int long, "
                    "symbol string").alias("m")).select("m.*")
    batch = batch.withColumn("ts", F.timestamp_micros("ts_int"))
    assert picked(bounded_pattern_job(batch).collect()) == want
    cut = bounded_patterns(stream_klines(batch, delay=None), span=9)
    assert picked(cut.collect()) == want


def test_patterns_from_stored_bars_without_a_symbol(spark, tmp_path):
    _, bars = history(40)
    want = {k: v for k, v in expected_patterns(bars).items() if k[0] == "A"}
    lines = [
        f"{start.isoformat(sep=' ')},{(start + timedelta(minutes=15)).isoformat(sep=' ')},"
        f"{start.date()},{o},{h},{low},{c},1.0"
        for (s, start), (o, h, low, c) in bars.items() if s == "A"
    ]
    drop(tmp_path / "in", "bars.csv", lines[::-1])
    query = (
        stream_patterns(read_bars_stream(spark, str(tmp_path / "in"), "A"))
        .writeStream.format("parquet").outputMode("append")
        .option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/ck")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert picked(spark.read.parquet(f"{tmp_path}/rows").collect()) == want


def test_null_close_on_the_stream_keeps_the_state(spark, tmp_path):
    closes = wave(30)
    lines = [
        f"{at(15 * i).isoformat(sep=' ')},{at(15 * i + 15).isoformat(sep=' ')},A,2025-10-01,"
        f"1.0,2.0,0.5,{'' if i == 12 else c},1.0" for i, c in enumerate(closes)
    ]
    drop(tmp_path / "in", "bars.csv", lines)
    query = (
        stream_patterns(read_bars_stream(spark, str(tmp_path / "in"))).writeStream
        .format("parquet").option("path", f"{tmp_path}/rows")
        .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = sorted(spark.read.parquet(f"{tmp_path}/rows").collect(), key=lambda r: r.window_start)
    values = [None if i == 12 else c for i, c in enumerate(closes)]
    assert [r.ema7 for r in rows] == [half_up(v, 4) for v in slow_ema(values, 7)]
    assert rows[12].trend is None


def test_a_repeated_batch_does_not_double_rows(spark, tmp_path):
    row = spark.sql("SELECT 'A' AS symbol, DATE'2025-10-01' AS landing_date, 1.0 AS close_price")
    for batch in (0, 1, 1):
        write_bars_sink(row, str(tmp_path / "bars"), batch)
    assert spark.read.parquet(str(tmp_path / "bars")).count() == 2


def test_copy_to_files(spark, tmp_path):
    drop(tmp_path / "in", "1", [trade(1, 0, 1.0), trade(2, 0, 1.0).replace("1.0", "null", 1)])
    picked_columns = source(spark, tmp_path / "in").select("agg_trade_id", "price", "symbol")
    for format in ("csv", "json"):
        out = f"{tmp_path}/{format}"
        write_stream_files(picked_columns, f"{out}/rows", f"{out}/ck", format, True).awaitTermination()
        text = "\n".join(r.value for r in spark.read.text(f"{out}/rows").collect())
        assert ("2,,A" in text) if format == "csv" else ('{"agg_trade_id":2,"symbol":"A"}' in text)


def test_trade_files_as_a_stream(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    with open(tmp_path / "in" / "ADAUSDT-aggTrades-2025-09-26.csv", "w") as f:
        for i in range(4):
            f.write(f"{i},{i + 1}.5,1.0,{i},{i},{T0 + i * 10 * MINUTE},true,true\n")
    stream = read_trades_stream(spark, str(tmp_path / "in"), "csv")
    got, _ = run_bars(spark, stream_klines(stream, delay="5 minutes"), tmp_path / "out")
    assert {k: r.close_price for k, r in got.items()} == {("ADAUSDT", at(0)): 2.5}


def test_generated_rows(spark):
    query = (
        spark.readStream.format("rate").option("rowsPerSecond", 5).load()
        .writeStream.format("memory").queryName("generated").trigger(once=True).start()
    )
    query.awaitTermination()
    assert spark.table("generated").columns == ["timestamp", "value"]
