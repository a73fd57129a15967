import json
import random
import time

import numpy as np
import pandas as pd
import pytest

from candlemill.schemas import STREAM_BAR
from candlemill.sinks import encode_end_marks
from candlemill.streaming import keyed_bars, late_trades, start_keyed_job
from candlemill.streaming.keyed import NO_ID, joined, windows_of
from helpers import half_up
from test_streaming import MINUTE, T0, at, drop, few_state_partitions, source, trade  # noqa: F401

LATE = "symbol string, landing_date date, window_start timestamp, agg_trade_id long, price double, closed_until timestamp, reason string"


def end(minute, symbol="A"):
    return json.dumps({"ts_int": T0 + minute * MINUTE, "symbol": symbol, "price": None})


def run(spark, folder, out, **options):
    stream = source(spark, folder)
    start_keyed_job(stream, f"{out}/bars", f"{out}/late", f"{out}/ck", once=True, parallelism=2, **options).awaitTermination()
    bars = spark.read.schema(STREAM_BAR).parquet(f"{out}/bars").select(*STREAM_BAR.names).collect()
    late = spark.read.schema(LATE).parquet(f"{out}/late").collect()
    return {(r.symbol, r.window_start): r for r in bars}, late


def test_late_trades_marks_and_restart(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    drop(folder, "1", [trade(2, 5, 11.0), trade(1, 1, 10.0), trade(3, 14, 12.12345), trade(4, 16, 20.0),
                       trade(5, 14, 9.0, second=59), "{no json", trade(9, 3, 7.0).replace('"price": 7.0', '"price": null')])
    drop(folder, "2", [trade(6, 2, 1.0), trade(7, 17, 21.0), trade(8, 1, 5.0, "B")])
    bars, late = run(spark, folder, out)
    first = bars[("A", at(0))]
    assert (first.open_price, first.high_price, first.low_price, first.close_price, first.volume) == (10.0, 12.1235, 9.0, 9.0, 5.0)
    assert first.window_end == at(15) and str(first.landing_date) == "2025-10-01"
    assert set(bars) == {("A", at(0))}
    assert [(r.symbol, r.agg_trade_id, r.window_start, r.price, r.reason) for r in late] == [("A", 6, at(0), 1.0, "watermark")]
    # from the checkpoint: the open windows are still there, and end marks close them
    drop(folder, "3", [end(30), end(15, "B")])
    drop(folder, "4", [trade(10, 20, 2.0), trade(11, 31, 2.0), trade(12, 14, 6.0, "B")])
    bars, late = run(spark, folder, out)
    assert bars[("A", at(15))][4:] == (20.0, 21.0, 20.0, 21.0, 2.0)
    assert set(bars) == {("A", at(0)), ("A", at(15)), ("B", at(0))}
    assert {(r.agg_trade_id, r.reason) for r in late} == {(6, "watermark"), (10, "end mark"), (12, "end mark")}


def test_every_trade_is_in_a_bar_or_late(spark, tmp_path):
    """Many symbols, out of order, over many micro-batches, against a plain loop."""
    draw = random.Random(5)
    folder, out = tmp_path / "in", tmp_path / "out"
    until, open_, want, want_late, n = {}, {}, {}, set(), 0
    for batch in range(6):
        lines, seen = [], {}
        for symbol in [f"S{k}" for k in range(8)] + [None]:
            if symbol == "S1" and batch % 2:
                continue  # silent in every other batch
            base = 20 * batch if symbol != "S2" else 3 * batch  # S2 runs far behind
            for _ in range(draw.randrange(1, 6)):
                n += 1
                minute, price = max(0, base + draw.randrange(-12, 12)), draw.choice([None, 1.5, 2.25, 9.0])
                lines.append(trade(n, minute, price).replace('"symbol": "A"', f'"symbol": {json.dumps(symbol)}'))
                seen.setdefault(symbol, []).append((minute * 60, n, price))
        drop(folder, str(batch), lines)
        for symbol, rows in seen.items():
            closed = until.get(symbol, -1)
            for second, i, price in rows:
                start = second // 900 * 900
                if start + 900 <= closed:
                    want_late.add(i)
                else:
                    open_.setdefault((symbol, start), []).append((second, i, price))
            until[symbol] = max(closed, max(r[0] for r in rows) - 5)
            for key in [k for k in open_ if k[0] == symbol and k[1] + 900 <= until[symbol]]:
                want[key] = open_.pop(key)
    bars, late = run(spark, folder, out)
    assert {r.agg_trade_id for r in late} == want_late and want_late
    assert set(bars) == {(s, at(start // 60)) for s, start in want}
    for (symbol, start), rows in want.items():
        got, ticks = bars[(symbol, at(start // 60))], sorted(r for r in rows if r[2] is not None)
        prices = [p for _, _, p in ticks]
        expected = (prices[0], max(prices), min(prices), prices[-1]) if prices else (None,) * 4
        assert got[4:8] == tuple(None if p is None else half_up(p, 4) for p in expected) and got.volume == len(rows)


def test_a_silent_symbol_closes_and_holds_nobody_back(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    drop(folder, "1", [trade(1, 1, 3.0, "A"), trade(1, 1, 4.0, "B")])
    query = start_keyed_job(source(spark, folder), f"{out}/bars", f"{out}/late", f"{out}/ck", idle_s=0.5, parallelism=2)

    def written(table, schema, number):
        """Such a stream never stands still, since it looks at its timers, so this waits for rows."""
        limit, rows = time.monotonic() + 60, []
        while len(rows) < number and time.monotonic() < limit and query.isActive:
            time.sleep(0.5)
            if list((out / table).glob("landing_date=*/*/*.parquet")):
                rows = spark.read.schema(schema).parquet(f"{out}/{table}").collect()
        return rows

    try:
        assert {r.symbol: r.close_price for r in written("bars", STREAM_BAR, 2)} == {"A": 3.0, "B": 4.0}
        drop(folder, "2", [trade(2, 2, 5.0, "A")])
        late = written("late", LATE, 1)
    finally:
        query.stop()
    assert [(r.agg_trade_id, r.reason, r.closed_until) for r in late] == [(2, "idle", at(15))]


def test_empty_input_and_encoded_marks(spark, tmp_path):
    folder = tmp_path / "in"
    drop(folder, "1", [""])
    assert run(spark, folder, tmp_path / "out") == ({}, [])
    marks = encode_end_marks(spark.createDataFrame([("A", 5)], "symbol string, ts_int long")).collect()
    assert marks[0].key == "A"
    assert {k: v for k, v in json.loads(marks[0].value).items() if v is not None} == {"symbol": "A", "ts_int": 5}


@pytest.mark.parametrize("seed", range(20))
def test_parts_of_a_window_join_to_the_whole(seed):
    draw = random.Random(seed)
    rows = pd.DataFrame(
        [(0, draw.randrange(4), draw.choice([NO_ID, 1, 2]), draw.choice([np.nan, 1.0, 2.0]), draw.choice([np.nan, 0.5]))
         for _ in range(draw.randrange(2, 9))], columns=["start", "ts_int", "order_id", "price", "quantity"])
    cut = draw.randrange(1, len(rows))
    whole, parts = windows_of(rows)[0], joined(windows_of(rows[:cut])[0], windows_of(rows[cut:])[0])
    empty = np.isnan(whole[6])
    np.testing.assert_array_equal(whole[8 if empty else 0:], parts[8 if empty else 0:])
