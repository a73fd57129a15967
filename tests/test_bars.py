import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from candlemill.functions.columns import event_time, floor_div
from candlemill.operators import (
    add_ingest_columns, add_time_bucket, backfill_nulls, bucket_stats, cast_trades, chart_series,
    describe_trades, klines, last_bar, latest, null_profile, only_patterns, page, page_total,
    partition_counts, plot_bars, row_counts, sample_trades, symbols, tag_run, unequal_matches,
)

TRADES = "symbol string, agg_trade_id long, price double, quantity double, timestamp long"
US = 1_000_000


def trades(spark, rows):
    return spark.createDataFrame(rows, TRADES)


def tied(spark):
    """Two trades at the first and two at the last instant; null prices at both ends."""
    return trades(spark, [
        ("A", 1, None, 1.0, 0), ("A", 3, 11.0, 1.0, 5 * US), ("A", 2, 10.0, 1.0, 5 * US),
        ("A", 4, 12.12345, 1.25, 9 * US), ("A", 6, 13.0, 1.0, 20 * US),
        ("A", 5, 14.0, 1.0, 20 * US), ("A", 7, None, None, 30 * US), ("B", 8, 1.0, 2.0, 901 * US),
    ])


@pytest.mark.parametrize("follows", [False, True])
def test_bars(spark, follows):
    for df in (tied(spark), tied(spark).orderBy(F.rand(1)).repartition(4)):
        a, b = sorted(klines(df, ids_follow_time=follows).collect(), key=lambda r: r.symbol)
        assert (a.open_price, a.high_price, a.low_price, a.close_price) == (10.0, 14.0, 10.0, 13.0)
        assert (a.open_time, a.close_time, a.volume) == (0, 30 * US, 6.3)  # 6.25 in all
        assert (a.group_id, a.group_date) == (0, "1970-01-01 00:00:00")
        assert (b.group_id, b.group_date, b.open_price) == (1, "1970-01-01 00:15:00", 1.0)


@pytest.mark.parametrize("base", [0, -(1 << 40), (1 << 30) - 100, (1 << 31) - 100, (1 << 32) - 100, (1 << 63) - 300, -(1 << 63)])
def test_ids_across_any_border(spark, base):
    """Hash and sorting form agree, ties and null ids and prices included, wherever the ids lie."""
    draw = random.Random(base)
    rows = [("A", None if i % 31 == 7 else base + i, None if i % 17 == 3 else float(draw.randrange(9)), 1.0, draw.randrange(40) * 100 * US) for i in range(300)]
    draw.shuffle(rows)
    key = lambda r: (r[1] is not None, r[1] or 0)
    df = trades(spark, rows)
    for interval in (900, 3600):
        got = {r.group_id: (r.open_price, r.close_price) for r in klines(df, interval).collect()}
        assert got == {r.group_id: (r.open_price, r.close_price) for r in klines(df, interval, wide_ids=True).collect()}
        for group, (open_, close) in got.items():
            own = [r for r in rows if r[4] // (interval * US) == group and r[2] is not None]
            same = lambda r, other: r[4] == other[4] and key(r) == key(other)  # noqa: E731, B023
            first, last = (f(own, key=lambda r: (r[4], key(r))) for f in (min, max))
            assert open_ in {r[2] for r in own if same(r, first)} and close in {r[2] for r in own if same(r, last)}


def test_ids_too_far_apart_fail_loudly(spark):
    df = trades(spark, [("A", 1, 10.0, 1.0, 0), ("A", 1 << 40, 11.0, 1.0, US), ("A", None, 12.0, 1.0, 5)])
    with pytest.raises(Exception, match="wide_ids"):
        klines(df).collect()
    row = klines(df, wide_ids=True).first()
    assert (row.open_price, row.close_price) == (10.0, 11.0)
    assert klines(df, 86_400).first().close_price == 11.0  # a day in microseconds leaves few bits: both numbers are kept


def test_scales(spark):
    row = klines(trades(spark, [("A", 1, 1.23456, 1.26, 0)])).first()
    assert (row.open_price, row.volume) == (1.2346, 1.3)
    row = klines(trades(spark, [("A", 1, 1.23456, 1.26, 0)]), price_scale=2, volume_scale=2).first()
    assert (row.open_price, row.volume) == (1.23, 1.26)


def test_a_bucket_of_null_prices_is_a_bar_without_prices(spark):
    for follows in (False, True):
        row = klines(trades(spark, [("A", 1, None, 2.0, 0)]), ids_follow_time=follows).first()
        assert (row.open_price, row.close_price, row.volume) == (None, None, 2.0)


def test_ids_against_time_fail_loudly(spark):
    df = trades(spark, [("A", 2, 10.0, 1.0, 0), ("A", 1, 11.0, 1.0, US)])
    row = klines(df).first()
    assert (row.open_price, row.close_price) == (10.0, 11.0)
    with pytest.raises(Exception, match="do not follow time"):
        klines(df, ids_follow_time=True).collect()


def test_buckets_round_down_below_zero_and_units_are_stated(spark):
    df = trades(spark, [("A", 1, 1.0, 1.0, -1)])
    row = add_time_bucket(df).first()
    assert (row.timestamp_second, row.group_id, row.group_date) == (-1, -1, "1969-12-31 23:45:00")
    ms = trades(spark, [("A", 1, 1.0, 1.0, 1_700_000_000_123)])
    row = add_time_bucket(ms, unit="ms").first()
    assert row.timestamp_second == 1_700_000_000 and row.group_id == 1_700_000_000 // 900
    at = spark.range(1).select(
        event_time(F.lit(1_700_000_000_123_456)).cast("string").alias("us"),
        event_time(F.lit(1_700_000_000_123), "ms").cast("string").alias("ms"),
        floor_div(F.lit(-901), 900).alias("below"),
    ).first()
    assert at.us == at.ms == "2023-11-14 22:13:20.123" and at.below == -2


def test_tags(spark):
    row = tag_run(add_ingest_columns(tied(spark)), "BTCUSDT", date(2025, 10, 1)).first()
    assert (row.symbol, row.landing_date) == ("BTCUSDT", date(2025, 10, 1))
    assert row.ingest_date == row.ingest_timestamp.date() and row.transform_date is not None


def test_aggregation_is_partial_and_hashed_when_ids_follow_time(spark):
    plan = klines(tied(spark), ids_follow_time=True)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "SortAggregate" not in plan and plan.count("Exchange") == 1


def test_profiles(spark):
    df = tied(spark)
    assert tuple(row_counts(df, F.col("price") > 10.5).first()) == (8, 4)
    assert null_profile(df).first().asDict() == {
        "symbol": 0, "agg_trade_id": 0, "price": 2, "quantity": 1, "timestamp": 0
    }
    assert [r.symbol for r in symbols(df).collect()] == ["A", "B"]
    assert {r.summary: r.price for r in describe_trades(df, ["price"]).collect()}["count"] == "6"
    assert [r.agg_trade_id for r in latest(df, 2).collect()] == [8, 7]
    dated = df.withColumn("landing_date", F.lit("2025-10-01").cast("date"))
    assert {(r.symbol, r.rows) for r in partition_counts(dated).collect()} == {("A", 7), ("B", 1)}
    stats = {r.symbol: r for r in bucket_stats(df).collect()}
    assert (stats["A"].max_id, stats["A"].min_id, stats["A"].high_price) == (7, 1, 14.0)
    assert {r.symbol: r.close_price for r in last_bar(klines(df)).collect()} == {"A": 13.0, "B": 1.0}
    assert sample_trades(df, 1.0).count() == 8
    assert [r.open_price for r in plot_bars(klines(df)).collect()] == [10.0, 1.0]


USERS = [
    (1, "Ann", "ann@x.io", "admin", None), (2, "Bob", "b_b@x.io", "user", date(2025, 1, 1)),
    (3, "Anna", "x@y.io", "user", None), (4, "Cy", "hanna@z.io", "user", None),
    (5, "100%", "p@z.io", "user", None),
]


def test_listing(spark):
    df = spark.createDataFrame(
        USERS, "id long, name string, email string, role string, deleted_at date"
    )
    both = ["name", "email"]
    found = dict(search="ANN", columns=both, is_null={"deleted_at": True})
    assert [r.id for r in page(df, "name", "id", **found).collect()] == [1, 3, 4]
    assert page_total(df, **found).first().total == 3
    assert [r.id for r in page(df, "name", "id", 2, 2, **found).collect()] == [4]
    assert page(df, "name", "id", 3, 2, **found).count() == 0
    assert [r.id for r in page(df, "name", "id", descending=True, **found).collect()] == [4, 3, 1]
    assert [r.id for r in page(df, "id", "id", equals={"role": "admin"}).collect()] == [1]
    assert [r.id for r in page(df, "id", "id", is_null={"deleted_at": False}).collect()] == [2]
    # the wildcard characters of LIKE are plain text in a search
    assert [r.id for r in page(df, "id", "id", search="%", columns=both).collect()] == [5]
    assert [r.id for r in page(df, "id", "id", search="_", columns=both).collect()] == [2]


def test_unequal_join(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "user_id long, name string")
    users.createOrReplaceTempView("users")
    pairs = spark.sql("SELECT a.user_id FROM users a JOIN users b ON a.user_id != b.user_id")
    counted = {r.user_id: r.pairs for r in unequal_matches(users, "user_id").collect()}
    assert counted == {1: 2, 2: 2} and pairs.count() == sum(counted.values())
    spark.catalog.dropTempView("users")


def test_backfill_and_casts(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5.0, "x")], "id long, n double, s string")
    got = backfill_nulls(df, {"n": 0.5, "s": "none"}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 0.5, "none"), (2, 5.0, "x")]
    text = spark.createDataFrame(
        [("1", "2.5", "bad", "1", "1", "7", "TRUE", "no")],
        ", ".join(f"{c} string" for c in (
            "agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "timestamp",
            "is_buyer_maker", "is_best_match")),
    )
    row = cast_trades(text).first()
    assert (row.agg_trade_id, row.price, row.quantity, row.timestamp) == (1, 2.5, None, 7)
    assert row.is_buyer_maker is True and row.is_best_match is False
    only = spark.createDataFrame([(None,), ("hammer",)], "pattern string")
    assert only_patterns(only).count() == 1


def test_chart(spark):
    rows = spark.createDataFrame(
        [("A", f"2025-01-01 0{h}:00:00", 1.0, 2.0, 0.5, 1.5, 9.0, 1.0, 1.0, p)
         for h, p in ((3, None), (1, None), (2, "bullish engulfing"))],
        "symbol string, at string, open_price double, high_price double, low_price double, "
        "close_price double, volume double, ema7 double, ema20 double, engulfing_pattern string",
    ).withColumn("window_start", F.col("at").cast("timestamp"))
    got = chart_series(rows, "A", "2025-01-01 01:00:00", "2025-01-01T02:00:00").collect()
    assert [r.engulfing_close for r in got] == [None, 1.5]
    assert chart_series(rows, "A", "not a time", "2025-01-02").count() == 0
    assert chart_series(rows, "B", "2025-01-01", "2025-01-02").count() == 0
