"""The shape of the plans: what is read, what moves, and by what."""

import os

import pytest

from candlemill import operators as op
from candlemill.operators.chunks import bucket_chunk, packed, packed_by_rows
from candlemill.plans import queries as q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the supplied tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_read_five_columns_and_move_once(spark):
    text = plan(q.klines_15m(spark, FOLDER))
    read = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in read.split(",")} == {
        "event_id", "ts", "event_type", "value", "props"
    }
    assert text.count("Exchange hashpartitioning") == 1 and "WholeStageCodegen" not in text
    assert "SortAggregate" not in text and "partial_min_by" in text


def test_only_what_is_asked_for_is_read(spark):
    bars = q.hourly(spark, FOLDER)
    text = plan(op.sma(bars).select("symbol", "group_id", "sma7"))
    for part in text.split("ReadSchema: struct<")[1:]:
        assert {c.split(":")[0] for c in part.split(">")[0].split(",")} <= {
            "group_id", "symbol", "close_price"
        }
    text = plan(bars.where("symbol = 'click'"))
    assert "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,click)]" in text


def test_halo_rows_are_cut_before_they_move(spark):
    text = plan(op.sma(q.hourly(spark, FOLDER)))
    cut = text.index("WindowGroupLimit")
    assert "Partial" in text[cut:] and "CartesianProduct" not in text


@pytest.mark.parametrize("name", [
    "sma7", "ema7_ema20", "ema_day_carry", "rsi6", "macd", "pattern_engulfing",
    "pattern_engulfing_day", "pattern_stars", "bounded_engulfing",
])
def test_no_indicator_uses_one_partition_or_a_cross_join(spark, name):
    text = plan(q.QUERIES[name](spark, FOLDER))
    for bad in ("SinglePartition", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_pattern_shuffles(spark):
    """Beside what stores the chunks, the summaries move, by key; rows and lags do not."""
    bars = q.hourly(spark, FOLDER)
    assert plan(op.pattern_three(bars)).count("Exchange hashpartitioning") == 1


def test_rows_move_once_into_chunks(spark, monkeypatch):
    monkeypatch.setattr("candlemill.operators.chunks.stage", lambda df, label: df)
    bars = q.hourly(spark, FOLDER)
    text = plan(packed(bars, ["symbol"], ["group_id"], bucket_chunk()))
    assert text.count("Exchange") == text.count("Exchange hashpartitioning(symbol") == 1
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.count", lambda df: pytest.fail("counted"))
    text = plan(packed_by_rows(q.events(spark, FOLDER), ["symbol"], ["timestamp", "agg_trade_id"]))
    assert text.count("Exchange") == text.count("Exchange rangepartitioning(symbol") == 1


def test_summaries_read_the_value_alone(spark):
    text = plan(op.ema(q.hourly(spark, FOLDER)).select("symbol", "group_id", "ema7"))
    assert "ReadSchema: struct<symbol:string,_chunk:bigint,_rows:array<struct<close_price:double>>>" in text


@pytest.mark.parametrize("wide", [False, True])
def test_bars_of_an_hour_are_hashed(spark, wide):
    text = plan(op.klines(q.events(spark, FOLDER), q.HOUR, wide_ids=wide))
    assert ("SortAggregate" in text) == wide
    assert plan(q.klines_1h(spark, FOLDER)).count("SortAggregate") == 0



def test_charts_open_only_their_days(spark, tmp_path):
    from candlemill.operators import chart_series

    rows = spark.sql(
        "SELECT 'A' AS symbol, timestamp'2024-01-01' + make_interval(0, 0, 0, id) AS window_start, 1.0 AS open_price, "
        "1.0 AS high_price, 1.0 AS low_price, 1.0 AS close_price, 1.0 AS volume, 1.0 AS ema7, 1.0 AS ema20, "
        "CAST(NULL AS string) AS engulfing_pattern, date_add(date'2024-01-01', CAST(id AS int)) AS landing_date FROM range(30)"
    )
    rows.write.partitionBy("landing_date").parquet(f"{tmp_path}/patterns")
    found = chart_series(spark.read.parquet(f"{tmp_path}/patterns"), "A", "2024-01-05", "2024-01-07 12:00:00")
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "landing_date" in filters and ">=" in filters and "<=" in filters
    assert found.count() == 3
