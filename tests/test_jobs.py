import os
from datetime import date, timedelta

from pyspark.sql import functions as F

from candlemill import drop_staged, stage
from candlemill.__main__ import arguments, main
from candlemill.plans import run_day, run_range
from candlemill.sources import between_dates, read_trades_csv
from helpers import slow_day_ema, wave

DAY_0 = date(2025, 10, 1)
BASE = 1_759_276_800  # its midnight
BARS_PER_DAY = {0: 25, 1: 10, 2: 22}


def write_days(folder):
    """Two trades per bar: the second one closes it."""
    closes = {}
    for s, symbol in enumerate(("BTCUSDT", "ETHUSDT")):
        for d, n in BARS_PER_DAY.items():
            day, values = DAY_0 + timedelta(days=d), wave(n, 10 * s + d + 1)
            closes[(symbol, day)] = values
            with open(folder / f"{symbol}-aggTrades-{day}.csv", "w") as f:
                for i, v in enumerate(values):
                    at = (BASE + d * 86400 + i * 900) * 1_000_000
                    f.write(f"{2 * i},1.0,1.0,1,1,{at},true,true\n")
                    f.write(f"{2 * i + 1},{v},1.0,1,1,{at + 5},true,true\n")
    return closes


def table(spark, root, name="serving/pattern_two"):
    rows = spark.read.parquet(f"{root}/{name}")
    return sorted(rows.select(*sorted(rows.columns)).collect(), key=str)


def test_days_one_by_one_equal_the_range_and_can_be_repeated(spark, tmp_path):
    source = tmp_path / "files"
    source.mkdir()
    closes = write_days(source)
    csv = f"{source}/*.csv"
    whole, daily = str(tmp_path / "whole"), str(tmp_path / "daily")
    days = [DAY_0 + timedelta(days=d) for d in BARS_PER_DAY]
    run_range(spark, csv, whole, days[0], days[-1], ids_follow_time=True)
    got = table(spark, whole)
    assert len(got) == 2 * sum(BARS_PER_DAY.values())
    for symbol in ("BTCUSDT", "ETHUSDT"):
        mine = sorted((r for r in got if r.symbol == symbol), key=lambda r: r.group_id)
        want = {d: closes[(symbol, d)] for d in days}
        for period in (7, 20):
            flat = [v for d in days for v in slow_day_ema(want, period)[d]]
            assert [r[f"ema{period}"] for r in mine] == flat
    for day in days:
        run_day(spark, csv, daily, day)
    assert table(spark, daily) == got
    run_day(spark, csv, daily, days[1], ["ETHUSDT"])
    assert table(spark, daily) == got
    trades = spark.read.parquet(f"{daily}/transform/aggtrades")
    for name in ("timestamp_date", "timestamp_second", "group_id", "group_date", "transform_date",
                 "transform_timestamp", "ingest_date", "ingest_timestamp"):
        assert name in trades.columns
    assert trades.where(F.col("group_date") > F.col("timestamp_date")).count() == 0

    # a month job does not start over at midnight
    month = str(tmp_path / "month")
    run_range(spark, csv, month, scope="continuous")
    nulls = spark.read.parquet(f"{month}/serving/pattern_two").where("ema20 IS NULL").count()
    assert nulls == 2 * 19


def test_a_month_file_is_landed_by_the_day_of_each_trade(spark, tmp_path):
    write_days(tmp_path)
    with open(tmp_path / "BTCUSDT-aggTrades-2025-10.csv", "w") as month:
        for name in sorted(os.listdir(tmp_path)):
            if name.startswith("BTCUSDT-aggTrades-2025-10-"):
                month.write((tmp_path / name).read_text())
    days, month = f"{tmp_path}/days", f"{tmp_path}/month"
    run_range(spark, f"{tmp_path}/*-2025-10-*.csv", days, symbols=["BTCUSDT"], scope="continuous")
    run_range(spark, f"{tmp_path}/*-2025-10.csv", month, scope="continuous")
    assert table(spark, month) == table(spark, days) != []
    part = f"{tmp_path}/part"
    run_range(spark, f"{tmp_path}/*-2025-10.csv", part, DAY_0, DAY_0)
    assert {r.landing_date for r in table(spark, part)} == {DAY_0}


def test_files_of_other_days_are_not_opened(spark, tmp_path):
    write_days(tmp_path)
    trades = read_trades_csv(spark, f"{tmp_path}/*.csv", tag_from_name=True)
    day = between_dates(trades, DAY_0, DAY_0)
    assert len(day.collect()) == 2 * 2 * BARS_PER_DAY[0]
    scan = day._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numFiles").get().value() == 2


def test_command_line(spark, tmp_path):
    source = tmp_path / "files"
    source.mkdir()
    write_days(source)
    main(["day", "--source", f"{source}/*.csv", "--root", f"{tmp_path}/out", "--date", str(DAY_0),
          "--symbols", "BTCUSDT"])
    rows = spark.read.parquet(f"{tmp_path}/out/serving/pattern_two")
    assert {(r.symbol, r.landing_date) for r in rows.collect()} == {("BTCUSDT", DAY_0)}
    args = arguments(["range", "--source", "s", "--root", "r", "--scope", "continuous"])
    assert args.scope == "continuous" and args.start is None


def test_staged_tables_can_be_dropped(spark):
    drop_staged(spark)
    path = stage(spark.range(3)).inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert os.path.exists(path)
    assert drop_staged(spark) == 1 and not os.path.exists(path)


def test_staging_never_goes_to_one_machines_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    import pytest
    from candlemill.session import shared_dir

    def on(master, conf=None, directory=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: directory, applicationId=f"app {master}")
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: conf))

    for master in ("spark://h:7077", "yarn", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(on(master))
        assert shared_dir(on(master, "s3a://lake/shared/")) == "s3a://lake/shared"
        assert shared_dir(on(master, directory="hdfs:/shared/1")) == "hdfs:/shared/1"
    assert os.path.isdir(shared_dir(on("local[2]")))


def test_the_format_of_files_is_stated(spark, tmp_path):
    import pytest
    from candlemill.plans.jobs import land

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "BTCUSDT-aggTrades-2025-10-01.csv").write_text("no,trade,at,all\n")
    with pytest.raises(ValueError, match="format"):
        land(spark, f"{tmp_path}/in", f"{tmp_path}/root")
    with pytest.raises(Exception, match="no field of a row"):
        land(spark, f"{tmp_path}/in", f"{tmp_path}/root", format="csv")
