import os
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from candlemill.operators import cast_trades
from candlemill.schemas import TRADE, TRADE_MESSAGE
from candlemill.sinks import (
    encode_alerts, encode_trades, rejected_trades, replace_table, upsert_partitions, upsert_table, write_landing,
)
from candlemill.sources import (
    read_landing, read_text_trades, read_trades_csv, read_trades_zip, topic_options,
)

LINES = [
    "1,10.5,2.0,1,1,1759276800000000,True,true",
    "2,,1.0,2,2,1759276800000000,false,true",          # no price
    "3,10.123456,1.0,3,3,1759276801000000,FALSE,TRUE",  # same case rules, many decimals
    "4,bad,1.0,4,4,1759276802000000,true,true",        # no number
    "5,11.0",                                          # too few columns
    "6,12.0,1.0,6,6,1759276803000000,true,true,extra",  # too many
]


def write(folder, name, lines=LINES):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def rows(df):
    return [tuple(r) for r in df.select(*TRADE.names).orderBy("agg_trade_id").collect()]


def test_csv(spark, tmp_path):
    path = write(tmp_path, "BTCUSDT-aggTrades-2025-10-01.csv")
    df = read_trades_csv(spark, path, tag_from_name=True)
    got = rows(df)
    assert got[0] == (1, 10.5, 2.0, 1, 1, 1759276800000000, True, True)
    assert [r[1] for r in got] == [10.5, None, 10.123456, None, 11.0, 12.0]
    assert got[4][2:] == (None,) * 6 and got[2][6:] == (False, True)
    tags = df.select("symbol", "landing_date").distinct().collect()
    assert [tuple(t) for t in tags] == [("BTCUSDT", date(2025, 10, 1))]
    assert spark.read.schema(TRADE).csv(path).schema == read_trades_csv(spark, path).schema


def test_archives_read_as_the_files_in_them(spark, tmp_path):
    names = ["BTCUSDT-aggTrades-2025-10-01", "ETHUSDT-aggTrades-2025-10-02"]
    for name in names:
        path = write(tmp_path, f"{name}.csv")
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as archive:
            archive.write(path, f"{name}.csv")
            archive.writestr("README.txt", "not trades")
    plain = read_trades_csv(spark, str(tmp_path / "*.csv"), tag_from_name=True)
    packed = read_trades_zip(spark, str(tmp_path / "*.zip"), tag_from_name=True)
    assert packed.schema.names == plain.schema.names
    key = ["symbol", "agg_trade_id"]
    assert packed.orderBy(*key).collect() == plain.orderBy(*key).collect()


def test_text_then_cast(spark, tmp_path):
    path = write(tmp_path, "t.csv")
    assert rows(cast_trades(read_text_trades(spark, path))) == rows(read_trades_csv(spark, path))


def landed(spark):
    return spark.createDataFrame(
        [("A", "2025-10-01", 1), ("A", "2025-10-02", 2), ("B", "2025-10-01", 3)],
        "symbol string, landing_date string, n long",
    ).withColumn("landing_date", F.to_date("landing_date"))


def test_landing_opens_only_the_partition_asked_for(spark, tmp_path):
    root = str(tmp_path / "landing")
    write_landing(landed(spark), root)
    df = read_landing(spark, root, "A", date(2025, 10, 2))
    assert [r.n for r in df.collect()] == [2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(landing_date" in plan and "symbol" in plan
    assert read_landing(spark, root).count() == 3


def test_upsert_replaces_touched_partitions_only(spark, tmp_path):
    root = str(tmp_path / "t")
    for _ in range(2):  # a re-run changes nothing
        upsert_partitions(landed(spark), root)
    changed = landed(spark).where("symbol = 'A' AND landing_date = DATE'2025-10-01'")
    upsert_partitions(changed.withColumn("n", F.lit(10).cast("long")), root)
    assert sorted(r.n for r in spark.read.parquet(root).collect()) == [2, 3, 10]


def test_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS serving_db LOCATION '{tmp_path}/serving'")
    assert "serving_db" in [r[0] for r in spark.sql("SHOW DATABASES").collect()]
    name = "serving_db.klines"
    assert not spark.catalog.tableExists(name)
    upsert_table(landed(spark), name)
    upsert_table(landed(spark).where("symbol = 'B'").withColumn("n", F.lit(30).cast("long")), name)
    assert sorted(r.n for r in spark.table(name).collect()) == [1, 2, 30]
    assert "n" in [r[0] for r in spark.sql(f"SHOW COLUMNS FROM {name}").collect()]
    described = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    assert described["landing_date"] == "date"
    assert spark.sql(f"SHOW TBLPROPERTIES {name}").count() >= 0
    assert "klines" in [t.name for t in spark.catalog.listTables("serving_db")]

    replace_table(landed(spark), "serving_db.copy")
    replace_table(landed(spark), "serving_db.copy")
    assert spark.table("serving_db.copy").count() == 3
    replace_table(landed(spark), "serving_db.copy", "append")
    assert spark.table("serving_db.copy").count() == 6
    with pytest.raises(Exception, match="already exists"):
        replace_table(landed(spark), "serving_db.copy", "errorifexists")
    for table in ("klines", "copy"):
        spark.sql(f"DROP TABLE IF EXISTS serving_db.{table}")
    assert not spark.catalog.tableExists(name)


def test_sql_tables_and_views(spark):
    spark.sql("DROP TABLE IF EXISTS people")
    spark.sql("CREATE TABLE people (id INT, name STRING, created_at TIMESTAMP) USING parquet")
    spark.sql("INSERT INTO people VALUES (1, 'a', TIMESTAMP'2025-01-01'), (2, 'b', NULL)")
    spark.sql("CREATE TABLE IF NOT EXISTS averages USING parquet PARTITIONED BY (name) AS "
              "SELECT id, avg(id) OVER (ORDER BY id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS a, "
              "name FROM people")
    spark.sql("INSERT INTO averages SELECT id + 10, 0.5, name FROM people")
    assert spark.table("averages").count() == 4
    inline = spark.sql("SELECT * FROM VALUES (1, 'x'), (2, 'y') AS t(id, name)")
    inline.createOrReplaceTempView("inline_rows")
    assert spark.sql("SELECT CAST(id AS STRING) FROM inline_rows ORDER BY id DESC "
                     "LIMIT 1 OFFSET 1").first()[0] == "1"
    assert spark.catalog.dropTempView("inline_rows")
    pdf = inline.toPandas()
    assert spark.createDataFrame(pdf).count() == 2
    for table in ("people", "averages"):
        spark.sql(f"DROP TABLE {table}")


def test_trade_messages(spark, tmp_path):
    lines = [*LINES, "7,1.0,1.0,7,7,1759276803000000, TRUE ,no"]
    df = read_text_trades(spark, write(tmp_path, "t.csv", lines))
    places = {"BTCUSDT": 1}
    got = encode_trades(df.withColumn("symbol", F.lit("BTCUSDT")), places)
    parsed = got.select("key", "partition", F.from_json("value", TRADE_MESSAGE).alias("m"))
    parsed = parsed.select("key", "partition", "m.*").orderBy("agg_trade_id").collect()
    assert [r.agg_trade_id for r in parsed] == [1, 3, 6, 7]  # rows that do not parse are skipped
    assert {(r.key, r.partition, r.symbol) for r in parsed} == {("BTCUSDT", 1, "BTCUSDT")}
    assert (parsed[3].is_buyer_maker, parsed[3].is_best_match) == (True, False)
    other = df.withColumn("symbol", F.when(F.col("agg_trade_id") != "1", "XRPUSDT"))
    assert encode_trades(other, places).count() == 0
    assert {r.reason for r in rejected_trades(other, places).collect()} == {"symbol without a partition"}
    left = rejected_trades(df.withColumn("symbol", F.lit("BTCUSDT")), places)
    assert left.count() + len(parsed) == df.count() and all(r.reason.endswith("does not parse") for r in left.collect())


def test_alert_messages_spell_out_nulls_and_zone(spark):
    df = spark.sql("SELECT TIMESTAMP'2025-01-01 00:15:00' AS window_start, 'A' AS symbol, "
                   "CAST(NULL AS DOUBLE) AS ema20, DATE'2025-01-01' AS landing_date")
    row = encode_alerts(df).first()
    assert row.key == "A"
    assert row.value == ('{"window_start":"2025-01-01T00:15:00Z","symbol":"A","ema20":null,'
                         '"landing_date":"2025-01-01"}')
    assert encode_alerts(df, keyed=False).columns == ["value"]


def test_topic_options():
    assert topic_options("h:9092", "t") == {
        "kafka.bootstrap.servers": "h:9092", "startingOffsets": "earliest", "subscribe": "t"
    }
    assert topic_options("h:9092", "t", [0, 2])["assign"] == '{"t": [0, 2]}'
