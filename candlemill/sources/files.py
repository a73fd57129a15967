"""Trades at rest: CSV files, zip archives, landing and table partitions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.schemas import TRADE

# File names carry the symbol and the day or month: BTCUSDT-aggTrades-2025-10-01.csv
SYMBOL_IN_NAME = r"^([A-Za-z0-9]+)-"
DAY_IN_NAME = r"(\d{4}-\d{2}-\d{2})"
LINES_PER_BATCH = 50_000


def name_tags(file_name: Column) -> dict[str, Column]:
    """``symbol`` and ``landing_date`` taken from a file's name (the date is null for month files)."""
    return {
        "symbol": F.regexp_extract(file_name, SYMBOL_IN_NAME, 1),
        "landing_date": F.try_to_date(F.regexp_extract(file_name, DAY_IN_NAME, 1), "yyyy-MM-dd"),
    }


def read_trades_csv(
    spark: SparkSession, path: str | Sequence[str], tag_from_name: bool = False
) -> DataFrame:
    """Headerless trade files; a field that does not parse is null."""
    paths = [path] if isinstance(path, str) else list(path)
    trades = spark.read.schema(TRADE).option("header", "false").csv(paths)
    if tag_from_name:
        trades = trades.withColumns(name_tags(F.col("_metadata.file_name")))
    return trades


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the CSV members of each archive, a bounded batch at a time."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive:
                for member in archive.namelist():
                    if not member.lower().endswith(".csv"):
                        continue
                    with archive.open(member) as raw:
                        text = io.TextIOWrapper(raw, encoding="utf-8", newline=None)
                        while lines := [s.rstrip("\n") for s in islice(text, LINES_PER_BATCH)]:
                            yield pa.RecordBatch.from_pydict(
                                {"path": [path] * len(lines), "line": lines}
                            )


def trades_in_archives(archives: DataFrame, tag_from_name: bool = False) -> DataFrame:
    """Trades from rows of ``path`` and zip ``content``, unpacked where the rows are.

    One archive is one task's work, since a zip member cannot be entered in the middle; its lines leave
    the task in batches, and parsing them is Spark's own CSV parser with the same schema as plain files.
    """
    lines = archives.mapInArrow(_unzip, "path string, line string").where(F.length("line") > 0)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRADE.fields)
    trades = lines.select("path", F.from_csv("line", columns).alias("trade"))
    tags = name_tags(F.element_at(F.split("path", "/"), -1)) if tag_from_name else {}
    return trades.select("trade.*", *[c.alias(n) for n, c in tags.items()])


def read_trades_zip(spark: SparkSession, path: str, tag_from_name: bool = False) -> DataFrame:
    """Trades inside zip archives, many archives at once."""
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    return trades_in_archives(archives, tag_from_name)


def read_text_trades(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, for ``cast_trades``."""
    names = ", ".join(f"{n} string" for n in TRADE.names)
    return spark.read.schema(names).option("header", "false").csv(path)


def read_landing(
    spark: SparkSession, root: str, symbol: str | None = None, landing_date=None
) -> DataFrame:
    """Landed trades; the filters select partitions, so other symbols and days are never opened."""
    return between_dates(spark.read.parquet(root), landing_date, landing_date,
                         None if symbol is None else [symbol])


def between_dates(
    df: DataFrame, start=None, end=None, symbols: Sequence[str] | None = None
) -> DataFrame:
    if start is not None:
        df = df.where(F.col("landing_date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.where(F.col("landing_date") <= F.lit(str(end)).cast("date"))
    return df if symbols is None else df.where(F.col("symbol").isin(list(symbols)))
