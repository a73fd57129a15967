"""Row-wise steps: tags, time buckets, casts, filters, back-fills."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.functions.columns import UNITS_PER_SECOND, floor_div
from candlemill.schemas import TRADE

BAR_SECONDS = 900


def add_ingest_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"ingest_date": F.current_date(), "ingest_timestamp": F.current_timestamp()}
    )


def bucket_id(epoch: str = "timestamp", interval_s: int = BAR_SECONDS, unit: str = "us") -> Column:
    """Number of the bar an epoch value falls in; the unit is stated, never guessed."""
    return floor_div(epoch, UNITS_PER_SECOND[unit] * interval_s)


def bucket_start(bucket: Column | str, interval_s: int = BAR_SECONDS) -> Column:
    bucket = F.col(bucket) if isinstance(bucket, str) else bucket
    return F.from_unixtime(bucket * F.lit(interval_s).cast("long"))


def add_time_bucket(
    df: DataFrame, interval_s: int = BAR_SECONDS, unit: str = "us", epoch: str = "timestamp"
) -> DataFrame:
    """``timestamp_date``, ``timestamp_second``, ``group_id`` and ``group_date`` of each trade."""
    second = floor_div(epoch, UNITS_PER_SECOND[unit])
    bucket = bucket_id(epoch, interval_s, unit)
    return df.withColumns(
        {
            "timestamp_date": F.from_unixtime(second),
            "timestamp_second": second,
            "group_id": bucket,
            "group_date": bucket_start(bucket, interval_s),
        }
    )


def tag_run(
    df: DataFrame, symbol: str | None = None, landing_date: str | date | None = None
) -> DataFrame:
    """Constant columns of one run; a column that is not given is left as it is in ``df``."""
    tags = {"transform_date": F.current_date(), "transform_timestamp": F.current_timestamp()}
    if landing_date is not None:
        tags["landing_date"] = F.to_date(F.lit(str(landing_date)), "yyyy-MM-dd")
    if symbol is not None:
        tags["symbol"] = F.lit(symbol)
    return df.withColumns(tags)


def cast_trades(df: DataFrame) -> DataFrame:
    """Typed trades from all-text columns; a field that does not parse becomes null."""
    return df.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in TRADE.fields],
        *[c for c in df.columns if c not in TRADE.names],
    )


def only_patterns(df: DataFrame, column: str = "pattern") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def backfill_nulls(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()}
    )
