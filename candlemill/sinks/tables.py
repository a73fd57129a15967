"""Partitioned folders and catalog tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

PARTITIONS = ("symbol", "landing_date")


def _together(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring each partition's rows to few files, while a partition too big for one task is split."""
    return df.hint("rebalance", *keys)


def upsert_partitions(
    df: DataFrame, path: str, keys: Sequence[str] = PARTITIONS, together: bool = True
) -> None:
    """Replace the partitions ``df`` has rows for, and leave the others as they are.

    ``together=False`` writes rows from where they are. It is for input that already lies by partition
    (files per symbol and day), where moving every row would cost a shuffle and gain nothing.
    """
    rows = _together(df, keys) if together else df
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys).parquet(path)
    )


def write_landing(df: DataFrame, root: str, keys: Sequence[str] = PARTITIONS) -> None:
    """Landed trades by symbol and day; landing a day again replaces that day."""
    upsert_partitions(df, root, keys, together=False)


def replace_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """Create or replace a table; ``mode`` may also be ``errorifexists`` or ``append``."""
    df.write.mode(mode).format("parquet").saveAsTable(name)


def upsert_table(df: DataFrame, name: str, keys: Sequence[str] = PARTITIONS) -> None:
    """As ``upsert_partitions`` for a catalog table, which is created if missing."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        _together(df, keys).write.format("parquet").partitionBy(*keys).saveAsTable(name)
        return
    columns = spark.table(name).columns
    _together(df, keys).select(*columns).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).insertInto(name)
