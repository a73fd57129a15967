"""Counts, profiles, listings and look-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_counts(df: DataFrame, where: Column | None = None) -> DataFrame:
    """All rows, and those that meet ``where``, in one pass."""
    kept = F.lit(True) if where is None else where
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(kept).alias("rows_kept"))


def partition_counts(df: DataFrame, keys: Sequence[str] = ("symbol", "landing_date")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column: one row, one pass for all columns."""
    return df.select([F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def describe_trades(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    return df.describe(*columns)


def symbols(df: DataFrame) -> DataFrame:
    return df.select("symbol").distinct().orderBy("symbol")


def last_bar(bars: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "group_id") -> DataFrame:
    """The latest bar per key, by partial aggregation rather than a sort of each key's rows."""
    rest = [c for c in bars.columns if c not in (*keys, order)]
    packed = F.max(F.struct(order, *rest)).alias("last")
    return bars.groupBy(*keys).agg(packed).select(*keys, "last.*")


def latest(df: DataFrame, n: int, order: Sequence[str] = ("timestamp", "agg_trade_id")) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def sample_trades(df: DataFrame, fraction: float = 0.001, key: str = "agg_trade_id", seed: int = 42) -> DataFrame:
    """About ``fraction`` of the rows, chosen by a hash of ``key``: the same however the input is partitioned."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.where(drawn < int(fraction * (1 << 32)))


def matching(
    df: DataFrame,
    search: str | None = None,
    columns: Sequence[str] = (),
    equals: dict | None = None,
    is_null: dict[str, bool] | None = None,
) -> DataFrame:
    """Rows with ``search`` inside any of ``columns`` (any case), equal fields, null or set fields."""
    if search and columns:
        text = "".join("\\" + ch if ch in "\\%_" else ch for ch in search)
        df = df.where(reduce(or_, [F.col(c).ilike(f"%{text}%") for c in columns]))
    for name, value in (equals or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    for name, null in (is_null or {}).items():
        df = df.where(F.col(name).isNull() if null else F.col(name).isNotNull())
    return df


def page(
    df: DataFrame,
    sort: str,
    tiebreak: str,
    number: int = 1,
    size: int = 20,
    descending: bool = False,
    **filters,
) -> DataFrame:
    """One page of the matching rows; ``tiebreak`` makes the order total, so pages never overlap."""
    first = F.col(sort).desc() if descending else F.col(sort).asc()
    return (
        matching(df, **filters)
        .orderBy(first, F.col(tiebreak))
        .offset((number - 1) * size)
        .limit(size)
    )


def page_total(df: DataFrame, **filters) -> DataFrame:
    return matching(df, **filters).agg(F.count(F.lit(1)).alias("total"))


def unequal_matches(df: DataFrame, key: str) -> DataFrame:
    """For each key: its rows, and the pairs a self-join on ``a.key != b.key`` would give them.

    The pairs are counted as rows x (all rows - rows of the key), never listed.
    """
    known = df.where(F.col(key).isNotNull())
    total = known.agg(F.count(F.lit(1))).scalar()
    return (
        known.groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("pairs", F.col("rows") * (total - F.col("rows")))
    )
