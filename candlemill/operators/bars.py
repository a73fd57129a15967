"""Bars and bucket statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.functions.columns import UNITS_PER_SECOND
from candlemill.operators.projections import BAR_SECONDS, bucket_id, bucket_start

BAR_VALUES = ["open_price", "high_price", "low_price", "close_price", "volume"]


# Fewer bits than this are not worth trying.
ID_BITS = 28


def _id_bits(interval_s: int, unit: str) -> int:
    """What the time within a bucket leaves of a positive long."""
    return 63 - (interval_s * UNITS_PER_SECOND[unit] - 1).bit_length()


def _ends(priced: Column, interval_s: int, unit: str, bits: int) -> list[Column]:
    """Open and close by (time, id), for ids cut at multiples of half their range and again between those: ids
    less than a quarter of it apart are in order under one of the two. One number is kept for ids that are null.
    """
    span = F.lit(interval_s * UNITS_PER_SECOND[unit])
    inside = F.shiftleft(F.coalesce(F.pmod(F.col("timestamp"), span), F.lit(0)), bits)
    id_, half, mask = F.col("agg_trade_id"), 1 << bits - 2, F.lit((1 << bits - 1) - 1)
    low = id_.bitwiseAND(mask)
    cuts = {"0": (low, F.shiftright(id_, bits - 1)),
            "1": ((low + half).bitwiseAND(mask), F.shiftright(F.shiftright(id_, bits - 2) + 1, 1))}
    found = []
    for n, (low, part) in cuts.items():
        key = F.when(priced, inside + F.coalesce(low + 1, F.lit(0)))
        part = F.when(priced, part)
        found += [F.min_by("price", key).alias(f"_open{n}"), F.max_by("price", key).alias(f"_close{n}"),
                  F.min(part).alias(f"_first{n}"), F.max(part).alias(f"_last{n}")]
    return found


def _checked(name: str) -> Column:
    side = name.removesuffix("_price")
    whole = [F.col(f"_first{n}").eqNullSafe(F.col(f"_last{n}")) for n in "01"]
    complaint = F.raise_error(F.lit("trade ids of one bucket lie too far apart: use wide_ids=True")).cast("double")
    return F.when(whole[0], F.col(f"_{side}0")).when(whole[1], F.col(f"_{side}1")).otherwise(complaint)


def klines(
    trades: DataFrame,
    interval_s: int = BAR_SECONDS,
    keys: Sequence[str] = ("symbol",),
    price_scale: int = 4,
    volume_scale: int = 1,
    unit: str = "us",
    ids_follow_time: bool = False,
    wide_ids: bool = False,
) -> DataFrame:
    """Open, high, low, close and volume per key and bucket.

    The open (close) is the price of the first (last) trade by ``(timestamp, agg_trade_id)`` among
    those with a price, whatever order the rows arrive in. Every aggregate has a partial form, so one
    symbol with most of the trades is reduced to a row per bucket and task before the shuffle.

    Time and id are compared as one long: the time within the bucket, then the low bits of the id. That
    stays a hash aggregation. The bits left for ids are 63 less those of the interval; ids of one bucket may lie a quarter
    of their range apart (2^31 for 15 minutes in microseconds, 2^29 for an hour), wherever that lies. A bucket
    whose ids are further apart makes the job fail rather than give a wrong price; ``wide_ids=True`` is for
    feeds with such ids (hashes, say) and keeps both numbers in full, which Spark aggregates by sorting. Intervals that
    leave ids fewer than ``ID_BITS`` bits (a day in microseconds) always do so.

    ``ids_follow_time=True`` is for feeds whose trade ids grow with time, with any interval. The claim is checked: a bucket
    whose smallest (largest) id is not at its earliest (latest) time makes the job fail too.
    """
    bucketed = trades.select(
        bucket_id("timestamp", interval_s, unit).alias("group_id"),
        *keys, "timestamp", "agg_trade_id", "price", "quantity",
    )
    # The bucket comes first among the keys: files are mostly in time order already, so the sort
    # ahead of the aggregation finds nearly sorted rows and decides on the leading number.
    grouped = bucketed.groupBy("group_id", *keys)
    priced = F.col("price").isNotNull()
    common = {
        "open_time": F.min("timestamp"),
        "close_time": F.max("timestamp"),
        "high_price": F.max("price"),
        "low_price": F.min("price"),
        "volume": F.sum("quantity"),
    }
    if ids_follow_time:
        trade_id = F.when(priced, F.col("agg_trade_id"))
        at = F.when(priced, F.col("timestamp"))
        bars = grouped.agg(
            *[c.alias(n) for n, c in common.items()],
            F.min_by("price", trade_id).alias("open_price"),
            F.max_by("price", trade_id).alias("close_price"),
            F.min(at).alias("_first_at"), F.min_by("timestamp", trade_id).alias("_first_id_at"),
            F.max(at).alias("_last_at"), F.max_by("timestamp", trade_id).alias("_last_id_at"),
        )
        broken = ~(
            F.col("_first_at").eqNullSafe(F.col("_first_id_at"))
            & F.col("_last_at").eqNullSafe(F.col("_last_id_at"))
        )
        complaint = F.raise_error(F.lit("trade ids do not follow time: use ids_follow_time=False"))
        checked = {
            n: F.when(broken, complaint.cast("double")).otherwise(F.col(n))
            for n in ("open_price", "close_price")
        }
        bars = bars.withColumns(checked)
    elif not wide_ids and (bits := _id_bits(interval_s, unit)) >= ID_BITS:
        bars = grouped.agg(*[c.alias(n) for n, c in common.items()], *_ends(priced, interval_s, unit, bits))
        bars = bars.withColumns({n: _checked(n) for n in ("open_price", "close_price")})
    else:
        tick = F.when(priced, F.struct("timestamp", "agg_trade_id", "price"))
        bars = grouped.agg(
            *[c.alias(n) for n, c in common.items()],
            F.min(tick).getField("price").alias("open_price"),
            F.max(tick).getField("price").alias("close_price"),
        )
    scale = {n: price_scale for n in BAR_VALUES[:4]} | {"volume": volume_scale}
    return bars.select(
        "group_id",
        bucket_start("group_id", interval_s).alias("group_date"),
        "open_time",
        *[F.round(n, scale[n]).alias(n) for n in BAR_VALUES],
        "close_time",
        *keys,
    )


def bucket_stats(
    trades: DataFrame,
    interval_s: int = BAR_SECONDS,
    keys: Sequence[str] = ("symbol",),
    unit: str = "us",
) -> DataFrame:
    """Unrounded extremes, id range and volume per key and bucket."""
    return (
        trades.withColumn("group_id", bucket_id("timestamp", interval_s, unit))
        .groupBy("group_id", *keys)
        .agg(
            F.max("price").alias("high_price"),
            F.min("price").alias("low_price"),
            F.max("agg_trade_id").alias("max_id"),
            F.min("agg_trade_id").alias("min_id"),
            F.sum("quantity").alias("volume"),
        )
        .withColumn("group_date", bucket_start("group_id", interval_s))
    )
