"""Rows as keyed JSON messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.functions.columns import loose_boolean
from candlemill.schemas import TRADE, TRADE_MESSAGE

MESSAGE_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}


def _checked(text_trades: DataFrame, symbol_partition: dict[str, int]) -> DataFrame:
    """``text_trades`` with ``_trade`` (parsed), ``_partition`` and ``_reason``, why it cannot be sent (or null)."""
    numbers = [f for f in TRADE.fields if f.name not in ("is_buyer_maker", "is_best_match")]
    fields = {f.name: F.col(f.name).try_cast(f.dataType) for f in numbers}
    fields["ts_int"] = fields.pop("timestamp")
    fields |= {n: loose_boolean(n) for n in ("is_buyer_maker", "is_best_match")}
    fields["symbol"] = F.col("symbol")
    pairs = [F.lit(x) for pair in symbol_partition.items() for x in pair]
    rows = text_trades.withColumns({
        "_trade": F.struct(*[fields[n].alias(n) for n in TRADE_MESSAGE.names]),
        "_partition": F.try_element_at(F.create_map(*pairs), F.col("symbol")),
    })
    reason = F.when(F.col("symbol").isNull() | F.col("_partition").isNull(), "symbol without a partition")
    for name in TRADE_MESSAGE.names:
        reason = reason.when(F.col(f"_trade.{name}").isNull(), f"{name} does not parse")
    return rows.withColumn("_reason", reason)


def encode_trades(text_trades: DataFrame, symbol_partition: dict[str, int]) -> DataFrame:
    """``key``, ``value`` and ``partition`` of each trade, from text columns and a symbol.

    Only trades that can be sent; ``rejected_trades`` has the others, and why.
    """
    return _checked(text_trades, symbol_partition).where(F.col("_reason").isNull()).select(
        F.col("_trade.symbol").alias("key"),
        F.to_json("_trade", MESSAGE_OPTIONS).alias("value"),
        F.col("_partition").alias("partition"),
    )


def rejected_trades(text_trades: DataFrame, symbol_partition: dict[str, int]) -> DataFrame:
    """The trades that ``encode_trades`` leaves out, as they came, with the first ``reason`` for it."""
    rows = _checked(text_trades, symbol_partition).where(F.col("_reason").isNotNull())
    return rows.select(*text_trades.columns, F.col("_reason").alias("reason"))


def encode_end_marks(ends: DataFrame) -> DataFrame:
    """``key`` and ``value`` of messages that say: of this ``symbol`` nothing before ``ts_int`` follows any more.

    They are trade messages with no more than those two fields, sent the way of the symbol's trades.
    """
    fields = [F.col(f.name) if f.name in ("symbol", "ts_int") else F.lit(None).cast(f.dataType).alias(f.name) for f in TRADE_MESSAGE.fields]
    return ends.select(F.col("symbol").alias("key"), F.to_json(F.struct(*fields), MESSAGE_OPTIONS).alias("value"))


def encode_alerts(patterns: DataFrame, keyed: bool = True) -> DataFrame:
    """Pattern rows as messages: nulls are spelled out, times are ISO-8601 in UTC."""
    value = F.to_json(F.struct(*patterns.columns), MESSAGE_OPTIONS).alias("value")
    return patterns.select(*([F.col("symbol").alias("key")] if keyed else []), value)
