"""Column expressions shared by batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS_PER_SECOND = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}


def floor_div(value: Column | str, by: int) -> Column:
    """Integer division that rounds down below zero too, without passing through doubles."""
    value = F.col(value) if isinstance(value, str) else value
    by = F.lit(by).cast("long")
    return F.call_function("div", value - F.pmod(value, by), by)


def half_up(value: Column | str, digits: int) -> Column:
    """``trunc(x * 10^digits + 0.5) / 10^digits``.

    Cuts toward zero, so it differs from ``round`` below zero: -1.239 gives -1.23 here.
    """
    value = F.col(value) if isinstance(value, str) else value
    factor = float(10**digits)
    return (value * factor + 0.5).cast("long") / F.lit(factor)


def event_time(epoch: Column | str, unit: str = "us") -> Column:
    """Event time from an epoch number, cut to the millisecond."""
    epoch = F.col(epoch) if isinstance(epoch, str) else epoch
    per_ms = UNITS_PER_SECOND[unit] // 1_000
    if per_ms == 0:
        return F.timestamp_seconds(epoch)
    return F.timestamp_millis(floor_div(epoch, per_ms))


def loose_boolean(text: Column | str) -> Column:
    """True only for the word ``true`` in any case, padded or not."""
    text = F.col(text) if isinstance(text, str) else text
    return F.lower(F.trim(text)) == "true"


def shown(value: Column | str, digits: int = 10) -> Column:
    """A number as text with thousands set apart and ``digits`` decimals."""
    return F.format_number(value, digits)
