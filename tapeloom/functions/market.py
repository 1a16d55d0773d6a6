"""Fixed values of the feeds, and small Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes found in the feeds.
TRADE_ACTIONS = ["T", "F", "TRADE", "FILL"]
BUY_SIDES = ["A", "ASK", "BUY", "BID_LIFT"]
SELL_SIDES = ["B", "BID", "SELL", "ASK_HIT"]
# Label codes.
LONG, SHORT, NEUTRAL = 0, 1, 2
UNKNOWN_TEXT = ["", "NAN", "NONE"]


def is_trade(action: str | Column = "action") -> Column:
    return F.upper(F.trim(action)).isin(TRADE_ACTIONS)


def is_buy(side: str | Column = "side") -> Column:
    return F.upper(F.trim(side)).isin(BUY_SIDES)


def is_sell(side: str | Column = "side") -> Column:
    return F.upper(F.trim(side)).isin(SELL_SIDES)


def signed_size() -> Column:
    """Trade size, positive for buyers, negative for sellers, 0 for anything else."""
    size = F.col("size").cast("double")
    return F.when(is_trade() & is_buy(), size).when(is_trade() & is_sell(), -size).otherwise(F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def deadband_sign(c: Column, min_abs: float) -> Column:
    return F.when(c > min_abs, 1).when(c < -min_abs, -1).otherwise(0)


def at_least(count: Column, least: int, value: Column) -> Column:
    """The value of a frame, or null while the frame holds fewer than ``least`` values."""
    return F.when(count >= least, value)
