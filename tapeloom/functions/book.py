"""Book functions over the level arrays bid_px, ask_px, bid_sz, ask_sz (level 0 first).

Level loops are written out as plain expressions, so they stay inside generated code.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.market import clip, ratio

LEVELS = 10


def level(array: str, i: int) -> Column:
    return F.get(F.col(array), i)


def size_at(array: str, i: int) -> Column:
    return F.coalesce(level(array, i), F.lit(0.0))


def depth(array: str, levels: int = LEVELS) -> Column:
    return reduce(add, [size_at(array, i) for i in range(levels)])


def weighted_depth(array: str, levels: int = LEVELS) -> Column:
    return reduce(add, [size_at(array, i) / F.lit(float(i + 1)) for i in range(levels)])


def valid_bbo() -> Column:
    return (level("bid_px", 0) > 0) & (level("ask_px", 0) > level("bid_px", 0))


def mid() -> Column:
    return F.when(valid_bbo(), (level("bid_px", 0) + level("ask_px", 0)) / 2)


def spread() -> Column:
    return F.when(valid_bbo(), level("ask_px", 0) - level("bid_px", 0))


def microprice(bid_weighted: bool = False) -> Column:
    """Size-weighted price: each price by the other side's size, or by its own when asked."""
    bid, ask, bs, as_ = level("bid_px", 0), level("ask_px", 0), size_at("bid_sz", 0), size_at("ask_sz", 0)
    top = bid * bs + ask * as_ if bid_weighted else ask * bs + bid * as_
    return F.when(valid_bbo() & (bs + as_ > 0), top / (bs + as_))


def imbalance(bids: str | Column, asks: str | Column) -> Column:
    """What one side has more than the other, as a share of both."""
    b, a = (F.col(c) if isinstance(c, str) else c for c in (bids, asks))
    return (b - a) / F.greatest(b + a, F.lit(1e-12))


def depth_imbalance(levels: int = LEVELS) -> Column:
    return imbalance(depth("bid_sz", levels), depth("ask_sz", levels))


def weighted_imbalance(levels: int = LEVELS, clipped: bool = False) -> Column:
    value = imbalance(weighted_depth("bid_sz", levels), weighted_depth("ask_sz", levels))
    return clip(value, -1, 1) if clipped else value


def pressure(imbalance_: Column, gap: Column) -> Column:
    return F.when(gap.isNull(), F.lit(0.0)).otherwise(imbalance_ / F.greatest(gap, F.lit(1e-12)))


def liquidity_pressure(levels: int = LEVELS) -> Column:
    return pressure(weighted_imbalance(levels), spread())


def level_imbalance() -> Column:
    return F.zip_with("bid_sz", "ask_sz", lambda b, a: (b - a) / F.greatest(b + a, F.lit(1e-12)))


def level_distance(array: str, tick: float) -> Column:
    return F.transform(array, lambda p: F.abs(p - mid()) / F.lit(tick))


def density(tick: float, top: int = 5) -> Column:
    """Size of the best levels of both sides per tick of price that they span."""
    span = (level("ask_px", top - 1) - level("ask_px", 0)) / F.lit(tick) + (level("bid_px", 0) - level("bid_px", top - 1)) / F.lit(tick)
    return (depth("bid_sz", top) + depth("ask_sz", top)) / F.greatest(span, F.lit(1.0))


def gap_count(tick: float, levels: int = LEVELS) -> Column:
    """Levels further apart than a tick, plus half for each empty one and one for a wide spread, per check."""
    total = F.when(level("ask_px", 0) - level("bid_px", 0) > tick * 2, 1.0).otherwise(0.0)
    for px, sz in (("bid_px", "bid_sz"), ("ask_px", "ask_sz")):
        for i in range(levels - 1):
            total = total + F.when(F.abs(level(px, i + 1) - level(px, i)) > tick, 1.0).otherwise(0.0)
            total = total + F.when(level(sz, i) == 0, 0.5).otherwise(0.0)
    return total / F.lit(float(2 * (levels - 1) + 1))


def gap_score(tick: float, threshold: float = 1.5, levels: int = LEVELS) -> Column:
    """Share of neighbouring levels that are apart or empty, with a penalty for a wide spread."""
    hits = []
    for px, sz in (("bid_px", "bid_sz"), ("ask_px", "ask_sz")):
        for i in range(levels - 1):
            apart = F.abs(level(px, i) - level(px, i + 1)) > tick * threshold
            hits.append(F.when(apart, 1.0).when(level(sz, i) == 0, 0.5).otherwise(0.0))
    wide = F.when(F.abs(level("ask_px", 0) - level("bid_px", 0)) > tick * 2, 1.0).otherwise(0.0)
    return (reduce(add, hits) + wide) / (F.lit(float(2 * (levels - 1))) + wide)


def mean_size(levels: int = LEVELS) -> Column:
    """Mean of the sizes above 0."""
    filled = reduce(add, [F.when(size_at(c, i) > 0, 1).otherwise(0) for c in ("bid_sz", "ask_sz") for i in range(levels)])
    return F.coalesce(ratio(depth("bid_sz", levels) + depth("ask_sz", levels), filled.cast("double")), F.lit(0.0))


def first_soft_gap(px: str, sz: str, mean: Column, tick: float, levels: int = LEVELS) -> Column:
    """Strength of the first gap: a jump of two ticks, or of one where the sizes are thin."""
    out = F.lit(0.0)
    for i in reversed(range(levels - 1)):
        jump = F.abs(level(px, i) - level(px, i + 1)) / tick
        here, following = size_at(sz, i), size_at(sz, i + 1)
        scarce = F.greatest(F.lit(0.0), 1 - F.least(here, following) / F.greatest(mean, F.lit(1e-9)))
        void = F.greatest(F.lit(0.0), 1 - (here + following) / 2 / F.greatest(mean, F.lit(1e-9)))
        strength = jump + scarce * 0.80 + void * 0.60
        out = F.when((jump >= 2.0) | ((jump >= 1.0) & (scarce >= 0.65) & (strength >= 1.60)), strength).otherwise(out)
    return out


def first_wall(px: str, sz: str, mean: Column, multiple: float = 3.0) -> Column:
    """First level whose size reaches ``multiple`` times the mean, as struct(at, px, sz)."""
    walls = F.filter(F.arrays_zip(F.col(px).alias("px"), F.col(sz).alias("sz")), lambda lv: lv["sz"] >= mean * multiple)
    return F.try_element_at(walls, F.lit(1))


def biggest_wall_distance(px: str, sz: str, price: Column, multiple: float = 3.0) -> Column:
    """Distance from price to the biggest level if it exceeds ``multiple`` times the side's mean, else 0."""
    top = F.array_max(sz)
    at = F.element_at(F.col(px), F.array_position(sz, top).cast("int"))
    mean = depth(sz) / F.size(sz)
    return F.when(top > mean * multiple, F.round(F.abs(price - at), 4)).otherwise(F.lit(0.0))


def walk_fill(px: str, sz: str, quantity: Column) -> Column:
    """Consume levels until ``quantity`` is filled: struct(filled, cost, vwap)."""
    start = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("cost"))

    def take(acc: Column, lv: Column) -> Column:
        use = F.greatest(F.least(quantity - acc["filled"], lv["sz"]), F.lit(0.0))
        return F.struct((acc["filled"] + use).alias("filled"), (acc["cost"] + use * lv["px"]).alias("cost"))

    zipped = F.arrays_zip(F.col(px).alias("px"), F.col(sz).alias("sz"))
    return F.aggregate(zipped, start, take, lambda acc: F.struct(acc["filled"], acc["cost"], ratio(acc["cost"], acc["filled"]).alias("vwap")))
