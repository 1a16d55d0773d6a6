"""Column formulas for costs, sizing, structure and gating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.market import LONG, NEUTRAL, SHORT, clip

# Structure buckets.
STRUCTURES = ["liquidity_sweep", "impulse_extension", "deep_pullback", "trend_pullback", "trend_confirmation", "mid_range_probe", "transition"]
# Setup codes.
SETUP_ABSORPTION, SETUP_SPOOFING, SETUP_OBI, SETUP_MIXED = range(4)
# Fixed values per regime: event score and probability that a signal needs.
EVENT_THRESHOLD = {"trending": 0.60, "ranging": 0.60, "volatile": 0.75}
PROBABILITY_THRESHOLD = {"trending": 0.60, "ranging": 0.60, "volatile": 0.65}


def structure_bucket() -> Column:
    """First rule that holds, from trend_strength, correction_depth, liquidity_sweep, kalman_trend_strength, event_score and price_position."""
    c = F.col
    rules = [
        F.abs("liquidity_sweep") >= 0.35,
        (c("trend_strength") >= 0.55) & (c("correction_depth") <= 0.20) & (c("kalman_trend_strength") >= 0.20),
        (c("trend_strength") >= 0.35) & (c("correction_depth") >= 0.60),
        (c("trend_strength") >= 0.30) & (c("correction_depth") >= 0.25),
        (c("kalman_trend_strength") >= 0.20) & (c("event_score") >= 1.0),
        c("price_position").between(0.20, 0.80),
    ]
    out = F.lit(STRUCTURES[-1])
    for rule, name in reversed(list(zip(rules, STRUCTURES))):
        out = F.when(rule, name).otherwise(out)
    return out


def setup_label() -> Column:
    """The one signal that stands out, else mixed."""
    absorb, spoof, obi = F.abs("absorption_intensity") > 0.20, F.abs("spoofing_ratio") > 0.15, F.abs("obi") > 0.20
    count = absorb.cast("int") + spoof.cast("int") + obi.cast("int")
    only = lambda c: (count == 1) & c
    return F.when(only(absorb), SETUP_ABSORPTION).when(only(spoof), SETUP_SPOOFING).when(only(obi), SETUP_OBI).otherwise(SETUP_MIXED)


def liquidity_score() -> Column:
    pos = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)).cast("double"), F.lit(0.0))
    wall = F.greatest(pos("bid_wall_strength"), pos("ask_wall_strength"))
    raw = F.log1p(pos("volume")) * (1 + F.abs("obi")) * (1 + wall) + 0.25 * pos("liquidity_density") + 0.10 * pos("gap_size")
    return clip(raw, 0, 100)


def fill_probability(queue: Column, traded: Column, depth: Column, latency_rows: Column, aggressiveness: Column) -> Column:
    """Chance that a resting order fills: traded volume against queue and depth, fading with latency."""
    zero = F.lit(0.0)
    share = F.greatest(traded, zero) / F.greatest(F.greatest(queue, zero) + F.greatest(depth, F.lit(1e-9)), F.lit(1e-9))
    return clip((share + F.greatest(aggressiveness, zero) * 0.25) * F.exp(-0.08 * F.greatest(latency_rows, F.lit(0))), 0, 1)


def round_trip_cost(cost: Column, commission: Column, tick_value: Column, spread_ticks: Column, slippage_ticks: Column, spread_mult: float = 0.5) -> Column:
    """The stated cost, or slippage, spread and commission both ways if more."""
    zero = F.lit(0.0)
    one_way = F.greatest(slippage_ticks, zero) + spread_mult * F.greatest(spread_ticks, zero) + F.greatest(commission, zero) / F.greatest(tick_value, F.lit(1e-8))
    return F.greatest(F.greatest(cost, zero), 2 * one_way)


def kelly_size(confidence: Column, win_rate: Column, win: Column, loss: Column, fraction: float = 0.25, max_size: int = 5) -> Column:
    """Lots by the Kelly share, at least one."""
    share = win_rate - (1 - win_rate) / F.try_divide(win, loss)
    size = F.rint(share * fraction * confidence * max_size)
    usable = (win > 0) & (loss > 0) & (win_rate > 0) & (share > 0)
    return F.when(usable, F.least(F.greatest(size, F.lit(1.0)), F.lit(float(max_size)))).otherwise(1.0).cast("int")


def confidence_size(confidence: Column, base: int = 1, max_size: int = 5) -> Column:
    steps = [(0.80, max_size), (0.70, max(base, max_size - 1)), (0.60, max(base, max_size // 2))]
    out = F.lit(base)
    for least, size in reversed(steps):
        out = F.when(confidence >= least, size).otherwise(out)
    return out


def fractional_kelly_size(p: Column, win: Column, loss: Column, *, uncertainty: Column, coverage: Column, entropy: Column, runtime: Column, fraction: float = 0.25, max_size: int = 5) -> Column:
    """Kelly share cut by uncertainty, coverage, regime entropy and runtime health; may be 0."""
    p = clip(p, 0, 1)
    share = p - (1 - p) / F.greatest(F.greatest(win, F.lit(1e-8)) / F.greatest(loss, F.lit(1e-8)), F.lit(1e-8))
    penalty = clip(1 - uncertainty, 0, 1) * clip(coverage, 0, 1) * clip(1 - entropy, 0, 1) * clip(runtime, 0, 1)
    size = F.rint(F.greatest(share, F.lit(0.0)) * fraction * penalty * max_size)
    return F.least(F.greatest(size, F.lit(0.0)), F.lit(float(max_size))).cast("int")


def position_size(tradeable: Column, kelly: Column, sizing_penalty: Column, confidence: Column, base: int = 1, max_size: int = 5) -> Column:
    """Kelly size scaled by a penalty where it trades and is not 0, else a size by confidence."""
    penalty = clip(sizing_penalty, 0, 1)
    scaled = F.when(penalty < 1, F.greatest(F.rint(kelly * penalty), F.lit(1.0))).otherwise(kelly)
    return F.when(tradeable & (kelly > 0), F.least(scaled, F.lit(float(max_size))).cast("int")).otherwise(confidence_size(confidence, base, max_size))


def normalised(probs: Column, n: int = 4) -> Column:
    """The first n probabilities over their sum, negatives as 0; 1/n each where they sum to 0."""
    kept = [F.greatest(F.get(probs, i), F.lit(0.0)) for i in range(n)]
    total = sum(kept[1:], kept[0])
    return F.array(*[F.when(total > 0, k / total).otherwise(F.lit(1.0 / n)) for k in kept])


def entropy(probs: Column, n: int = 4) -> Column:
    """Entropy of n probabilities over its maximum."""
    parts = [F.get(probs, i) * F.ln(F.greatest(F.get(probs, i), F.lit(1e-12))) for i in range(n)]
    return -sum(parts[1:], parts[0]) / F.ln(F.lit(float(n)))


def feature_hash(names: list[str]) -> Column:
    """SHA-256 of the named features as JSON."""
    return F.sha2(F.to_json(F.struct(*[F.col(n) for n in sorted(names)])), 256)


def by_regime(table: dict[str, float], default: float = 0.60) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(F.col("regime") == name, value).otherwise(out)
    return out


def gated_signal() -> tuple[Column, Column, Column]:
    """Signal, confidence and the step that blocked it, from regime, event_score, has_model, prob_long and prob_short."""
    quiet = F.col("event_score") < by_regime(EVENT_THRESHOLD)
    long, short, least = F.col("prob_long"), F.col("prob_short"), by_regime(PROBABILITY_THRESHOLD)
    up, down = (long >= least) & (long > short), (short >= least) & (short > long)
    blocked = F.when(quiet, "event_gate").when(~F.col("has_model"), "no_model").when(~(up | down), "below_confidence_threshold")
    open_ = ~quiet & F.col("has_model")
    signal = F.when(open_ & up, LONG).when(open_ & down, SHORT).otherwise(NEUTRAL)
    return signal, F.when(open_, F.greatest(long, short)).otherwise(0.0), blocked


def target_levels(mid: Column, tick: float, min_target: float = 15.0, max_stop: float = 20.0) -> dict[str, Column]:
    """Targets at the first gap ahead and stops at the wall behind, in price, bounded in ticks.

    Reads bid/ask_gap_px, bid/ask_wall_px, bid/ask_wall_strength and bid/ask_density. Dense books
    shorten a target, strong walls a stop.
    """
    c = F.col

    def target(gap, density):
        reach = gap * F.greatest(F.lit(0.5), 1 - F.coalesce(density, F.lit(1.0)) * 0.01)
        return F.greatest(F.when(gap > 0, reach).otherwise(tick * min_target), F.lit(tick * min_target * 0.5))

    def stop(wall, strength):
        reach = wall * F.greatest(F.lit(0.3), 1 - F.coalesce(strength, F.lit(0.0)) * 0.1)
        return clip(F.when(wall > 0, reach).otherwise(tick * min_target * 0.5), tick * 5, tick * max_stop)

    out = {
        "long_tp": target(c("ask_gap_px") - mid, c("ask_density")),
        "long_sl": stop(mid - c("bid_wall_px"), c("bid_wall_strength")),
        "short_tp": target(mid - c("bid_gap_px"), c("bid_density")),
        "short_sl": stop(c("ask_wall_px") - mid, c("ask_wall_strength")),
    }
    return {**out, "long_rr": out["long_tp"] / out["long_sl"], "short_rr": out["short_tp"] / out["short_sl"]}
