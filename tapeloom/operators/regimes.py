"""Market regimes from fitted percentiles.

A fit is one row of quantiles; applying it joins that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.market import clip
from tapeloom.functions.trading import normalised
from tapeloom.operators.ordered import beside, exact_quantiles

# Regime codes.
TRENDING, RANGING, VOLATILE, LOW_LIQUIDITY = range(4)
FEATURES = ["volatility", "activity", "volume_ratio", "cvd_impulse", "cvd_persistence", "trend_efficiency", "imbalance"]
# Percentiles that the rules use per feature.
PROBS = [0.10, 0.25, 0.30, 0.45, 0.50, 0.75, 0.90]


def q(feature: str, p: float) -> Column:
    return F.get(F.col(f"_q_{feature}"), PROBS.index(p))


def fit(features: DataFrame) -> DataFrame:
    """One row: the percentiles of every feature and of the three scores."""
    base = exact_quantiles(features, {f"_q_{f}": f for f in FEATURES}, PROBS)
    scored = scores(features, base)
    tops = exact_quantiles(scored, {"_s_trend": "trend_score", "_s_volatile": "volatile_score", "_s_quiet": "low_liquidity_score"}, [0.55, 0.80, 0.82])
    return base.transform(beside, tops)  # one row each


def scores(features: DataFrame, fitted: DataFrame) -> DataFrame:
    """Scores in [0, 1] of trend, volatility and low liquidity."""
    out = features.transform(beside, fitted)  # one row
    names = [c for c in fitted.columns]

    def place(f: str, low: float = 0.25, high: float = 0.90) -> Column:
        top = F.when(q(f, high) <= q(f, low), q(f, low) + 1e-6).otherwise(q(f, high))
        return clip((F.coalesce(F.col(f), F.lit(0.0)) - q(f, low)) / F.greatest(top - q(f, low), F.lit(1e-6)), 0, 1)

    vol, act, volume, impulse, persist, imb = (place(f) for f in ("volatility", "activity", "volume_ratio", "cvd_impulse", "cvd_persistence", "imbalance"))
    trend = place("trend_efficiency", 0.10, 0.75)
    out = out.withColumns(
        {
            "volatile_score": clip(0.50 * vol + 0.20 * act + 0.15 * volume + 0.10 * impulse + 0.05 * imb, 0, 1),
            "trend_score": clip(0.55 * trend + 0.25 * persist + 0.10 * act + 0.10 * imb, 0, 1),
            "low_liquidity_score": clip(0.55 * (1 - act) + 0.25 * (1 - volume) + 0.20 * (1 - impulse), 0, 1),
        }
    )
    return out.drop(*names)


def predict(features: DataFrame, fitted: DataFrame) -> DataFrame:
    """Regime and its probabilities: low liquidity before trending before volatile, else ranging."""
    only = [c for c in fitted.columns if c.startswith("_q_")]
    out = scores(features, fitted.select(*only)).transform(beside, fitted)  # one row
    c, tiny = F.col, F.lit(1e-6)
    trend_top, quiet_top, volatile_top = F.get("_s_trend", 0), F.get("_s_quiet", 1), F.get("_s_volatile", 2)
    at_least = lambda f, p, floor=tiny: c(f) >= F.greatest(q(f, p), F.lit(floor) if isinstance(floor, float) else floor)
    volatile = ((c("volatile_score") >= volatile_top) & (at_least("activity", 0.50) | at_least("volume_ratio", 0.50) | at_least("cvd_impulse", 0.45))) | at_least("volatility", 0.90)
    guards = (
        at_least("trend_efficiency", 0.45, 0.25).cast("int")
        + (c("cvd_persistence") >= F.greatest(q("cvd_persistence", 0.45), tiny) * 0.95).cast("int")
        + (c("activity") > F.greatest(q("activity", 0.30), tiny)).cast("int")
        + (c("volume_ratio") > F.greatest(q("volume_ratio", 0.30), tiny)).cast("int")
    )
    trending = (c("trend_score") >= trend_top) & (guards >= 2)
    below = lambda f, p: c(f) <= F.greatest(q(f, p), tiny)
    quiet = (c("low_liquidity_score") >= quiet_top) & below("activity", 0.50) & below("volume_ratio", 0.50) & below("volatility", 0.75) & below("cvd_impulse", 0.45)
    label = F.when(quiet, LOW_LIQUIDITY).when(trending, TRENDING).when(volatile, VOLATILE).otherwise(RANGING)
    out = out.withColumn("regime", label)
    calm = clip(1 - F.greatest("trend_score", "volatile_score", "low_liquidity_score"), 0, 1)
    parts = [c("trend_score"), calm, c("volatile_score"), c("low_liquidity_score")]
    raw = F.array(*[p * 0.55 + 1e-3 + F.when(c("regime") == i, 0.45).otherwise(0.0) for i, p in enumerate(parts)])
    return out.withColumn("regime_probs", normalised(raw)).drop(*fitted.columns)


def fit_shape(features: DataFrame, volatile: float = 0.70, quiet: float = 0.10) -> DataFrame:
    """One row: limits of price deviation, trend and liquidity from the shape features."""
    positive = lambda n: F.when(F.col(n) > 0, F.col(n))
    rows = features.select(positive("shape_std").alias("s"), positive("shape_trend").alias("t"), F.col("shape_liquidity").alias("l"))
    return exact_quantiles(rows, {"_s": "s", "_t": "t", "_l": "l"}, [quiet, 0.50, volatile]).select(F.get("_s", 2).alias("_high"), F.get("_t", 1).alias("_trend"), F.get("_l", 0).alias("_quiet"))


def predict_shape(features: DataFrame, fitted: DataFrame) -> DataFrame:
    out = features.transform(beside, fitted)  # one row
    c = F.col
    label = F.when((c("shape_trend") > c("_trend")) & (c("shape_std") <= c("_high")), TRENDING).when(c("shape_std") > c("_high"), VOLATILE).when(c("shape_liquidity") < c("_quiet"), LOW_LIQUIDITY).otherwise(RANGING)
    return out.withColumn("regime", label).drop("_high", "_trend", "_quiet")
