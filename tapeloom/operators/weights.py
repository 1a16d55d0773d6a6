"""Soft labels, label confidence and training weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.market import LONG, NEUTRAL, SHORT, clip
from tapeloom.operators.ahead import Extremes, doubles, floats, streamed
from tapeloom.operators.labels import LONG_SL, LONG_TP, QUALITY_STRONG, QUALITY_WEAK, REGIME_BARS, SHORT_SL, SHORT_TP, TIMEOUT, lookup
from tapeloom.operators.ordered import beside, exact_quantiles
from tapeloom.runtime import frozen

# Chance that a long pays, by path outcome, for a weak and a strong label.
SOFT_LONG = {LONG_TP: (0.78, 0.90), LONG_SL: (0.10, 0.08), SHORT_TP: (0.10, 0.10), SHORT_SL: (0.68, 0.72)}
# The same for a short.
SOFT_SHORT = {SHORT_TP: (0.78, 0.90), SHORT_SL: (0.10, 0.08), LONG_TP: (0.10, 0.10), LONG_SL: (0.68, 0.72)}


def _one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    return df.transform(beside, row)


def mean_normalised(df: DataFrame, raw: Column, name: str) -> DataFrame:
    """A weight over its mean in the whole table; 1 where the mean is 0."""
    out = df.withColumn("_raw", raw)
    out = _one_row(out, out.agg(F.avg("_raw").alias("_mean")))
    return out.withColumn(name, F.when(F.col("_mean") > 1e-8, F.col("_raw") / F.col("_mean")).otherwise(1.0)).drop("_raw", "_mean")


def confidence() -> Column:
    """Sure after a clear outcome; after a timeout by how much of the horizon was used."""
    strong, timeout = F.col("signal_quality") == QUALITY_STRONG, F.col("path_outcome") == TIMEOUT
    used = clip(F.col("label_horizon_steps") / F.when(F.col("effective_horizon") > 0, F.col("effective_horizon")).otherwise(1), 0, 1)
    boost = F.when(strong, 0.10).otherwise(0.0)
    unclear = 0.40 + boost + 0.15 * used + 0.05 * F.col("timeout_move_exceeded_band")
    return clip(F.when(timeout, unclear).otherwise(0.75 + boost), 0, 1)


def threshold_fallback(df: DataFrame, column: str = "label_dynamic_threshold") -> DataFrame:
    """Fill missing thresholds with the column's median."""
    q = exact_quantiles(df, {"_q": column}, [0.5]).select(F.get("_q", 0).alias("_median"))
    return _one_row(df, q).withColumn(column, F.coalesce(column, "_median", F.lit(1e-4))).drop("_median")


def analytical(df: DataFrame, scale: float = 1.5, span: float = 0.40, strong_boost: float = 1.30, floor: float = 0.10) -> DataFrame:
    """Soft labels from a table of outcomes, or a sigmoid of the move after a timeout, with weights."""
    strong, path = F.col("signal_quality") == QUALITY_STRONG, F.col("path_outcome")
    x = clip(scale * F.coalesce(F.col("forward_return") / F.greatest("label_dynamic_threshold", F.lit(1e-10)), F.lit(0.0)), -60, 60)
    late = 0.5 + span * (1 / (1 + F.exp(-x)) - 0.5)

    def table(values, timeout):
        out = F.lit(0.5)
        for outcome, (weak, good) in values.items():
            out = F.when(path == outcome, F.when(strong, good).otherwise(weak)).otherwise(out)
        return F.when(path == TIMEOUT, timeout).otherwise(out)

    out = df.withColumns({"soft_label_long": table(SOFT_LONG, late), "soft_label_short": table(SOFT_SHORT, 1 - late), "label_confidence": confidence()})
    label = F.col("bias_label")
    out = out.withColumn("soft_label", F.when(label == LONG, F.col("soft_label_long")).when(label == SHORT, F.col("soft_label_short")).otherwise(0.5))
    clarity = F.abs(F.col("soft_label") - 0.5) * 2
    raw = F.greatest(F.col("label_confidence") * clarity * F.when(strong, strong_boost).otherwise(1.0), F.lit(floor))
    return mean_normalised(out, raw, "soft_sample_weight")


def _normal(*parts: Column) -> Column:
    """A standard normal number from a hash of the parts, the same on every run."""
    unit = lambda tag: (F.pmod(F.xxhash64(*parts, F.lit(tag)), F.lit(2**52)) + 0.5) / float(2**52)
    return F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * 3.141592653589793 * unit(2))


def monte_carlo(df: DataFrame, horizon: int, scenarios: int = 50, seed: int = 42, price: str = "close", horizon_std: float = 0.30, tp_std: float = 0.20, sl_std: float = 0.20) -> DataFrame:
    """Share of disturbed targets, stops and horizons under which the label wins, and its entropy confidence.

    ``horizon`` bounds the column effective_horizon. Random numbers come from hashes of (symbol,
    sequence, scenario, seed), so any partitioning gives the same result. The extremes of the price
    over each disturbed horizon are looked up while the rows stream by. The hash gives no draw beyond
    nine deviations, so the rows held are all that a disturbed horizon can reach.
    """
    reach = int(horizon * (1 + 9 * horizon_std)) + 1
    thr, label = F.col("label_dynamic_threshold"), F.col("bias_label")
    numbers = F.sequence(F.lit(0), F.lit(scenarios - 1))

    def draw(s: Column, k: int, std: float) -> Column:
        return 1 + std * _normal(F.col("symbol"), F.col("sequence"), s, F.lit(seed), F.lit(k))

    def spans(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_spans", F.transform(numbers, lambda s: F.greatest((F.col("effective_horizon") * draw(s, 1, horizon_std)).cast("int"), F.lit(1))))

    def extremes(part: pa.Table, _: int, n: int) -> list[pa.Array]:
        x, begin = floats(part, price), np.repeat(np.arange(1, n + 1), scenarios)
        wanted = part.column("_spans").slice(0, n).combine_chunks().flatten().to_numpy()
        found = Extremes(x, x, reach).over(begin, np.minimum(np.minimum(wanted, reach), part.num_rows - begin))
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * scenarios)
        return [pa.ListArray.from_arrays(offsets, doubles(v - x[begin - 1])) for v in found]

    added = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("_top", "_bottom")]
    rows = streamed(df, reach, added, extremes, prepare=spans, spent=["_spans"])

    def play(s):
        tp, sl = F.greatest(thr * 1.5 * draw(s, 2, tp_std), F.lit(1e-5)), F.greatest(thr * draw(s, 3, sl_std), F.lit(1e-5))
        up, down = F.get("_top", s), F.get("_bottom", s)
        win = F.when(label == LONG, up >= tp).when(label == SHORT, down <= -tp)
        lose = F.when(label == LONG, down <= -sl).when(label == SHORT, up >= sl)
        return F.when(win, 1).when(lose, 2).otherwise(0)

    rows = rows.withColumn("_plays", F.transform(numbers, play))
    share = lambda v: F.size(F.filter("_plays", lambda x: x == v)) / F.lit(float(scenarios))
    out = rows.withColumns({"_w": share(1), "_l": share(2)})
    p = [F.greatest(c, F.lit(1e-10)) for c in (F.col("_w"), F.col("_l"), 1 - F.col("_w") - F.col("_l"))]
    total = p[0] + p[1] + p[2]
    entropy = F.lit(0.0)
    for c in p:
        entropy = entropy - c / total * F.ln(c / total)
    out = out.withColumns({"soft_label": F.when(label == NEUTRAL, 0.5).otherwise(F.col("_w")), "label_confidence": 1 - entropy / F.ln(F.lit(3.0))})
    boost = F.when(F.col("signal_quality") == QUALITY_STRONG, 1.30).otherwise(1.0)
    raw = F.greatest(F.col("label_confidence") * F.abs(F.col("soft_label") - 0.5) * 2 * boost, F.lit(0.10))
    return mean_normalised(out, raw, "soft_sample_weight").drop("_w", "_l", "_top", "_bottom", "_plays")


def bar_soft_labels(df: DataFrame) -> DataFrame:
    """Longs from 0.55 to 1, shorts from 0.45 to 0, by event score and speed; 0.5 without an event."""
    longest = lookup(REGIME_BARS, F.col("regime_label"), 6)
    speed = clip(1 - F.col("label_horizon_steps") / longest, 0, 1)
    strength = clip(clip(F.coalesce("event_score", F.lit(0.0)), 0, 1) * 0.6 + speed * 0.4, 0, 1)
    event = F.col("is_event") == 1
    soft = F.when(event & (F.col("bias_label") == LONG), 0.55 + strength * 0.45).when(event & (F.col("bias_label") == SHORT), 0.45 - strength * 0.45).otherwise(0.5)
    out = df.withColumn("soft_label", soft)
    out = out.withColumn("label_confidence", clip(F.abs(F.col("soft_label") - 0.5) * 2, 0, 1))
    return out.withColumn("soft_sample_weight", 1 + F.col("label_confidence"))


def merged_soft_labels(df: DataFrame) -> DataFrame:
    """Bar soft labels, with the higher confidence of both methods and the analytical weight scaled by it."""
    own = bar_soft_labels(df)
    own = own.withColumnsRenamed({"soft_label": "_soft", "label_confidence": "_conf"}).drop("soft_sample_weight")
    out = analytical(own)
    return out.withColumns(
        {
            "soft_label": F.col("_soft"),
            "label_confidence": F.greatest("label_confidence", "_conf"),
            "soft_sample_weight": F.col("soft_sample_weight") * (0.75 + 0.5 * F.col("_conf")),
        }
    ).drop("_soft", "_conf")


def ruin_probability(tp: Column, sl: Column, sigma: Column | None = None, drift: Column | None = None, clip_share: float = 0.3) -> Column:
    """Chance of meeting the target before the stop, for a random walk with or without drift."""
    a, b = F.greatest(tp, F.lit(1e-12)), F.greatest(sl, F.lit(1e-12))
    fair = b / (a + b)
    if drift is None:
        return fair
    s = F.greatest(sigma, F.lit(1e-12))
    mu = F.least(F.greatest(drift, -s * clip_share), s * clip_share)
    part = lambda d: F.exp(F.least(F.greatest(-2 * mu * d / (s * s), F.lit(-500.0)), F.lit(500.0)))
    below = 1 - part(a + b)
    return clip(F.when(F.abs(below) < 1e-9, fair).otherwise((1 - part(b)) / (below + 1e-15)), 0.005, 0.995)


def wall_confidence(strength: Column, scale: float = 3.0, low: float = 0.40, high: float = 1.20) -> Column:
    return low + (high - low) / (1 + F.exp(-strength / max(scale, 1e-6) * 3.0))


def structural_weights(df: DataFrame, tp: float = 1.5, sl: float = 1.0, low: float = 0.10, high: float = 3.50) -> DataFrame:
    """Weight from ruin probability, horizon, walls and quality, over its mean and clipped."""
    df = threshold_fallback(frozen(df))  # two quantiles and a mean read the rows
    thr = F.col("label_dynamic_threshold")
    p = F.when(F.col("bias_label") == NEUTRAL, 0.5).otherwise(ruin_probability(thr * tp, thr * sl))
    h = F.greatest(F.col("effective_horizon").cast("double"), F.lit(1.0))
    q = exact_quantiles(df.withColumn("_h", h), {"_q": "_h"}, [0.5]).select(F.greatest(F.get("_q", 0), F.lit(1.0)).alias("_mh"))
    df = _one_row(df, q)
    penalty = clip(F.pow(1 / F.greatest(h / F.col("_mh"), F.lit(0.1)), 0.5), 0.40, 1.60)
    wall = wall_confidence(F.greatest("bid_wall_strength", "ask_wall_strength"))
    quality = F.when(F.col("signal_quality") == QUALITY_STRONG, 1.40).when(F.col("signal_quality") == QUALITY_WEAK, 1.00).otherwise(0.60)
    out = mean_normalised(df, clip(p * penalty * wall * quality, low, high), "mc_sample_weight")
    return out.withColumn("mc_sample_weight", clip(F.col("mc_sample_weight"), low, high)).drop("_mh")


def training_weights(df: DataFrame, mode: str = "combined", strong: float = 2.0, weak: float = 1.0) -> DataFrame:
    """Product of quality, soft-label and structural weights with stability, over its mean.

    ``geometric`` leaves quality and soft labels out.
    """
    w = F.lit(1.0)
    if mode == "combined":
        w = F.when(F.col("signal_quality") == QUALITY_STRONG, strong).otherwise(weak) * F.greatest(F.coalesce("soft_sample_weight", F.lit(1.0)), F.lit(0.05))
    w = w * F.greatest(F.coalesce("mc_sample_weight", F.lit(1.0)), F.lit(0.05)) * (0.2 + 0.8 * clip(F.coalesce("label_stability", F.lit(1.0)), 0, 1))
    return mean_normalised(df, w, "sample_weight")


def recency_weights(df: DataFrame, half_life_days: float = 7.0) -> DataFrame:
    """Weights that halve with every half-life of age in whole days, with mean 1."""
    df = _one_row(df, df.agg(F.max("ts_event").alias("_now")))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    age = F.floor((micros("_now") - micros("ts_event")) / F.lit(86_400_000_000))
    return mean_normalised(df, F.exp(-F.ln(F.lit(2.0)) * F.greatest(age, F.lit(0)) / max(half_life_days, 1.0)), "recency_weight").drop("_now")


def soft_label_check(df: DataFrame) -> DataFrame:
    """One row: share of soft labels near a half, mean confidence, and its correlation with clarity."""
    s = F.col("soft_label")
    out = df.agg(
        F.avg(((s > 0.45) & (s < 0.55)).cast("double")).alias("near_half"),
        F.avg("label_confidence").alias("mean_confidence"),
        F.corr("label_confidence", F.abs(s - 0.5)).alias("confidence_clarity"),
        F.avg((s > 0.5).cast("double")).alias("long_share"),
    )
    return out.withColumn("valid", (F.col("near_half") < 0.30) & (F.col("mean_confidence") > 0.50))


def weight_check(df: DataFrame, column: str = "mc_sample_weight") -> DataFrame:
    """One row: mean, deviation, share of small weights, and means by label quality."""
    w, q = F.col(column), F.col("signal_quality")
    out = df.agg(
        F.avg(w).alias("mean_weight"),
        F.stddev_pop(w).alias("std_weight"),
        F.avg((w < 0.30).cast("double")).alias("low_share"),
        F.avg(F.when(q == QUALITY_STRONG, w)).alias("mean_strong"),
        F.avg(F.when(q == QUALITY_WEAK, w)).alias("mean_weak"),
    )
    return out.withColumn("valid", (F.col("mean_weight") > 0.80) & (F.col("mean_weight") < 1.20) & (F.col("low_share") >= 0.05))
