"""Which rows are worth a look: broad filters, scores and causal thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.machines import RateGate
from tapeloom.functions.market import clip, ratio
from tapeloom.operators.labels import REGIME_EVENT, lookup
from tapeloom.operators.ordered import KEYS, ORDER, fits, numbered, running, windowed
from tapeloom.operators.orderstat import prefix_quantile
from tapeloom.operators.stateful import fold

SHIFTS = ["obi", "cvd", "micro_price", "liquidity_density"]


def prior_zscore(rows: DataFrame, columns: Sequence[str], n: int = 100, least: int = 20, *, order: Sequence[str] = ORDER, check: bool = True) -> DataFrame:
    """Each value against mean and deviation of the rows before it."""

    def z(df, w):
        prior, out = w.rowsBetween(-n, -1), {}
        for c in columns:
            score = (F.col(c) - F.avg(c).over(prior)) / (F.stddev_samp(c).over(prior) + 1e-9)
            out[f"{c}_prior_z"] = F.coalesce(F.when(F.count(c).over(prior) >= least, score), F.lit(0.0))
        return df.withColumns(out)

    return windowed(rows, z, before=n, order=order, check=check)


def causal_threshold(rows: DataFrame, score: str, rate: float, n: int = 100, least: int = 20, floor: float = 0.0, *, order: Sequence[str] = ORDER, check: bool = True) -> DataFrame:
    """The score that the wanted share of the last rows exceeded; the floor while there are too few. Null scores count as 0."""
    q = 1 - min(max(rate, 0.01), 0.99)
    known = F.coalesce(F.col(score), F.lit(0.0))

    def threshold(df, w):
        prior = w.rowsBetween(-n, -1)
        value = F.when(F.count(known).over(prior) >= least, F.percentile(known, q).over(prior))
        return df.withColumn("event_threshold", clip(F.coalesce(value, F.lit(floor)), floor, 1.0))

    return windowed(rows, threshold, before=n, order=order, check=check)


def bar_events(bars: DataFrame, rate: float = 0.20, floor: float = 0.20, fixed: bool = False, scale: float = 1.0, shift: float = 0.0, n: int = 100, least: int = 20) -> DataFrame:
    """Score bars by how far intensity, absorption and impact stand out and how one-sided flow is; flag those above a threshold.

    The threshold is a causal quantile, or fixed by regime. Columns hawkes_intensity,
    absorption_intensity, kyle_lambda, cvd_direction_pct and, if fixed, regime_label.
    """
    names = ["hawkes_intensity", "absorption_intensity", "kyle_lambda"]
    out = prior_zscore(bars, names, n, least, order=["bar_ts"], check=False)
    h, a, k = (F.col(f"{c}_prior_z") for c in names)
    flow = F.coalesce("cvd_direction_pct", F.lit(0.5))
    score = clip((h - 1.0) / 2, 0, 1) * 0.30 + clip((a - 1.0) / 2, 0, 1) * 0.30 + clip((k - 0.5) / 2, 0, 1) * 0.20 + clip((flow - 0.6) / 0.4, 0, 1) * 0.20
    out = out.withColumn("event_score", clip(score, 0, 1)).drop(*[f"{c}_prior_z" for c in names])
    if fixed:
        out = out.withColumn("event_threshold", lookup(REGIME_EVENT, F.col("regime_label"), 0.60))
    else:
        out = causal_threshold(out, "event_score", rate, n, least, floor, order=["bar_ts"], check=False)
    out = out.withColumn("event_threshold", clip(F.col("event_threshold") * scale + shift, floor, 0.95))
    return out.withColumn("is_event", (F.col("event_score") >= F.col("event_threshold")).cast("int"))


def rate_mask(rows: DataFrame, score: str, base: Column, rate: float, floor: float = 0.0, **frame) -> DataFrame:
    """Base rows whose score reaches the causal threshold."""
    out = causal_threshold(rows, score, rate, floor=floor, **frame)
    return out.withColumn("kept", F.coalesce(base & (F.col(score) >= F.col("event_threshold")), F.lit(False)))


def _conditions(rows: DataFrame, n: int, past: int) -> DataFrame:
    """Volume over its recent mean, imbalance, strongest wall and largest shift z-score.

    ``past`` rows beside the current one make the frame, which is how the online rule counts too.
    """

    def stats(df, w):
        f = w.rowsBetween(-past, 0)
        std = {c: F.stddev_pop(c).over(f) for c in SHIFTS}
        z = [F.when((F.count(c).over(f) > 1) & (std[c] > 1e-9), F.abs(F.col(c) - F.avg(c).over(f)) / std[c]).otherwise(0.0) for c in SHIFTS]
        mean = F.avg("size").over(f)
        volume = F.when(mean > 0, F.col("size") / F.greatest(mean, F.lit(1e-9))).otherwise((F.col("size") > 0).cast("double"))
        return df.withColumns({"_volume": volume, "_shift": F.greatest(*z)})

    return windowed(rows, stats, before=n)


def event_score(rows: DataFrame, frame: int = 50, volume_mult: float = 1.10, obi_limit: float = 0.08, wall_limit: float = 0.70, shift_limit: float = 0.75, score_limit: float = 0.0) -> DataFrame:
    """Score and verdict of the online event rule, as windows."""
    out = _conditions(rows, frame, frame)
    parts = [F.col("_volume") / volume_mult, F.abs("obi") / obi_limit, F.col("wall") / wall_limit, F.col("_shift") / shift_limit]
    hits, score = F.lit(0), F.lit(0.0)
    for weight, p in zip((0.30, 0.30, 0.20, 0.20), parts):
        hits, score = hits + F.when(p > 1, 1).otherwise(0), score + weight * F.greatest(p - 1, F.lit(0.0))
    score = score + 0.50 * F.greatest(hits - 1, F.lit(0))
    out = out.withColumns({"event_score": score, "triggers": hits})
    return out.withColumn("passed", (F.col("triggers") > 0) & (F.col("event_score") >= score_limit)).drop("_volume", "_shift")


def broad_filter(rows: DataFrame, n: int = 50, volume_mult: float = 1.10, obi_limit: float = 0.08, wall_limit: float = 0.70, shift_limit: float = 0.75) -> DataFrame:
    """Rows with unusual volume, imbalance, wall or shift; any one is enough."""

    def stats(df, w):
        f, z = w.rowsBetween(-(n - 1), 0), []
        for c in SHIFTS:
            std = F.stddev_samp(c).over(f)
            z.append(F.coalesce(F.abs(F.col(c) - F.avg(c).over(f)) / F.when(std == 0, 1e-9).otherwise(std), F.lit(0.0)))
        return df.withColumns({"_mean": F.avg("size").over(f), "_shift": F.greatest(*z)})

    out = windowed(rows, stats, before=n)
    flags = {
        "cond_vol": F.col("size") > F.col("_mean") * volume_mult,
        "cond_obi": F.abs("obi") > obi_limit,
        "cond_wall": F.greatest("bid_wall_strength", "ask_wall_strength") > wall_limit,
        "cond_shift": F.col("_shift") > shift_limit,
    }
    out = out.withColumns({n_: c.cast("int") for n_, c in flags.items()})
    return out.withColumn("event_flag", F.greatest(*flags)).drop("_mean", "_shift")


def training_gate(rows: DataFrame, n: int = 50, rate: float = 0.25, volume_mult: float = 1.10, obi_limit: float = 0.08, wall_limit: float = 0.70, shift_limit: float = 0.75) -> DataFrame:
    """A stricter gate over the broad filter's rows, kept near a target rate by past scores only."""
    out = broad_filter(rows, n, volume_mult, obi_limit, wall_limit, shift_limit)

    def more(df, w):
        f, z = w.rowsBetween(-(n - 1), 0), []
        for c in SHIFTS:
            std = F.stddev_samp(c).over(f)
            z.append(F.coalesce(F.abs(F.col(c) - F.avg(c).over(f)) / F.when(std == 0, 1e-9).otherwise(std), F.lit(0.0)))
        return df.withColumns({"_ratio": ratio(F.col("size").cast("double"), F.greatest(F.avg("size").over(f), F.lit(1e-9))), "_shift": F.greatest(*z)})

    out = windowed(out, more, before=n)
    wall = F.greatest("bid_wall_strength", "ask_wall_strength")
    over = lambda c, limit: F.greatest(c / max(limit, 1e-6) - 1, F.lit(0.0))
    count = F.col("cond_vol") + F.col("cond_obi") + F.col("cond_wall") + F.col("cond_shift")
    score = 0.30 * over(F.col("_ratio"), volume_mult) + 0.30 * over(F.abs("obi"), obi_limit) + 0.20 * over(wall, wall_limit) + 0.20 * over(F.col("_shift"), shift_limit)
    out = out.withColumns({"score": score + 0.50 * F.greatest(count - 1, F.lit(0)), "is_candidate": F.col("event_flag") == 1}).drop("_ratio", "_shift")
    return rate_gate(out, rate, max(n, 10))


def rate_gate(rows: DataFrame, rate: float, warmup: int) -> DataFrame:
    """Keep candidates whose score reaches the quantile, of earlier candidates' scores, that holds the target rate.

    The quantile's level follows from how many candidates came before. A group that fits one task
    keeps its scores sorted there; a larger one asks for order statistics of its past.
    """
    if fits(rows, KEYS):
        return fold(rows, RateGate(rate=rate, warmup=warmup))
    score = F.when(F.col("is_candidate"), F.col("score"))
    out = numbered(rows, "_seen").withColumn("_score", score)
    out = running(out, {"_past": ("count", "_score")}, exclusive=True)
    share = F.col("_past") / F.greatest("_seen", F.lit(1))
    keep = clip(F.least(F.lit(max(rate, 0.05)), share) / F.greatest(share, F.lit(1e-9)), 0, 1)
    out = out.withColumn("_q", F.when(keep >= 0.999, 0.0).otherwise(1 - keep))
    out = prefix_quantile(out, "_score", "_limit", F.col("_q"), max(warmup, 1), exclusive=True)
    limit = F.when(F.col("is_candidate"), F.greatest(F.coalesce("_limit", F.lit(0.0)), F.lit(0.0)))
    out = out.withColumn("gate_threshold", limit)
    out = out.withColumn("gate", F.coalesce(F.col("is_candidate") & (F.col("score") >= F.col("gate_threshold")), F.lit(False)))
    return out.drop("_seen", "_score", "_past", "_q", "_limit")
