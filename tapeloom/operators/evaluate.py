"""Scores of predictions, trades and features.

Rank statistics are computed from counts per distinct value, so rows never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.market import LONG, NEUTRAL, SHORT, clip
from tapeloom.operators.ordered import beside, exact_quantiles, running, windowed


def one(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def mean_of(c: Column) -> Column:
    return F.avg(c.cast("double"))


# ------------------------------------------------------------------------------------ labels


def label_distribution(df: DataFrame) -> DataFrame:
    """Label counts, shares and warnings for the whole table (month null) and for each month."""
    rows = df.withColumn("month", F.date_format("ts_event", "yyyy-MM"))
    out = rows.groupingSets([[], [F.col("month")]], F.col("month")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[one(F.col("bias_label") == v).alias(n) for n, v in (("long", LONG), ("short", SHORT), ("neutral", NEUTRAL))],
        one(F.col("train_event_flag") == 1).alias("event_rows"),
    )
    small, large = F.least("long", "short"), F.greatest("long", "short")
    imbalance = F.when(small > 0, large / small)
    warnings = F.concat_ws(
        ",",
        F.when(F.col("long") + F.col("short") == 0, "no_directional_labels"),
        F.when(small == 0, "single_sided_or_collapsed_directional_labels"),
        F.when(F.col("neutral") / F.col("rows") > 0.98, "neutral_share_above_98pct"),
        F.when(imbalance > 20, "long_short_imbalance_gt_20x"),
    )
    return out.withColumns({"directional_share": (F.col("long") + F.col("short")) / F.col("rows"), "long_short_imbalance": imbalance, "warnings": warnings})


def label_quality(df: DataFrame) -> DataFrame:
    """Outcomes, reasons, horizons and overlap of labels by month."""
    rows = df.withColumn("month", F.date_format("ts_event", "yyyy-MM"))
    directional = F.col("bias_label") != NEUTRAL
    stats = rows.groupBy("month").agg(
        F.count(F.lit(1)).alias("rows"),
        *[one(F.col("path_outcome") == v).alias(n) for v, n in enumerate(("long_tp_first", "short_tp_first", "long_sl_first", "short_sl_first", "timeout"))],
        *[one(F.col("neutral_reason") == v).alias(f"reason_{n}") for v, n in enumerate(("none", "timeout", "long_sl", "short_sl"))],
        F.coalesce(F.avg(F.when(directional, (F.col("label_horizon_steps") > 1).cast("double"))), F.lit(0.0)).alias("directional_overlap_rate"),
        one(directional).alias("directional_rows"),
        F.coalesce(F.avg(F.when(directional, (F.col("bias_label") == LONG).cast("double"))), F.lit(0.0)).alias("long_share"),
        mean_of(F.col("adverse_path_flag")).alias("adverse_path_share"),
    )
    q = exact_quantiles(rows, {"_q": "label_horizon_steps"}, [0.5, 0.95], keys=["month"])
    return stats.join(q, "month").withColumns({"horizon_median": F.get("_q", 0), "horizon_p95": F.get("_q", 1)}).drop("_q")


def slice_stats(df: DataFrame, columns: Sequence[str] = ("label_horizon_steps", "realized_return")) -> DataFrame:
    """Label counts and percentiles over all rows, directional ones, neutral ones and training events."""
    directional = F.col("bias_label") != NEUTRAL
    names = F.array_compact(F.array(F.lit("all_rows"), F.when(directional, "directional_all").otherwise("neutral"), F.when(directional & (F.col("train_event_flag") == 1), "event_binary")))
    rows = df.withColumn("slice", F.explode(names))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    stats = rows.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"), *[one(F.col("bias_label") == v).alias(n) for n, v in (("long", LONG), ("short", SHORT), ("neutral", NEUTRAL))])
    stats = stats.transform(beside, total).withColumn("row_share", F.col("rows") / F.col("_all")).drop("_all")  # one row
    q = exact_quantiles(rows, {f"_{c}": c for c in columns}, [0.5, 0.95], keys=["slice"])
    out = stats.join(q, "slice")
    return out.withColumns({f"{c}_{p}": F.get(f"_{c}", i) for c in columns for i, p in enumerate(("p50", "p95"))}).drop(*[f"_{c}" for c in columns])


def dominant_label(counts: Sequence[Column], share: float = 0.35) -> Column:
    """Commonest of three labels, directional ones preferred to neutral from ``share`` on; neutral below it."""
    long, short, neutral = counts
    total = long + short + neutral
    way, top = F.when(long >= short, LONG).otherwise(SHORT), F.greatest(long, short)
    return F.when((total > 0) & (top >= total * share), way).otherwise(NEUTRAL)


def labelled_bars(rows: DataFrame, freq: str) -> DataFrame:
    """Price bars with the dominant label, best quality and commonest regime of their rows."""
    from tapeloom.operators.bars import price_bars

    counts = {f"bias_{v}": one(F.col("bias_label") == v) for v in (0, 1, 2)}
    regimes = {f"regime_{v}": one(F.col("regime") == v) for v in range(4)}
    bars = price_bars(rows, freq, extra={**counts, **regimes, "quality": F.max("signal_quality")})
    best = F.greatest(*[F.col(f"regime_{v}") for v in range(4)])
    regime = F.lit(1)
    for v in reversed(range(4)):
        regime = F.when((best > 0) & (F.col(f"regime_{v}") == best), v).otherwise(regime)
    return bars.withColumns({"bias_label": dominant_label([F.col(f"bias_{v}") for v in (0, 1, 2)]), "regime": regime}).drop(*[f"regime_{v}" for v in range(4)])


def signal_strength() -> Column:
    top = F.greatest("prob_long", "prob_short")
    return top + 0.35 * F.abs(F.col("prob_long") - F.col("prob_short"))


def representative_rows(rows: DataFrame, freq: str, columns: Sequence[str]) -> DataFrame:
    """The strongest prediction of each bar, then the most confident, then the first."""
    from tapeloom.operators.bars import with_bar

    rows = with_bar(rows, freq).withColumns({"signal_strength": signal_strength(), "confidence": F.greatest("prob_long", "prob_short")})
    early = (-F.unix_micros(F.col("ts_event").cast("timestamp"))).alias("t"), (-F.col("sequence")).alias("q")
    best = F.max_by(F.struct(*columns, "signal_strength", "confidence"), F.struct("signal_strength", "confidence", *early))
    return rows.groupBy("symbol", "bar_ts").agg(best.alias("r")).select("symbol", "bar_ts", "r.*")


def prediction_bars(rows: DataFrame, freq: str) -> DataFrame:
    """Price bars with mean and strongest probabilities, CVD change, commonest regime and direction."""
    from tapeloom.operators.bars import at_first, at_last, price_bars

    extra = {
        "cvd": at_last("cvd"),
        "cvd_delta": at_last("cvd") - at_first("cvd"),
        "prob_long_mean": F.avg("prob_long"),
        "prob_short_mean": F.avg("prob_short"),
        "regime": F.mode("regime", deterministic=True),
    }
    bars = price_bars(rows, freq, count="event_count", extra=extra)
    best = representative_rows(rows, freq, ["prob_long", "prob_short"]).select("symbol", "bar_ts", "prob_long", "prob_short", "confidence")
    bars = bars.join(best, ["symbol", "bar_ts"])
    way = F.when(F.col("prob_long") >= F.col("prob_short"), LONG).otherwise(SHORT)
    bars = bars.withColumn("direction", way)
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    return bars.withColumn("changed", F.coalesce((F.col("direction") != F.lag("direction").over(w)).cast("int"), F.lit(1)))


# -------------------------------------------------------------------------------- predictions


def bin_of(p: Column, bins: int = 10) -> Column:
    out = F.lit(0)
    for i in range(1, bins):
        out = out + F.when(p >= i * (1.0 / bins), 1).otherwise(0)
    return out


def calibration_error(df: DataFrame, prob: str = "prob_long", bins: int = 10) -> DataFrame:
    """One row: gap between mean probability and share of longs, weighted over equal bins."""
    rows = df.filter(F.col("bias_label") != NEUTRAL)
    cells = rows.groupBy(bin_of(F.col(prob), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("conf"), mean_of(F.col("bias_label") == LONG).alias("acc"))
    return cells.agg(F.sum("n").alias("rows"), (F.sum(F.abs(F.col("conf") - F.col("acc")) * F.col("n")) / F.sum("n")).alias("ece"))


def probability_scores(df: DataFrame, probs: dict[str, str]) -> DataFrame:
    """One row: Brier score and log loss of each probability column over directional rows."""
    y = (F.col("bias_label") == LONG).cast("double")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for name, column in probs.items():
        p = clip(F.col(column), 1e-6, 1 - 1e-6)
        aggs += [F.avg(F.pow(p - y, 2)).alias(f"{name}_brier"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias(f"{name}_nll")]
    return df.filter(F.col("bias_label") != NEUTRAL).agg(*aggs)


def class_table(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support of longs and shorts."""
    parts = []
    for label, name in ((LONG, "LONG"), (SHORT, "SHORT")):
        t, g = F.col(truth) == label, F.col(guess) == label
        parts.append(F.struct(F.lit(name).alias("label"), one(t & g).alias("tp"), one(g).alias("predicted"), one(t).alias("support")))
    rows = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("r")).select("r.*")
    zero = F.lit(0.0)
    rows = rows.withColumns({"precision": F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), zero), "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("support")), zero)})
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), zero)).drop("tp", "predicted")


def macro_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return class_table(df, truth, guess).agg(*[F.avg(c).alias(f"directional_{c}_macro") for c in ("precision", "recall", "f1")])


def value_counts(df: DataFrame, value: str, positive: Column, keys: Sequence[str]) -> DataFrame:
    """Positive and negative rows per distinct value, with the negatives and rows below it."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(one(positive).alias("_p"), one(~positive).alias("_q"))
    counts = counts.withColumn("_n", F.col("_p") + F.col("_q"))
    return running(counts, {"_below_q": ("sum", "_q"), "_below_n": ("sum", "_n")}, keys=keys, order=["_v"], exclusive=True)


def auc(df: DataFrame, value: str, positive: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive row has the higher value, ties counting half; null with one class."""
    c = value_counts(df, value, positive, keys)
    wins = F.sum(F.col("_p") * (F.coalesce("_below_q", F.lit(0)) + F.col("_q") * 0.5))
    return c.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.try_divide(wins, (F.sum("_p") * F.sum("_q")).cast("double")).alias("auc"))


def binary_ranks(df: DataFrame, value: str, positive: Column, keys: Sequence[str] = ()) -> DataFrame:
    """AUC and rank correlation with a yes/no target, both from counts per distinct value."""
    c = value_counts(df, value, positive, keys)
    below = F.coalesce("_below_n", F.lit(0))
    c = c.withColumn("_r", below + (F.col("_n") + 1) / 2.0)
    s = c.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.sum("_p").alias("_P"), F.sum("_q").alias("_Q"), F.sum(F.col("_p") * (F.coalesce("_below_q", F.lit(0)) + F.col("_q") * 0.5)).alias("_wins"),
        F.sum(F.col("_n") * F.col("_r")).alias("_s"), F.sum(F.col("_n") * F.col("_r") * F.col("_r")).alias("_ss"), F.sum(F.col("_p") * F.col("_r")).alias("_sp"),
    )
    n, share = F.col("rows"), F.col("_P") / F.col("rows")
    mean = F.col("_s") / n
    spread = (F.col("_ss") / n - mean * mean) * share * (1 - share)
    rho = F.when(spread > 1e-12, (F.col("_sp") / n - mean * share) / F.sqrt(spread))
    return s.select(*keys, "rows", F.try_divide(F.col("_wins"), (F.col("_P") * F.col("_Q")).cast("double")).alias("auc"), rho.alias("rho"))


def average_ranks(df: DataFrame, column: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: its average rank."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.sum("_w").alias("_n"))
    counts = running(counts, {"_to": ("sum", "_n")}, keys=keys, order=[column])
    return counts.select(*keys, column, (F.col("_to") - (F.col("_n") - 1) / 2.0).alias(name))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation from counts of distinct (x, y) pairs."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w"))
    pairs = pairs.join(average_ranks(pairs, "_x", "_rx", keys), [*keys, "_x"]).join(average_ranks(pairs, "_y", "_ry", keys), [*keys, "_y"])
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = pairs.groupBy(*keys).agg(F.sum(w).alias("rows"), *[F.sum(w * c).alias(n) for n, c in (("_a", a), ("_b", b), ("_ab", a * b), ("_aa", a * a), ("_bb", b * b))])
    n = F.col("rows")
    cov = F.col("_ab") / n - F.col("_a") / n * F.col("_b") / n
    va, vb = F.col("_aa") / n - F.pow(F.col("_a") / n, 2), F.col("_bb") / n - F.pow(F.col("_b") / n, 2)
    rho = F.when((va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb))
    return sums.select(*keys, "rows", rho.alias("rho"))


def long_form(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, feature), made by one explode."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*")


def feature_fold_metrics(split: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per fold and feature: AUC and rank correlation on the test rows, and the AUC when the sign comes from training.

    Flipping a feature's sign turns an AUC into one less it, so the training AUC only picks the side.
    """
    rows = long_form(split.filter(F.col("bias_label") != NEUTRAL), features, ["fold", "role", "bias_label"])
    keys = ["fold", "feature"]
    both = binary_ranks(rows, "value", F.col("bias_label") == LONG, [*keys, "role"])
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    out = both.groupBy(*keys).agg(
        pick("test", "auc").alias("auc_long"), pick("test", "rows").alias("test_rows"), pick("train", "auc").alias("train_auc_long"), pick("train", "rows").alias("train_rows"), pick("test", "rho").alias("ic")
    )
    signed = F.when(F.col("train_auc_long") >= 0.5, F.col("auc_long")).when(F.col("train_auc_long").isNotNull(), 1 - F.col("auc_long"))
    return out.withColumns({"auc_edge": F.greatest("auc_long", 1 - F.col("auc_long")), "train_signed_auc": signed, "signal_side": F.when(F.col("auc_long") >= 0.5, "long").otherwise("short")})


def feature_summary(metrics: DataFrame) -> DataFrame:
    """Means over folds and how steady a feature's side is."""
    side = F.greatest(one(F.col("signal_side") == "long"), one(F.col("signal_side") == "short"))
    return metrics.groupBy("feature").agg(
        F.count(F.lit(1)).alias("valid_folds"),
        F.avg("train_signed_auc").alias("train_signed_auc_mean"),
        F.min("train_signed_auc").alias("train_signed_auc_min"),
        F.avg("auc_edge").alias("auc_edge_mean"),
        F.avg(F.abs("ic")).alias("abs_ic_mean"),
        (side / F.count(F.lit(1))).alias("side_stability"),
    )


def risk_flags(slices: DataFrame, summary: DataFrame, least_events: int = 10_000) -> DataFrame:
    """Flags raised by label slices and feature summaries, one row each."""
    small = slices.filter((F.col("slice") == "event_binary") & (F.col("rows") < least_events)).select(F.lit("small_training_pool").alias("flag"))
    wide = slices.filter((F.col("slice") == "directional_all") & (F.col("row_share") > 0.25)).select(F.lit("directional_share_high").alias("flag"))
    best = summary.agg(F.max("auc_edge_mean").alias("_a"), F.max("train_signed_auc_mean").alias("_t"))
    named = [("no_stable_auc_edge", F.col("_a") < 0.53), ("no_train_signed_auc", F.col("_t") < 0.53), ("direction_does_not_transfer", (F.col("_a") >= 0.56) & (F.col("_t") < 0.53))]
    auc_flags = best.select(F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in named]))).alias("flag"))
    flips = summary.agg(F.min("side_stability").alias("_s")).filter("_s < 0.67").select(F.lit("signal_side_flips").alias("flag"))
    return reduce(DataFrame.unionByName, [small, wide, auc_flags, flips])


def spearman_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair of features over the rows that have both.

    Features without nulls are ranked once and then summed in one pass; pairs with a feature that has
    nulls are ranked on their common rows.
    """
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    nulls = rows.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    whole = [f for f in features if not nulls[f]]
    ranked = rows.select(*whole)
    for f in whole:
        counts = rows.groupBy(f).agg(F.count(F.lit(1)).alias("_n"))
        counts = running(counts, {"_to": ("sum", "_n")}, keys=(), order=[f])
        ranked = ranked.join(counts.select(f, (F.col("_to") - (F.col("_n") - 1) / 2.0).alias(f"_r_{f}")), f)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    parts = [spearman(rows, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs("rho").alias("rho")) for a, b in pairs if nulls[a] or nulls[b]]
    if whole:
        full = [(a, b) for a, b in pairs if not nulls[a] and not nulls[b]]
        sums = ranked.agg(*[F.corr(f"_r_{a}", f"_r_{b}").alias(f"{a}|{b}") for a, b in full])
        cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(F.col(f"`{a}|{b}`")).alias("rho")) for a, b in full])
        parts.append(sums.select(F.explode(cells).alias("c")).select("c.*"))
    half = reduce(DataFrame.unionByName, parts)
    return half.unionByName(half.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "rho"))


def redundancy_filter(df: DataFrame, features: Sequence[str], target: str, threshold: float = 0.85, protected: Sequence[str] = ()) -> list[str]:
    """Features of which no stronger one that stays is closer than ``threshold``; protected ones stay and go first."""
    close, relevance = closeness(df, features, target)
    first = np.isin(features, list(protected))
    ranked = np.lexsort((np.arange(len(features)), -relevance, ~first))  # ties keep their order
    stays = reduce(lambda on, i: on + [i] if first[i] or not (close[i, on] > threshold).any() else on, ranked.tolist(), [])
    return [features[i] for i in stays]


def closeness(df: DataFrame, features: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    """Rank correlations of the features with each other and with the target; a missing one is 0."""
    cells = spearman_matrix(df, [*features, target]).toPandas()
    square = cells.pivot(index="a", columns="b", values="rho").loc[[*features, target], [*features, target]].fillna(0.0).to_numpy(float)
    return square[:-1, :-1], square[:-1, -1]


def mrmr(df: DataFrame, features: Sequence[str], target: str, k: int, protected: Sequence[str] = ()) -> list[str]:
    """k features: the protected ones, then in turn the one with the most relevance less mean closeness to those before."""
    close, relevance = closeness(df, features, target)
    taken = np.flatnonzero(np.isin(features, list(protected)))[:k]
    free = np.ones(len(features), bool)
    free[taken] = False
    shared = close[:, taken].sum(1)  # closeness to all taken so far
    for n in range(len(taken), min(k, len(features))):
        best = int(np.where(free, relevance - shared / max(n, 1), -np.inf).argmax())
        taken, free[best], shared = np.append(taken, best), False, shared + close[:, best]
    return [features[i] for i in taken]


def feature_verdicts(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """DEAD, STRONG, WEAK or NOISE per feature from deviation, binned mutual information and rank correlation."""
    rows = long_form(df, features, [label]).withColumn("value", F.coalesce("value", F.lit(0.0)))
    stats = rows.groupBy("feature").agg(F.stddev_samp("value").alias("std"), mean_of(F.abs("value") < 1e-12).alias("zero_share"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    binned = rows.join(F.broadcast(stats.select("feature", "_lo", "_hi", "_n")), "feature")  # one row per feature
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    joint = binned.groupBy("feature", b.alias("_b"), label, "_n").agg(F.count(F.lit(1)).alias("_c"))
    wb, wl = Window.partitionBy("feature", "_b"), Window.partitionBy("feature", label)  # at most bins times labels rows
    joint = joint.withColumns({"_cb": F.sum("_c").over(wb), "_cl": F.sum("_c").over(wl)})
    p = F.col("_c") / F.col("_n")
    mi = joint.groupBy("feature").agg(F.sum(p * F.ln(F.col("_c") * F.col("_n") / (F.col("_cb") * F.col("_cl")))).alias("mi"))
    rho = spearman(rows, "value", label, ["feature"]).select("feature", F.coalesce("rho", F.lit(0.0)).alias("rho"))
    out = stats.join(mi, "feature").join(rho, "feature")
    verdict = F.when(F.col("std") <= 1e-12, "DEAD").when(F.col("mi") >= 0.10, "STRONG").when((F.col("mi") >= 0.01) | (F.abs("rho") >= 0.06), "WEAK").otherwise("NOISE")
    return out.select("feature", verdict.alias("verdict"), "mi", "rho", "std", "zero_share")


def monthly_drift(df: DataFrame, features: Sequence[str], split_ts: Column, bucket: str = "yyyy-MM", streak: int = 3) -> DataFrame:
    """Per month and feature: coverage, shift against the training part, and whether it has been dead for some months."""
    rows = long_form(df.withColumns({"month": F.date_format("ts_event", bucket), "_train": F.col("ts_event") < split_ts}), features, ["month", "_train"])
    v = F.coalesce("value", F.lit(0.0))
    ref = rows.filter("_train").groupBy("feature").agg(F.avg(v).alias("_rm"), F.stddev_pop(v).alias("_rs"))
    obs = rows.groupBy("month", "feature").agg(
        mean_of(v != 0).alias("non_zero_rate"), mean_of(F.col("value").isNull()).alias("missing_rate"), F.avg(v).alias("_om"), F.stddev_pop(v).alias("_os")
    )
    out = obs.join(F.broadcast(ref), "feature")  # one row per feature
    rs = F.when(F.abs("_rs") > 1e-8, F.col("_rs")).otherwise(1.0)
    out = out.withColumn("shift_score", F.abs(F.col("_om") - F.col("_rm")) / rs + F.abs(F.col("_os") - rs) / rs)
    w = Window.partitionBy("feature").orderBy("month").rowsBetween(-(streak - 1), 0)  # one row per month
    dead = F.col("non_zero_rate") < 0.01
    return out.withColumn("dead", (F.sum(dead.cast("int")).over(w) >= streak)).select("month", "feature", "non_zero_rate", "missing_rate", "shift_score", "dead")


def fit_scaler(df: DataFrame, features: Sequence[str], min_iqr: float = 1e-3, clip_rate: float | None = None) -> DataFrame:
    """Per feature: robust by median and IQR, or min-max where the IQR is too small or too much is clipped, or zero."""
    rows = long_form(df, features, []).withColumn("value", F.coalesce("value", F.lit(0.0)))
    q = exact_quantiles(rows, {"_q": "value"}, [0.25, 0.5, 0.75], keys=["feature"])
    ends = rows.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    out = q.join(ends, "feature").select("feature", F.get("_q", 1).alias("median"), (F.get("_q", 2) - F.get("_q", 0)).alias("iqr"), "min", "max")
    robust, wide = F.col("iqr") >= min_iqr, F.col("max") - F.col("min") > 1e-8
    if clip_rate is None:
        out = out.withColumn("clip_rate", F.lit(0.0))
    else:
        scaled = rows.join(F.broadcast(out), "feature")  # one row per feature
        far = F.abs((F.col("value") - F.col("median")) / F.greatest("iqr", F.lit(min_iqr))) >= 9.5
        out = out.join(scaled.groupBy("feature").agg(mean_of(far).alias("clip_rate")), "feature")
        robust = robust & ~((F.col("clip_rate") > clip_rate) & wide)
    return out.withColumn("kind", F.when(robust, "robust").when(wide, "minmax").otherwise("zero"))


def apply_scaler(df: DataFrame, params: DataFrame, features: Sequence[str], min_iqr: float = 1e-3, bound: float = 10.0, passthrough: Sequence[str] = ()) -> DataFrame:
    """Scale features by the fitted parameters, which travel as one row of structs."""
    packed = params.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("kind", "median", "iqr", "min", "max")))).alias("_p"))  # one row per feature
    out = df.transform(beside, packed)
    for f in features:
        p, v = F.try_element_at("_p", F.lit(f)), F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        robust = (v - p["median"]) / F.greatest(p["iqr"], F.lit(min_iqr))
        minmax = (v - p["min"]) / F.greatest(p["max"] - p["min"], F.lit(1e-8)) * 2 - 1
        scaled = F.when(p["kind"] == "robust", robust).when(p["kind"] == "minmax", minmax)
        out = out.withColumn(f, v if f in passthrough else F.when(scaled.isNotNull(), clip(scaled, -bound, bound)).otherwise(0.0))
    return out.drop("_p")


def scaler_baseline(params: DataFrame) -> DataFrame:
    """Mean and deviation that a feature should show, from its scaler."""
    k = F.col("kind")
    mean = F.when(k == "robust", F.col("median")).when(k == "minmax", (F.col("min") + F.col("max")) / 2).otherwise(0.0)
    std = F.when(k == "robust", F.col("iqr")).when(k == "minmax", F.greatest((F.col("max") - F.col("min")) / 2, F.lit(1e-8))).otherwise(1.0)
    return params.select("feature", mean.alias("mean"), std.alias("std"))


def hit_rates(bars: DataFrame, k: int, direction: str = "direction") -> DataFrame:
    """How often the close k bars later went the way of the direction."""
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    rows = bars.withColumn("_move", F.lead("close", k).over(w) - F.col("close"))
    known, long, short = F.col("_move").isNotNull(), F.col(direction) == LONG, F.col(direction) == SHORT
    rate = lambda hit, base: F.coalesce(F.try_divide(one(hit & base & known), one(base & known)), F.lit(0.0)) * 100
    return rows.agg(F.count(F.lit(1)).alias("total"), one(long).alias("n_long"), one(short).alias("n_short"), rate(F.col("_move") > 0, long).alias("long_hit_rate"), rate(F.col("_move") < 0, short).alias("short_hit_rate"))


def return_distribution(bars: DataFrame, k: int, direction: str = "direction") -> DataFrame:
    """Returns k bars ahead by direction and whether it was right."""
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    rows = bars.withColumn("_ret", F.lead("close", k).over(w) / F.col("close") - 1).filter("_ret is not null")
    right = F.when(F.col(direction) == LONG, F.col("_ret") > 0).otherwise(F.col("_ret") < 0)
    rows = rows.withColumn("correct", right)
    stats = rows.groupBy(direction, "correct").agg(F.count(F.lit(1)).alias("rows"), F.avg("_ret").alias("mean_return"))
    q = exact_quantiles(rows, {"_q": "_ret"}, [0.5], keys=[direction, "correct"])
    return stats.join(q, [direction, "correct"]).withColumn("median_return", F.get("_q", 0)).drop("_q")


def hourly_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, macro F1 and long rates by hour."""
    t, g = F.col(truth), F.col(guess)
    f1 = []
    for v in (LONG, SHORT):
        tp, predicted, actual = one((t == v) & (g == v)), one(g == v), one(t == v)
        f1.append((F.coalesce(F.try_divide(2.0 * tp, predicted + actual), F.lit(0.0)), F.when(predicted + actual > 0, 1).otherwise(0)))
    macro = (f1[0][0] + f1[1][0]) / (f1[0][1] + f1[1][1])
    return df.groupBy(F.hour("ts_event").alias("hour_utc")).agg(F.count(F.lit(1)).alias("rows"), mean_of(t == g).alias("accuracy"), macro.alias("macro_f1"), mean_of(t == LONG).alias("long_rate_true"), mean_of(g == LONG).alias("long_rate_pred"))


def threshold_sweep(df: DataFrame, prob: str = "prob_long") -> DataFrame:
    """Macro F1 at 41 thresholds from 0.30 to 0.70, the best marked.

    Rows become counts per (probability, label) first; the thresholds only meet those.
    """
    counts = df.filter(F.col("bias_label") != NEUTRAL).groupBy(F.col(prob).alias("_p"), (F.col("bias_label") == LONG).alias("_long")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = F.array(*[F.lit(round(0.30 + 0.01 * i, 2)) for i in range(41)])
    rows = counts.withColumn("threshold", F.explode(cuts)).withColumn("_guess", F.col("_p") >= F.col("threshold"))
    s = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    f1 = lambda t, g: F.coalesce(F.try_divide(2.0 * s(t & g), s(t) + s(g)), F.lit(0.0))
    t, g = F.col("_long"), F.col("_guess")
    out = rows.groupBy("threshold").agg(((f1(t, g) + f1(~t, ~g)) / 2).alias("macro_f1"), (s(t == g) / F.sum("_n")).alias("accuracy"))
    best = out.agg(F.max_by("threshold", F.struct("macro_f1", -F.col("threshold"))).alias("_best"))
    return out.transform(beside, best).withColumn("best", F.col("threshold") == F.col("_best")).drop("_best")  # one row


def overfit_probability(df: DataFrame, train: str, test: str) -> DataFrame:
    """One row: 1 when the best training score ranks below the middle of the test scores, else 0; 0.5 under 3 rows."""
    best = df.agg(F.max_by(test, F.struct(F.col(train), -F.col("trial"))).alias("_best"), F.count(F.lit(1)).alias("_n"))
    rows = df.transform(beside, best)  # one row
    rank = F.sum(F.when(F.col(test) < F.col("_best"), 1.0).when(F.col(test) == F.col("_best"), 0.5).otherwise(0.0)) + 0.5
    out = rows.agg(rank.alias("_rank"), F.first("_n").alias("trials"))
    omega = F.col("_rank") / (F.col("trials") + 1)
    return out.select("trials", F.when(F.col("trials") < 3, 0.5).when(omega < 0.5, 1.0).otherwise(0.0).alias("pbo"))


# ------------------------------------------------------------------------------------ trades


def equity_curve(trades: DataFrame, start: float = 0.0, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("entry_ts", "trade_seq")) -> DataFrame:
    """Equity after each trade, its peak so far and the drawdown from it."""
    out = running(trades, {"_sum": ("sum", "pnl")}, keys=keys, order=order).withColumn("equity", F.col("_sum") + start).drop("_sum")
    out = running(out, {"peak": ("max", "equity")}, keys=keys, order=order)
    return out.withColumn("drawdown", F.col("peak") - F.col("equity"))


def equity_metrics(trades: DataFrame, start: float = 0.0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Deepest drawdown in money and share of the peak, and Sharpe ratio over trades."""
    n, std = F.count(F.lit(1)), F.stddev_pop("pnl")
    sharpe = F.when((n >= 2) & (std > 1e-12), F.avg("pnl") / std * F.sqrt(n)).otherwise(0.0)
    return equity_curve(trades, start, keys).groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"), F.max(F.col("drawdown") / F.greatest("peak", F.lit(1e-8))).alias("max_drawdown_share"), sharpe.alias("trade_sharpe"))


def trade_summary(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, win rate, profit factor, expectancy and totals."""
    win, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        mean_of(F.col("pnl") > 0).alias("win_rate"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("expectancy"),
        F.when(loss > 1e-9, win / loss).otherwise(0.0).alias("profit_factor"),
    )


def fold_metrics(folds: DataFrame) -> DataFrame:
    """Means, extremes and totals of per-fold results."""
    return folds.agg(
        F.count(F.lit(1)).alias("n_folds"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("win_rate", "profit_factor", "expectancy")],
        F.max("max_drawdown_share").alias("max_drawdown_share"),
        F.sum("trades").alias("total_trades"),
        F.sum("total_pnl").alias("total_pnl"),
    )


def percentile_table(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """10th to 90th percentiles per group."""
    q = exact_quantiles(df, {"_q": column}, [0.10, 0.25, 0.50, 0.75, 0.90], keys=keys)
    return q.select(*keys, *[F.get("_q", i).alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))])


def forward_returns(bars: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Returns over several horizons, one row per bar and horizon."""
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    out = bars.withColumns({f"_r{h}": F.lead("close", h).over(w) / F.col("close") - 1 for h in horizons})
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_r{h}").alias("forward_return")) for h in horizons])
    return out.select("symbol", "bar_ts", F.explode(cells).alias("c")).select("symbol", "bar_ts", "c.*").filter("forward_return is not null")


def half_life(bars: DataFrame, features: Sequence[str], max_lag: int = 15) -> DataFrame:
    """Per feature: first lag whose rank correlation with now is at most a half."""
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    cells = [F.struct(F.lit(f).alias("feature"), F.lit(k).alias("lag"), F.col(f).cast("double").alias("now"), F.lag(f, k).over(w).cast("double").alias("then")) for f in features for k in range(1, max_lag + 1)]
    rows = bars.withColumn("_c", F.array(*cells)).select(F.explode("_c").alias("c")).select("c.*").filter("then is not null")
    rho = spearman(rows, "now", "then", ["feature", "lag"])
    low = F.col("rho").isNull() | (F.abs("rho") <= 0.5)
    return rho.groupBy("feature").agg(F.coalesce(F.min(F.when(low, F.col("lag"))), F.lit(max_lag + 1)).alias("half_life"))
