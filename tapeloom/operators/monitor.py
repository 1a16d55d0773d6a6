"""Monitoring of predictions and feature drift, alerts and release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.market import LONG, NEUTRAL
from tapeloom.operators.evaluate import mean_of, one
from tapeloom.operators.ordered import beside, exact_quantiles

# Limits above which a metric raises an alert.
ALERT_RULES = [
    ("feature_missing", "missing_ratio_events", 0.05),
    ("latency_alert", "latency_p95", 500.0),
    ("confidence_drift", "confidence_mean_delta", 0.15),
    ("fallback_frequency_alert", "fallback_frequency", 0.10),
    ("execution_reject_alert", "reject_ratio", 0.15),
    ("data_gap_detected", "data_gap_events", 0.0),
    ("event_gate_shift_alert", "event_gate_rate_delta", 0.30),
    ("shadow_brier_alert", "brier_score_delta", 0.20),
    ("shadow_win_rate_alert", "win_rate_drop", 0.10),
]
SHIFT_WARN, SHIFT_CRITICAL = 0.25, 0.35
# Acceptance gates (metric, rule, limit).
RELEASE_GATES = [
    ("n_folds", "min", 3.0),
    ("trades", "min", 30.0),
    ("directional_f1", "min", 0.35),
    ("directional_precision", "min", 0.35),
    ("directional_recall", "min", 0.25),
    ("profit_factor", "min", 1.05),
    ("expectancy", "min", 0.0),
    ("ece", "max", 0.12),
    ("max_drawdown_share", "max", 0.05),
]

PREDICTIONS = ["prediction_emitted", "prediction_blocked"]
BLOCKS = ["prediction_blocked", "risk_blocked", "rollout_guard_triggered"]
FALLBACKS = ["visual_branch_unavailable", "regime_fallback_used"]


def shift_score(ref_mean: Column, ref_std: Column, mean: Column, std: Column) -> Column:
    """Change of mean and deviation in units of the reference deviation."""
    base = F.greatest(F.abs(ref_std), F.lit(1e-8))
    return F.abs(mean - ref_mean) / base + F.abs(F.greatest(F.abs(std), F.lit(1e-8)) - base) / base


def feature_drift(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """Shift of every feature in the map column stat_features against (feature, mean, std)."""
    rows = events.select(F.explode("stat_features").alias("feature", "value"))
    now = rows.groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("observed_mean"), F.stddev_pop("value").alias("observed_std"))
    base = baseline.select("feature", F.col("mean").alias("_m"), F.col("std").alias("_s"))
    out = now.join(base, "feature", "left")  # one row per feature on both sides
    score = shift_score(F.coalesce("_m", F.lit(0.0)), F.coalesce("_s", F.lit(1.0)), F.col("observed_mean"), F.col("observed_std"))
    level = F.when(F.col("shift_score") > SHIFT_CRITICAL, "critical").when(F.col("shift_score") > SHIFT_WARN, "warning").otherwise("ok")
    return out.withColumn("shift_score", score).withColumn("level", level).drop("_m", "_s")


def _summary(events: DataFrame, keys: list[str]) -> list[Column]:
    kind = F.col("event_type")
    made, emitted = kind.isin(PREDICTIONS), kind == "prediction_emitted"
    fills, rejects = one(kind == "order_filled"), one(kind == "order_rejected")
    outcome = (kind == "shadow_outcome_realized") & (F.col("true_bias") != NEUTRAL)
    miss = F.pow(F.col("prob_long") - (F.col("true_bias") == LONG).cast("double"), 2)
    at_least_one = lambda c: F.greatest(c, F.lit(1))
    return [
        F.count(F.lit(1)).alias("events"),
        one(made).alias("predictions"),
        one(emitted).alias("prediction_emitted"),
        one(kind.isin(BLOCKS)).alias("blocked"),
        fills.alias("fills"),
        rejects.alias("rejects"),
        one(kind == "data_gap_detected").alias("data_gap_events"),
        F.coalesce(F.avg(F.when(made, (F.col("missing_features") > 0).cast("double"))), F.lit(0.0)).alias("missing_ratio_events"),
        (fills / at_least_one(fills + rejects)).alias("fill_ratio"),
        (rejects / at_least_one(fills + rejects)).alias("reject_ratio"),
        (one(kind.isin(BLOCKS)) / at_least_one(one(made))).alias("blocked_frequency"),
        (one(kind.isin(FALLBACKS)) / F.count(F.lit(1))).alias("fallback_frequency"),
        F.coalesce(F.avg(F.when(emitted, F.col("confidence"))), F.lit(0.0)).alias("confidence_mean"),
        F.coalesce(F.avg(F.when(made, F.col("event_gate_passed").cast("double"))), F.lit(0.0)).alias("event_gate_rate"),
        F.coalesce(F.avg(F.when(outcome, miss)), F.lit(0.0)).alias("brier_score"),
        F.coalesce(F.avg(F.when(kind == "shadow_outcome_realized", F.col("correct").cast("double"))), F.lit(0.0)).alias("win_rate"),
    ]


def summarise(events: DataFrame, keys: list[str], base: dict[str, float] | None = None) -> DataFrame:
    """Counts, health ratios, latency percentiles and deltas to a baseline, per group."""
    base = base or {}
    out = events.groupBy(*keys).agg(*_summary(events, keys))
    latency = events.filter(F.col("event_type").isin(PREDICTIONS))
    q = exact_quantiles(latency, {"_q": "latency_ms"}, [0.5, 0.95, 0.99], keys=keys)
    out = out.join(q, keys, "left") if keys else out.transform(beside, q)  # one row each without keys
    out = out.withColumns({f"latency_p{p}": F.coalesce(F.get("_q", i), F.lit(0.0)) for i, p in enumerate((50, 95, 99))}).drop("_q")
    return with_deltas(out, base)


def with_deltas(summary: DataFrame, base: dict[str, float]) -> DataFrame:
    delta = lambda c: F.col(c) - F.lit(float(base.get(c, 0.0)))
    return summary.withColumns(
        {
            "confidence_mean_delta": F.abs(delta("confidence_mean")),
            "event_gate_rate_delta": F.abs(delta("event_gate_rate")),
            "brier_score_delta": delta("brier_score"),
            "win_rate_drop": -delta("win_rate"),
        }
    )


def alerts(summary: DataFrame, keys: list[str]) -> DataFrame:
    """One row per rule that a summary row breaks."""
    cells = F.array(*[F.struct(F.lit(n).alias("alert"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(v).alias("limit")) for n, m, v in ALERT_RULES if m in summary.columns])
    return summary.select(*keys, F.explode(cells).alias("a")).select(*keys, "a.*").filter("value > `limit`")


def release_gates(metrics: DataFrame, gates: list[tuple[str, str, float]] = RELEASE_GATES, optional: tuple[str, ...] = ()) -> DataFrame:
    """One row per gate: value, rule and verdict. A missing metric fails unless optional."""
    rows = []
    for name, rule, limit in gates:
        value = F.col(name).cast("double") if name in metrics.columns else F.lit(None).cast("double")
        ok = value >= limit if rule == "min" else value <= limit
        verdict = F.coalesce(ok, F.lit(name in optional))
        reason = F.when(value.isNull(), "optional_metric_missing" if name in optional else "required_metric_missing").when(ok, "ok").otherwise(f"beyond {rule}")
        rows.append(F.struct(F.lit(name).alias("metric"), value.alias("value"), F.lit(rule).alias("rule"), F.lit(limit).alias("limit"), verdict.alias("passed"), reason.alias("reason")))
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def plausibility(df: DataFrame, rules: list[tuple[str, float, float, float]]) -> DataFrame:
    """Per rule (feature, low, high, largest share outside): share of values outside the range, and the verdict."""
    cells = []
    for name, low, high, most in rules:
        v = F.col(name).cast("double")
        cells.append(F.struct(F.lit(name).alias("feature"), mean_of(~v.between(low, high)).alias("outside_share"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_samp(v).alias("std"), F.lit(most).alias("limit")))
    out = df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("r")).select("r.*")
    return out.withColumn("plausible", (F.col("outside_share") <= F.col("limit")) & (F.col("std") > 1e-12)).drop("limit")


def artifact_check(df: DataFrame, groups: dict[str, list[str]], event_rate: tuple[float, float] = (0.05, 0.60)) -> DataFrame:
    """Checks on a table of bars: repeated keys, event rate in a band, column groups that are all null or all 0."""
    copies = df.groupBy("symbol", "bar_ts").agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(F.col("_n") - 1).alias("_dup"))
    empties = {g: sum((F.when((F.count(c) == 0) | (F.max(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))) == 0), 1).otherwise(0) for c in cols), F.lit(0)) for g, cols in groups.items()}
    stats = df.agg(mean_of(F.col("is_event") == 1).alias("_rate"), *[c.alias(f"_{g}") for g, c in empties.items()])
    both = stats.transform(beside, copies)  # one row each
    row = lambda n, v, ok: F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"), ok.alias("passed"))
    cells = [row("duplicate_bars", F.col("_dup"), F.col("_dup") == 0), row("event_rate", F.col("_rate"), F.col("_rate").between(*event_rate))]
    cells += [row(f"empty_columns_{g}", F.col(f"_{g}"), F.col(f"_{g}") == 0) for g in groups]
    return both.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def column_health(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Why a feature column needs a rebuild: no values, flat, stuck at a cap of 10 (``capped``) or on a raw scale (``signed``)."""
    from tapeloom.operators.evaluate import long_form

    rows = long_form(df, list(rules), []).filter("value is not null")
    q = exact_quantiles(rows, {"_q": "value"}, [0.05, 0.75, 0.95], keys=["feature"])
    tops = rows.groupBy("feature").agg(F.max("value").alias("_top"))
    stats = rows.join(F.broadcast(tops), "feature").groupBy("feature").agg(  # one row per feature
        F.stddev_pop("value").alias("std"), F.min("value").alias("_min"), F.max("value").alias("_max"), F.max(F.abs("value")).alias("_abs"), mean_of(F.col("value") >= F.col("_top") - 1e-9).alias("_at_top")
    )
    names = df.sparkSession.createDataFrame(list(rules.items()), "feature string, kind string")
    out = names.join(stats, "feature", "left").join(q, "feature", "left")  # one row per feature
    capped = (F.col("kind") == "capped") & (F.col("_max") >= 9.999) & (F.get("_q", 1) >= 9.999) & (F.col("_at_top") >= 0.10)
    raw = (F.col("kind") == "signed") & (F.col("_min") >= 0) & (F.col("_abs") < 0.01) & (F.get("_q", 2) - F.get("_q", 0) < 0.10)
    reason = F.when(F.col("std").isNull(), "no finite values").when(capped, "stuck at cap").when((F.col("kind") == "signed") & (F.col("std") <= 1e-10), "flat").when(raw, "raw scale").otherwise("ok")
    return out.select("feature", "std", reason.alias("reason"))


def readiness(checks: DataFrame) -> DataFrame:
    """One row over check rows: how many, which failed, and whether all passed."""
    return checks.agg(
        F.count(F.lit(1)).alias("checks"),
        one(~F.col("passed")).alias("failed"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("check"))))).alias("failed_checks"),
    ).withColumn("passed", F.col("failed") == 0)
