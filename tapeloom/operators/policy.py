"""Cost-aware decision policy: win and loss sizes per market structure and regime, and the decision per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.market import LONG, NEUTRAL, SHORT, clip
from tapeloom.functions.trading import STRUCTURES, normalised
from tapeloom.operators.ahead import first_ahead
from tapeloom.operators.ordered import beside

REGIMES = 4


def side_stats(rows: DataFrame, cost: float) -> DataFrame:
    """Statistics of longs and shorts globally, by structure and by structure and regime.

    Needs structure, regime, bias_label, move (in ticks, unsigned), covered, prob_long, prob_short.
    The rows shrink to sums per (structure, regime); the coarser levels, whose absent keys are
    null, come from those.
    """
    move, label = F.col("move"), F.col("bias_label")

    def sums(p: Column, won: int) -> list[Column]:
        p = clip(p, 0, 1)
        out = [F.count(F.lit(1)).alias("n"), F.sum(F.col("covered").cast("double")).alias("covered"), F.sum(p).alias("p")]
        for name, hit in (("win", label == won), ("loss", label == 1 - won)):
            out += [F.sum(hit.cast("int")).alias(f"{name}_n"), F.sum(F.when(hit, p).otherwise(0.0)).alias(f"{name}_p"), F.sum(F.when(hit, move * p).otherwise(0.0)).alias(f"{name}_pm"), F.sum(F.when(hit, move).otherwise(0.0)).alias(f"{name}_m")]
        return out

    fine = rows.groupBy("structure", "regime").agg(F.struct(*sums(F.col("prob_long"), LONG)).alias("LONG"), F.struct(*sums(F.col("prob_short"), SHORT)).alias("SHORT"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("v")) for s in ("LONG", "SHORT")])
    fine = fine.select("structure", "regime", F.explode(sides).alias("s")).select("structure", "regime", "s.side", "s.v.*")
    parts = ["n", "covered", "p", *[f"{a}_{b}" for a in ("win", "loss") for b in ("n", "p", "pm", "m")]]
    sets = [[F.col("side")], [F.col("side"), F.col("structure")], [F.col("side"), F.col("structure"), F.col("regime")]]
    out = fine.groupingSets(sets, F.col("side"), F.col("structure"), F.col("regime")).agg(*[F.sum(c).alias(c) for c in parts])
    base = F.lit(max(cost, 1.0))

    def size(kind: str) -> Column:  # weighted mean, plain where the weights sum to 0
        weighted = F.when(F.col(f"{kind}_p") > 1e-12, F.col(f"{kind}_pm") / F.col(f"{kind}_p"))
        return F.greatest(F.coalesce(weighted, F.try_divide(F.col(f"{kind}_m"), F.col(f"{kind}_n")), F.lit(0.0)), base)

    prior = F.coalesce(F.when(F.col("p") > 1e-12, F.col("win_p") / F.col("p")), F.col("win_n") / F.col("n"))
    out = out.select(
        "side", "structure", "regime", F.col("n").alias("support"), F.col("win_n").alias("win_support"), F.col("loss_n").alias("loss_support"), (F.col("covered") / F.col("n")).alias("coverage_ratio"),
        size("win").alias("avg_win"), size("loss").alias("avg_loss"), prior.alias("realized_prior"),
    )
    threshold = (F.col("avg_loss") + cost) / F.greatest(F.col("avg_win") + F.col("avg_loss") + cost, F.lit(1e-8))
    return out.withColumn("threshold", clip(threshold, 0, 1))


def _resolved(policy: DataFrame, least: int) -> DataFrame:
    """Per structure and side the values for each regime, from the finest level with enough support.

    The policy is one row here: a map of at most structures times regimes times two entries and
    their totals. The result has one row per structure.
    """
    names = ["avg_win", "avg_loss", "threshold"]
    key = lambda side, structure, regime: F.concat_ws("|", side, structure, regime)
    whole = F.lit("*")
    entry = F.struct(key(F.col("side"), F.coalesce("structure", whole), F.coalesce(F.col("regime").cast("string"), whole)).alias("k"), F.struct("support", *names).alias("v"))
    packed = policy.agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    grid = [(s, r, side) for s in STRUCTURES for r in range(REGIMES) for side in ("LONG", "SHORT")]
    out = policy.sparkSession.createDataFrame(grid, "structure string, regime int, side string").transform(beside, packed)
    at = lambda structure, regime: F.try_element_at("_m", key(F.col("side"), structure, regime))
    levels = [at(F.col("structure"), F.col("regime").cast("string")), at(F.col("structure"), whole)]
    best = at(whole, whole)
    for level in reversed(levels):
        best = F.when(F.coalesce(level["support"] >= least, F.lit(False)), level).otherwise(best)
    value = [F.max(F.when((F.col("side") == s) & (F.col("regime") == r), best[n])).alias(f"_{s}_{n}_{r}") for s in ("LONG", "SHORT") for n in names for r in range(REGIMES)]
    return out.groupBy("structure").agg(*value)


def decide(rows: DataFrame, policy: DataFrame, priors: DataFrame, cost: float, coverage: float = 1.0, min_coverage: float = 0.05, least: int = 40, need_positive: bool = True) -> DataFrame:
    """Bias, expected value and reason per row.

    Needs structure, regime_probs (array of 4), prob_long, prob_short, uncertainty and
    runtime_penalty. ``priors`` is one row with regime_priors that sum to 1; the more uncertain a mix,
    the more of them it takes.
    """
    regimes = range(REGIMES)
    out = rows.transform(beside, priors).join(F.broadcast(_resolved(policy, least)), "structure", "left")  # one row per structure
    # One plain column per regime: short expressions stay in compiled code.
    kept = {f"_k{r}": F.greatest(F.coalesce(F.get("regime_probs", r), F.lit(0.0)), F.lit(0.0)) for r in regimes}
    out = out.withColumns(kept).withColumn("_total", sum((F.col(f"_k{r}") for r in regimes), F.lit(0.0)))
    out = out.withColumns({f"_p{r}": F.when(F.col("_total") > 0, F.col(f"_k{r}") / F.col("_total")).otherwise(1.0 / REGIMES) for r in regimes})
    spread = sum((F.col(f"_p{r}") * F.ln(F.greatest(f"_p{r}", F.lit(1e-12))) for r in regimes), F.lit(0.0))
    out = out.withColumn("regime_entropy", -spread / F.ln(F.lit(float(REGIMES))))
    out = out.withColumn("_blend", clip((F.col("regime_entropy") - 0.70) / 0.25, 0, 1))
    out = out.withColumns({f"_m{r}": (1 - F.col("_blend")) * F.col(f"_p{r}") + F.col("_blend") * F.get("regime_priors", r) for r in regimes})

    def value(side: str, name: str) -> Column:
        return sum((F.col(f"_m{r}") * F.col(f"_{side}_{name}_{r}") for r in regimes), F.lit(0.0))

    pl, ps = clip(F.col("prob_long"), 0, 1), clip(F.col("prob_short"), 0, 1)
    out = out.withColumns(
        {
            "ev_long": pl * value("LONG", "avg_win") - (1 - pl) * value("LONG", "avg_loss") - cost,
            "ev_short": ps * value("SHORT", "avg_win") - (1 - ps) * value("SHORT", "avg_loss") - cost,
            "long_threshold": value("LONG", "threshold"),
            "short_threshold": value("SHORT", "threshold"),
        }
    )
    covered, healthy = F.lit(coverage >= min_coverage), F.col("runtime_penalty") >= 0.5
    lt, st = pl >= F.col("long_threshold"), ps >= F.col("short_threshold")
    lp, sp = F.col("ev_long") > 0, F.col("ev_short") > 0
    ok_l, ok_s = covered & healthy & lt & (lp if need_positive else F.lit(True)), covered & healthy & st & (sp if need_positive else F.lit(True))
    take_long = ok_l & (~ok_s | (F.col("ev_long") >= F.col("ev_short")))
    reason = (
        F.when(take_long, "cost_aware_ev_long")
        .when(ok_s, "cost_aware_ev_short")
        .when(~covered, "policy_coverage_too_low")
        .when(~healthy, "runtime_penalty_too_low")
        .when(~lt & ~st, "probability_below_threshold")
        .when(~lp & ~sp, "expected_value_non_positive")
        .otherwise("mixed_policy_constraints")
    )
    runtime = F.greatest(clip(F.col("runtime_penalty"), 0, 1), F.lit(0.25))
    out = out.withColumns(
        {
            "bias": F.when(take_long, LONG).when(ok_s, SHORT).otherwise(NEUTRAL),
            "reason": reason,
            "expected_value": F.when(take_long, F.col("ev_long")).when(ok_s, F.col("ev_short")).otherwise(F.greatest("ev_long", "ev_short")),
            "sizing_penalty": clip((1 - clip(F.col("uncertainty"), 0, 1)) * (1 - F.col("regime_entropy")) * runtime, 0, 1),
        }
    )
    return out.drop("regime_priors", *[c for c in out.columns if c.startswith("_")])


def regime_priors(rows: DataFrame) -> DataFrame:
    """One row: mean regime probabilities, over their sum."""
    means = rows.agg(F.array(*[F.avg(F.get("regime_probs", r)) for r in range(REGIMES)]).alias("_means"))
    return means.select(normalised(F.col("_means")).alias("regime_priors"))


# ------------------------------------------------------------------------------ trade paths


def trade_paths(rows: DataFrame, h: int, tick: float, *, tp: float = 1.5, sl: float = 1.0, threshold_ticks: float = 1.0, latency: int = 0, price: str = "price", cost_ticks: float = 0.0) -> DataFrame:
    """Replay each signal (column direction, 0 or 1) on the next h rows: exit, best and worst move, profit.

    Entry is the price ``latency`` rows after the signal; columns micro_atr and price are needed.
    """
    step = F.greatest(F.lit(threshold_ticks * tick), 0.5 * F.greatest("micro_atr", F.lit(0.0)), F.lit(tick))
    long, short = F.col("direction") == LONG, F.col("direction") == SHORT
    out = rows.withColumns({"_tp": F.greatest(step * tp, F.lit(tick)), "_sl": F.greatest(step * sl, F.lit(tick)), "_sign": F.when(long, 1.0).otherwise(-1.0)})
    out = out.withColumns({"_up": F.when(long, F.col("_tp")).when(short, F.col("_sl")), "_down": F.when(long, -F.col("_sl")).when(short, -F.col("_tp"))})
    out = first_ahead(out, h, {"_hit": ("_up", "_down")}, price, moves=True, skip=latency, path=True)
    end, hit = F.col("_end"), F.col("_hit")
    out = out.filter(F.col("direction").isin(LONG, SHORT) & end.isNotNull()).withColumn("entry_price", F.col("_from"))
    gain = lambda x: (x[price] - F.col("entry_price")) * F.col("_sign")
    best, worst = F.when(long, F.col("_top")).otherwise(F.col("_bottom")), F.when(long, F.col("_bottom")).otherwise(F.col("_top"))
    extent = lambda x: (x - F.col("entry_price")) * F.col("_sign") / tick
    reason = F.when(hit.isNull(), "horizon").when(gain(hit) >= F.col("_tp"), "tp").otherwise("sl")
    out = out.withColumn("exit_reason", reason)
    made = F.when(F.col("exit_reason") == "tp", F.col("_tp")).when(F.col("exit_reason") == "sl", -F.col("_sl")).otherwise(gain(end))
    out = out.withColumns(
        {
            "exit_ts": F.coalesce(hit["ts_event"], end["ts_event"]),
            "hold_steps": F.coalesce(hit["_n"], end["_n"]),
            "raw_pnl_ticks": made / tick,
            "pnl_ticks": made / tick - cost_ticks,
            "mfe_ticks": extent(best),
            "mae_ticks": extent(worst),
        }
    )
    return out.drop("_tp", "_sl", "_sign", "_up", "_down", "_hit", "_end", "_from", "_top", "_bottom")
