"""Forward labels: which barrier the price meets first, and when the label is known.

The first barrier met, under one rule or many, is found while a symbol's rows stream by
(`ahead.first_ahead`). Only outcome labels, whose path ends with its session, see the next 12 bars as an
array. Every label carries ``label_end_ts``.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.market import LONG, NEUTRAL, SHORT, clip
from tapeloom.operators.ahead import first_ahead
from tapeloom.operators.ordered import KEYS, ORDER, SALTS, beside, exact_quantiles, fits, matched, numbered, spec, windowed
from tapeloom.operators.orderstat import prefix_quantile
from tapeloom.operators.sliding import sliding
from tapeloom.runtime import frozen

# Outcomes of a path.
LONG_TP, SHORT_TP, LONG_SL, SHORT_SL, TIMEOUT, WEAK_LONG, WEAK_SHORT = range(7)
# Why a label is neutral.
REASON_NONE, REASON_TIMEOUT, REASON_LONG_SL, REASON_SHORT_SL, REASON_TREND, REASON_WEAK = range(6)
# Quality of a label, and result of one side.
QUALITY_NONE, QUALITY_WEAK, QUALITY_STRONG = range(3)
WIN, LOSE, CANCEL = 1, 0, 2
# Fixed values per regime: target and stop in ATR, longest holding time in bars, event threshold.
REGIME_TP = {"trending": 2.0, "ranging": 1.1, "volatile": 1.8}
REGIME_SL = {"trending": 1.0, "ranging": 0.6, "volatile": 1.0}
REGIME_BARS = {"trending": 12, "ranging": 6, "volatile": 3}
REGIME_EVENT = {"trending": 0.60, "ranging": 0.60, "volatile": 0.75}
# Hour (UTC) at which a session ends.
SESSION_END = {"asia": 8, "london": 16, "overlap": 16, "ny": 21}


def lookup(table: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def with_future(df: DataFrame, columns: Sequence[str], h: int, *, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, check: bool = True) -> DataFrame:
    """Add ``_n``, a row number to subtract, and ``_future``: the next h rows as structs."""

    def gather(rows, w):
        rows = rows.withColumn("_n", F.row_number().over(w))
        return rows.withColumn("_future", F.collect_list(F.struct("_n", *columns)).over(w.rowsBetween(1, h)))

    return windowed(df, gather, after=h, keys=keys, order=order, check=check)


def first_where(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(array, test), F.lit(1))


def last_of(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


@dataclass(frozen=True)
class BarrierRule:
    horizon: int = 150
    tick: float = 0.0001
    tp: float = 1.5
    sl: float = 1.0
    neutral: float = 0.5
    min_ticks: float = 1.0
    cost_ticks: float = 1.0
    spread_mult: float = 1.0


#: Frames over `price_step` that stand in for a volatility.
USUAL_STEP = {"_known": ("count", "_step", 50), "_median": ("median", "_step", 50)}


def price_step(df: DataFrame, price: str = "mid_price") -> DataFrame:
    """Add ``_step``, how far the price has moved since the row before."""
    return windowed(df, lambda rows, w: rows.withColumn("_step", F.abs(F.col(price) - F.lag(price).over(w))), before=1)


def fill_volatility(df: DataFrame, tick: float, price: str = "mid_price", vol: str = "realized_vol", stepped: bool = False) -> DataFrame:
    """Where the volatility is null: median step of the last 50 rows (5 needed), else one tick; at least a tick.

    ``stepped``: the rows have ``_step`` and the frames of `USUAL_STEP`.
    """
    if vol not in df.columns:
        df = df.withColumn(vol, F.lit(None).cast("double"))
    out = df if stepped else sliding(price_step(df, price), USUAL_STEP)
    usual = F.when(F.col("_known") >= 5, F.col("_median"))
    return out.withColumn(vol, F.greatest(F.coalesce(F.col(vol), usual, F.lit(tick)), F.lit(tick))).drop("_step", "_known", "_median")


def barrier_parts(df: DataFrame, rule: BarrierRule, price: str = "mid_price", vol: str = "realized_vol") -> DataFrame:
    """Distances of the barriers, the floor under them and whether it holds them."""
    gap = F.coalesce("spread", F.lit(0.0)) if "spread" in df.columns else F.lit(0.0)
    floor = F.greatest(F.lit(rule.min_ticks), rule.cost_ticks + rule.spread_mult * gap / max(rule.tick, 1e-12))
    df = df.withColumn("barrier_floor_ticks", floor).withColumn("_floor", F.col("barrier_floor_ticks") * rule.tick)
    df = df.withColumn("base", F.greatest(vol, "_floor"))
    df = df.withColumns({f"{n}_distance": F.greatest(F.col("base") * m, F.col("_floor")) for n, m in (("upper", rule.tp), ("lower", rule.sl), ("neutral", rule.neutral))})
    df = df.withColumns({f"{n}_clamped": F.col("base") * m <= F.col("_floor") for n, m in (("tp", rule.tp), ("sl", rule.sl), ("neutral", rule.neutral))})
    return df.withColumns({"upper_barrier": F.col(price) + F.col("upper_distance"), "lower_barrier": F.col(price) - F.col("lower_distance")}).drop("_floor")


def _decide(df: DataFrame, price: str) -> DataFrame:
    """Label columns from the first barrier met, ``_hit``, and the last row looked at, ``_end``."""
    up, band = F.col("upper_barrier"), F.col("neutral_distance")
    hit, end = F.col("_hit"), F.col("_end")
    stop = F.coalesce(hit, end)
    move = end[price] - F.col(price)
    outcome = (
        F.when(hit[price] >= up, "upper_hit")
        .when(hit.isNotNull(), "lower_hit")
        .when(end.isNull(), "no_future")
        .when(move >= band, "timeout_directional_up")
        .when(move <= -band, "timeout_directional_down")
        .otherwise("timeout_neutral")
    )
    df = df.withColumns(
        {
            "barrier_hit_type": outcome,
            "tradeability_label": hit.isNotNull().cast("int"),
            "label_end_ts": F.coalesce(stop["ts_event"], F.col("ts_event")),
            "horizon_end_ts": F.coalesce(end["ts_event"], F.col("ts_event")),
            "label_horizon_steps": F.coalesce(stop["_n"] - F.col("_n"), F.lit(0)),
            "realized_return": F.coalesce(stop[price] - F.col(price), F.lit(0.0)),
        }
    )
    kind = F.col("barrier_hit_type")
    label = F.when(kind.isin("upper_hit", "timeout_directional_up"), LONG).when(kind.isin("lower_hit", "timeout_directional_down"), SHORT).otherwise(NEUTRAL)
    df = df.withColumn("bias_label", label)
    return df.withColumns({"event_flag": (F.col("bias_label") != NEUTRAL).cast("int"), "train_event_flag": F.col("tradeability_label")}).drop("_hit", "_end")


def triple_barrier(df: DataFrame, rule: BarrierRule, price: str = "mid_price", vol: str = "realized_vol", stepped: bool = False) -> DataFrame:
    """First of the upper and lower barrier within the horizon, else the last move against a band.

    ``stepped``: as in `fill_volatility`.
    """
    missing = F.when(F.col(price).isNull(), F.raise_error(F.lit("a row has no price")).cast("double")).otherwise(F.col(price))
    df = fill_volatility(df.withColumn(price, missing), rule.tick, price, vol, stepped)
    df = first_ahead(barrier_parts(df, rule, price, vol), rule.horizon, {"_hit": ("upper_barrier", "lower_barrier")}, price)
    return _decide(df.withColumn("_n", F.lit(0)), price).drop("_n")


def label_grid(df: DataFrame, horizons: Sequence[int], tps: Sequence[float], sls: Sequence[float], neutrals: Sequence[float], rule: BarrierRule, price: str = "mid_price") -> DataFrame:
    """Label shares for every combination of parameters, with a score; lower is better.

    The rows are shuffled and streamed once; every pair of barriers is a race over the longest horizon, and
    a shorter horizon keeps what was met within it. Each task adds up its rows under all rules.
    """
    rows = barrier_parts(fill_volatility(df, rule.tick, price), rule, price)
    floor = F.col("barrier_floor_ticks") * rule.tick
    far = lambda m: F.greatest(F.col("base") * float(m), floor)
    ups = {f"_up{i}": F.col(price) + far(m) for i, m in enumerate(tps)}
    downs = {f"_down{j}": F.col(price) - far(m) for j, m in enumerate(sls)}
    bands = {f"_band{k}": far(m) for k, m in enumerate(neutrals)}
    rows = rows.select(*dict.fromkeys([*KEYS, *ORDER, price]), *[c.alias(n) for n, c in {**ups, **downs, **bands}.items()])
    rows = first_ahead(rows, max(horizons), {f"_race{u}{d}": (u, d) for u in ups for d in downs}, price, ends=horizons)

    def cell(h: int, i: int, j: int, k: int) -> Column:
        race, fixed = F.col(f"_race_up{i}_down{j}"), {"horizon": h, "tp_mult": float(tps[i]), "sl_mult": float(sls[j]), "neutral_mult": float(neutrals[k])}
        found = {"upper_barrier": F.col(f"_up{i}"), "neutral_distance": F.col(f"_band{k}"), "_hit": F.when(race["_n"] <= h, race), "_end": F.col(f"_end_{h}")}
        return F.struct(*[F.lit(v).alias(n) for n, v in fixed.items()], *[c.alias(n) for n, c in found.items()])

    cells = F.array(*[cell(h, i, j, k) for h in horizons for i in range(len(tps)) for j in range(len(sls)) for k in range(len(neutrals))])
    rows = _decide(rows.select("ts_event", price, F.lit(0).alias("_n"), F.explode(cells).alias("g")).select("ts_event", price, "_n", "g.*"), price)
    keys = ["horizon", "tp_mult", "sl_mult", "neutral_mult"]
    share = lambda c: F.avg(c.cast("double"))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        share(F.col("bias_label") == LONG).alias("long_share"),
        share(F.col("bias_label") == SHORT).alias("short_share"),
        share(F.col("bias_label") == NEUTRAL).alias("neutral_share"),
        share(F.col("tradeability_label") == 1).alias("event_share"),
        F.avg("realized_return").alias("realized_return_mean"),
        F.stddev_pop("realized_return").alias("realized_return_std"),
        F.min((F.col("label_end_ts") >= F.col("ts_event")).cast("int")).alias("_causal"),
    )
    directional = F.col("long_share") + F.col("short_share")
    out = out.withColumns({"directional_share": directional, "long_short_imbalance": F.abs(F.col("long_share") - F.col("short_share")) / F.greatest(directional, 1.0 / F.col("rows"))})
    d, imb = F.col("directional_share"), F.col("long_short_imbalance")
    score = F.abs(d - 0.12) + 0.25 * imb + F.abs(F.col("event_share") - F.least(d, F.lit(0.12)))
    score = score + F.when(d.between(0.05, 0.25), 0.0).otherwise(1.0 + F.abs(d - 0.12)) + F.when(F.col("neutral_share") <= 0, 1.0).otherwise(0.0)
    score = score + F.when(imb > 0.60, 0.5).otherwise(0.0) + F.when(F.col("_causal") == 1, 0.0).otherwise(10.0)
    return out.withColumn("score", score).drop("_causal").orderBy("score", *keys)


def rule_summary(df: DataFrame, rule: BarrierRule, name: str, price: str = "mid_price") -> DataFrame:
    """One row: label counts, clamp shares and distance percentiles in ticks under a rule."""
    rows = triple_barrier(df, rule, price).withColumns({"_u": F.col("upper_distance") / rule.tick, "_l": F.col("lower_distance") / rule.tick})
    rows = frozen(rows.select("bias_label", "tp_clamped", "sl_clamped", "neutral_clamped", "tradeability_label", "_u", "_l"))  # read by counts and quantiles
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    stats = rows.agg(
        *[one(F.col("bias_label") == v).alias(n) for n, v in (("long_count", LONG), ("short_count", SHORT), ("neutral_count", NEUTRAL))],
        *[F.avg(F.col(f"{n}_clamped").cast("double")).alias(f"{n}_clamp_share") for n in ("tp", "sl", "neutral")],
        F.avg("tradeability_label").alias("event_share"),
    )
    q = exact_quantiles(rows, {"_uq": "_u", "_lq": "_l"}, [0.5, 0.95])
    out = stats.transform(beside, q)  # one row each
    return out.select(F.lit(name).alias("rule"), *[c for c in stats.columns], F.get("_uq", 0).alias("upper_median"), F.get("_uq", 1).alias("upper_p95"), F.get("_lq", 0).alias("lower_median"), F.get("_lq", 1).alias("lower_p95"))


def compare_rules(df: DataFrame, a: BarrierRule, b: BarrierRule, rows: int, seed: int, price: str = "mid_price") -> DataFrame:
    """A seeded sample of rows labelled under two rules, side by side."""
    pick = df.orderBy(F.xxhash64("symbol", "sequence", F.lit(seed)), "symbol", "sequence").limit(rows).select("symbol", "sequence")
    names = ["bias_label", "barrier_hit_type", "label_end_ts", "upper_barrier", "lower_barrier"]
    side = lambda r, p: triple_barrier(df, r, price).select("symbol", "sequence", *[F.col(n).alias(f"{p}_{n}") for n in names])
    return pick.join(side(a, "a"), ["symbol", "sequence"]).join(side(b, "b"), ["symbol", "sequence"])


def terminal_labels(df: DataFrame, h: int, tick: float, threshold_ticks: float = 5.0, price: str = "price", least: int | None = None, frame: int | None = None) -> DataFrame:
    """Direction of the price h rows on (or at the end), graded against the 70th percentile of past moves."""
    least, frame = least or max(24, h), frame or max(96, h * 6)

    def ahead(rows, w):
        f = w.rowsBetween(1, h)
        return rows.withColumn("future_return", F.coalesce(F.last(price).over(f) - F.col(price), F.lit(0.0)))

    out = windowed(df, ahead, after=h)
    limit, r = tick * threshold_ticks, F.col("future_return")
    out = out.withColumn("bias_label", F.when(r > limit, LONG).when(r < -limit, SHORT).otherwise(NEUTRAL))
    moved = F.when(F.col("bias_label") != NEUTRAL, F.abs(r))

    def grade(rows, w):
        prior = w.rowsBetween(-max(frame, least), -1)
        usual = F.when(F.count(moved).over(prior) >= max(8, least), F.percentile(moved, 0.70).over(prior))
        return rows.withColumn("quality_threshold", F.greatest(F.coalesce(usual, F.lit(tick * 10.0)), F.lit(max(tick * 8.0, 1e-9))))

    out = windowed(out, grade, before=max(frame, least))
    label = F.col("bias_label")
    return out.withColumns(
        {
            "signal_quality": F.when(label == NEUTRAL, QUALITY_NONE).when(F.abs(r) >= F.col("quality_threshold"), QUALITY_STRONG).otherwise(QUALITY_WEAK),
            "long_label": F.when(label == LONG, WIN).when(label == SHORT, LOSE).otherwise(CANCEL),
            "short_label": F.when(label == SHORT, WIN).when(label == LONG, LOSE).otherwise(CANCEL),
        }
    )


def economic_floor(threshold: Column, tp: float, sl: float, cost: float) -> Column:
    """Smallest target in ticks that pays for the stop and the costs."""
    base = F.greatest(threshold, F.lit(0.0)) * max(tp, 0.0)
    return F.greatest(base, F.greatest(threshold, F.lit(0.0)) * max(sl, 0.0) + max(cost, 0.0)) if cost > 0 else base


def wall_target(price: Column, wall: Column, strength: Column, direction: int, tick: float, min_ticks: float, buffer_ticks: float = 1.0, min_strength: float = 2.5) -> Column:
    """Distance to just before a strong wall ahead; null where there is none worth it."""
    away = wall - tick * buffer_ticks - price if direction == LONG else price - (wall + tick * buffer_ticks)
    ahead = wall > price if direction == LONG else wall < price
    floor = F.when(strength <= 1.0, min(min_strength, 0.5)).otherwise(min_strength)
    weak = F.coalesce((strength > 0) & (strength < floor), F.lit(False))
    return F.when(ahead & ~weak & (away >= min_ticks * tick), away)


def first_touch(df: DataFrame, h: int, tick: float, *, tp: float = 1.5, sl: float = 1.0, threshold: str = "threshold", horizon: str | None = None, floor_ticks: float = 0.0, walls: bool = False, price: str = "price") -> DataFrame:
    """Race target against stop for both sides; the side whose target comes first wins.

    ``threshold`` is a distance per row, ``horizon`` a column with the rows to look ahead, at most
    h. With ``walls`` the targets end before strong walls (columns bid_wall_px, ask_wall_px and
    their strengths).
    """
    p0 = F.col(price)
    thr = F.greatest(F.col(threshold), F.lit(tick))
    target = F.greatest(thr * tp, F.lit(max(floor_ticks, 0.0) * tick))
    up = down = target
    if walls:
        least = max(2.0, floor_ticks)
        up = F.least(target, F.coalesce(wall_target(p0, F.col("ask_wall_px"), F.col("ask_wall_strength"), LONG, tick, least), target))
        down = F.least(target, F.coalesce(wall_target(p0, F.col("bid_wall_px"), F.col("bid_wall_strength"), SHORT, tick, least), target))
    df = df.withColumns({"tp_long": up, "tp_short": down, "stop_distance": thr * sl})
    df = df.withColumns({"_below_long": -F.col("stop_distance"), "_below_short": -F.col("tp_short"), "_n": F.lit(0)})
    races = {"_l": ("tp_long", "_below_long"), "_s": ("stop_distance", "_below_short")}
    df = first_ahead(df, h, races, price, moves=True, horizon=horizon)
    move = lambda x: x[price] - p0
    tl, ts = F.col("tp_long"), F.col("tp_short")
    lhit, shit = F.col("_l"), F.col("_s")
    lwin, swin = F.coalesce(move(lhit) >= tl, F.lit(False)), F.coalesce(move(shit) <= -ts, F.lit(False))
    lfirst = lhit.isNotNull() & (shit.isNull() | (lhit["_n"] <= shit["_n"]))
    outcome = (
        F.when(lwin & (~swin | (lhit["_n"] <= shit["_n"])), LONG_TP)
        .when(swin, SHORT_TP)
        .when(lhit.isNull() & shit.isNull(), TIMEOUT)
        .when(lfirst, LONG_SL)
        .otherwise(SHORT_SL)
    )
    df = df.withColumn("path_outcome", outcome)
    end = F.when(F.col("path_outcome").isin(LONG_TP, LONG_SL), lhit).when(F.col("path_outcome").isin(SHORT_TP, SHORT_SL), shit)
    return path_columns(df).withColumns(
        {
            "label_end_ts": F.coalesce(end["ts_event"], F.col("ts_event")),
            "label_horizon_steps": F.coalesce(end["_n"] - F.col("_n"), F.lit(0)),
            "terminal_move": F.coalesce(end[price] - p0, F.lit(0.0)),
        }
    ).drop("_n", "_l", "_s", "_end", "_below_long", "_below_short")


def path_columns(df: DataFrame) -> DataFrame:
    """Label, quality, reason and each side's result from a path outcome."""
    o = F.col("path_outcome")
    return df.withColumns(
        {
            "bias_label": F.when(o == LONG_TP, LONG).when(o == SHORT_TP, SHORT).otherwise(NEUTRAL),
            "signal_quality": F.when(o.isin(LONG_TP, SHORT_TP), QUALITY_STRONG).otherwise(QUALITY_WEAK),
            "adverse_path_flag": o.isin(LONG_SL, SHORT_SL).cast("int"),
            "neutral_reason": F.when(o == TIMEOUT, REASON_TIMEOUT).when(o == LONG_SL, REASON_LONG_SL).when(o == SHORT_SL, REASON_SHORT_SL).otherwise(REASON_NONE),
            "long_label": F.when(o == LONG_TP, WIN).when(o == LONG_SL, LOSE).otherwise(CANCEL),
            "short_label": F.when(o == SHORT_TP, WIN).when(o == SHORT_SL, LOSE).otherwise(CANCEL),
        }
    )


def timeout_exceeded(move: Column, band: Column) -> Column:
    return ((F.col("path_outcome") == TIMEOUT) & (F.abs(move) >= band)).cast("int")


def expanding_median(df: DataFrame, column: str, name: str, least: int = 1, *, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Median of a column over all rows so far; null under ``least`` values."""
    if not fits(df, keys):
        return prefix_quantile(df, column, name, F.lit(0.5), least, keys=keys, order=order)

    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.DoubleType())])
    kept, key_names = schema.names[:-1], list(keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, low, high = None, [], []  # heaps of the smaller half (negated) and the larger half
        for batch in batches:
            medians = []
            for key, v in zip(zip(*[batch.column(k).to_pylist() for k in key_names]), batch.column(column).to_pylist()):
                if key != owner:
                    owner, low, high = key, [], []
                if v is not None:
                    heapq.heappush(high, -heapq.heappushpop(low, -v))
                    if len(high) > len(low):
                        heapq.heappush(low, -heapq.heappop(high))
                seen = len(low) + len(high)
                enough = seen >= max(least, 1)
                medians.append((-low[0] if seen % 2 else (high[0] - low[0]) / 2) if enough else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(medians, pa.float64())], schema.names)

    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)  # a key's rows follow each other in one task
    return rows.mapInArrow(walk, schema)


def micro_volatility(df: DataFrame, n: int = 20, price: str = "price") -> DataFrame:
    """Rolling deviation of price steps; where it is 0, its median so far."""

    def dev(rows, w):
        return rows.withColumn("_r", F.coalesce(F.col(price) - F.lag(price).over(w), F.lit(0.0)))

    out = windowed(windowed(df, dev, before=1), lambda r, w: r.withColumn("_sd", F.stddev_pop("_r").over(w.rowsBetween(-(n - 1), 0))), before=n)
    out = out.withColumn("_seen", F.when(F.col("_sd") > 1e-10, F.col("_sd")))
    out = expanding_median(out, "_seen", "_med")
    return out.withColumn("micro_vol", F.when(F.col("_sd") < 1e-10, F.coalesce("_med", F.lit(1e-5))).otherwise(F.col("_sd"))).drop("_r", "_sd", "_seen", "_med")


def adaptive_horizon(df: DataFrame, vol: str, base: int, low: float = 0.5, high: float = 3.0) -> DataFrame:
    """Rows to look ahead, in proportion to volatility over its median so far."""
    out = df.withColumn("_seen", F.when(F.col(vol) > 1e-10, F.col(vol)))
    out = expanding_median(out, "_seen", "_med")
    out = out.withColumn("_safe", F.when(F.col(vol) < 1e-10, F.col("_med")).otherwise(F.col(vol)))
    ratio = F.when(F.col("_med") >= 1e-10, F.col("_safe") / F.col("_med")).otherwise(1.0)
    return out.withColumn("effective_horizon", F.coalesce(F.rint(clip(ratio, low, high) * base), F.lit(float(base))).cast("int")).drop("_seen", "_med", "_safe")


# ---------------------------------------------------------------------------------------- bars


def _bar_future(bars: DataFrame, h: int, extra: Sequence[str] = ()) -> DataFrame:
    return with_future(bars, ["bar_ts", "open", "high", "low", "close", *extra], h, order=["bar_ts"], check=False)


def _side(x: Column, target: Column, stop: Column, up: bool, tp_name: str, sl_name: str) -> Column:
    """What one side meets in a bar; where it meets both, the one nearer to the bar's open."""
    t = x["high"] >= target if up else x["low"] <= target
    s = x["low"] <= stop if up else x["high"] >= stop
    near = F.abs(target - x["open"]) <= F.abs(stop - x["open"])
    return F.when(t & s, F.when(near, tp_name).otherwise(sl_name)).when(t, tp_name).when(s, sl_name)


def _bar_race(bars: DataFrame, future: Column, tp: Column, sl: Column, allow_long: Column, allow_short: Column) -> DataFrame:
    """First event of the future bars, longs looked at before shorts, as ``_event`` struct(kind, bar_ts, _n, close)."""
    entry = F.col("close")
    bars = bars.withColumns({"_tl": entry + tp, "_ll": entry - sl, "_ts": entry - tp, "_ls": entry + sl, "_al": allow_long, "_as": allow_short})

    def event(x):
        long = F.when(F.col("_al"), _side(x, F.col("_tl"), F.col("_ll"), True, "long_tp", "long_sl"))
        short = F.when(F.col("_as"), _side(x, F.col("_ts"), F.col("_ls"), False, "short_tp", "short_sl"))
        return F.struct(F.coalesce(long, short).alias("kind"), x["bar_ts"].alias("bar_ts"), x["_n"].alias("_n"), x["close"].alias("close"))

    bars = bars.withColumn("_event", first_where(F.transform(future, event), lambda e: e["kind"].isNotNull()))
    return bars.drop("_tl", "_ll", "_ts", "_ls", "_al", "_as")


def _bar_ahead(bars: DataFrame, h: int, races: dict[str, tuple[str, str]]) -> DataFrame:
    """The first of the next h bars whose high or low meets a barrier, and the last of them."""
    return first_ahead(bars, h, races, "close", time="bar_ts", high="high", low="low", also=["open", "high", "low"], check=False, order=["bar_ts"])


KINDS = {"long_tp": LONG_TP, "short_tp": SHORT_TP, "long_sl": LONG_SL, "short_sl": SHORT_SL}


def bar_barriers(bars: DataFrame, h: int = 6, tp: float = 1.5, sl: float = 1.0, min_atr: float = 0.0003) -> DataFrame:
    """ATR barriers on bars; the last h bars of a symbol stay unlabelled (timeout)."""
    atr = F.greatest("atr_14", F.lit(min_atr))
    entry = F.col("close")
    out = bars.withColumns({"_tl": entry + atr * tp, "_ll": entry - atr * sl, "_ts": entry - atr * tp, "_ls": entry + atr * sl})
    out = _bar_ahead(out.withColumns({"_up": F.least("_tl", "_ls"), "_down": F.greatest("_ll", "_ts")}), h, {"_hit": ("_up", "_down")})
    end, hit = F.col("_end"), F.col("_hit")
    long, short = _side(hit, F.col("_tl"), F.col("_ll"), True, "long_tp", "long_sl"), _side(hit, F.col("_ts"), F.col("_ls"), False, "short_tp", "short_sl")
    out = out.withColumn("_full", F.coalesce(end["_n"] == h, F.lit(False)))
    out = out.withColumn("_event", F.when(F.col("_full") & hit.isNotNull(), F.struct(F.coalesce(long, short).alias("kind"), hit["bar_ts"].alias("bar_ts"))))
    e = F.col("_event")
    out = out.withColumn("path_outcome", F.when(e.isNull(), TIMEOUT).otherwise(lookup(KINDS, e["kind"], TIMEOUT)))
    o = F.col("path_outcome")
    return out.withColumns(
        {
            "bias_label": F.when(o == LONG_TP, LONG).when(o == SHORT_TP, SHORT).otherwise(NEUTRAL),
            "label_end_ts": F.coalesce(e["bar_ts"], F.when(F.col("_full"), end["bar_ts"]), F.col("bar_ts")),
            "forward_return": F.when(F.col("_full"), (end["close"] - F.col("close")) / F.greatest("close", F.lit(1e-8))).otherwise(0.0),
        }
    ).drop("_tl", "_ll", "_ts", "_ls", "_up", "_down", "_hit", "_end", "_event", "_full")


def outcome_labels(bars: DataFrame, *, min_atr: float = 0.0003, trend_floor: float = 0.70, default_bars: int = 6, weak_to_directional: bool = False, weak_move: float = 0.35) -> DataFrame:
    """Label events by the first barrier within the regime's horizon and the session.

    Needs regime_label, session, is_event, event_score, event_direction, kalman_direction and
    strong_session beside the bar. An event's direction, or a trend against a weak event, rules out
    a side.
    """
    longest = max(default_bars, *REGIME_BARS.values())
    out = _bar_future(bars, longest)
    allowed = F.slice("_future", F.lit(1), lookup(REGIME_BARS, F.col("regime_label"), default_bars))
    end_hour = lookup(SESSION_END, F.col("session"), 21)
    out = out.withColumn("_end_hour", end_hour).withColumn("_allowed", allowed)
    out = out.withColumn("_over", first_where(F.col("_allowed"), lambda x: F.hour(x["bar_ts"]) >= F.col("_end_hour")))
    out = out.withColumn("_path", F.filter("_allowed", lambda x: F.col("_over").isNull() | (x["_n"] < F.col("_over._n"))))
    way, trend, weak = F.col("event_direction"), F.col("kalman_direction"), F.col("event_score") < trend_floor
    is_event = F.col("is_event") == 1
    allow_short = ~((way > 0) | ((way == 0) & (trend == 1) & weak))
    allow_long = ~((way < 0) | ((way == 0) & (trend == -1) & weak))
    atr = F.greatest("atr_14", F.lit(min_atr))
    tp, sl = lookup(REGIME_TP, F.col("regime_label"), 1.5), lookup(REGIME_SL, F.col("regime_label"), 1.0)
    out = _bar_race(out, F.when(is_event, F.col("_path")), tp * atr, sl * atr, allow_long, allow_short)
    e, end = F.col("_event"), last_of(F.col("_path"))
    drift = F.coalesce(end["close"] - F.col("close"), F.lit(0.0))
    weak_up, weak_down = drift >= weak_move * atr, drift <= -weak_move * atr
    directional = ~is_event & F.lit(weak_to_directional)
    o = (
        F.when(directional & weak_up, WEAK_LONG)
        .when(directional & weak_down, WEAK_SHORT)
        .when(e.isNull(), TIMEOUT)
        .otherwise(lookup(KINDS, e["kind"], TIMEOUT))
    )
    out = out.withColumn("path_outcome", o)
    o = F.col("path_outcome")
    stop = F.when(is_event, F.coalesce(e, F.struct(F.lit(None).cast("string").alias("kind"), end["bar_ts"].alias("bar_ts"), end["_n"].alias("_n"), end["close"].alias("close")))).when(
        F.lit(weak_to_directional), F.struct(F.lit(None).cast("string").alias("kind"), end["bar_ts"].alias("bar_ts"), end["_n"].alias("_n"), end["close"].alias("close"))
    )
    strong = F.coalesce(F.col("strong_session") == 1, F.lit(False))
    out = out.withColumns(
        {
            "bias_label": F.when(o.isin(LONG_TP, WEAK_LONG), LONG).when(o.isin(SHORT_TP, WEAK_SHORT), SHORT).otherwise(NEUTRAL),
            "neutral_reason": F.when(~is_event & (o == TIMEOUT), REASON_WEAK)
            .when(o == TIMEOUT, F.when(allow_long & allow_short, REASON_TIMEOUT).otherwise(REASON_TREND))
            .when(o == LONG_SL, REASON_LONG_SL)
            .when(o == SHORT_SL, REASON_SHORT_SL)
            .otherwise(REASON_NONE),
            "signal_quality": F.when(o.isin(LONG_TP, SHORT_TP), F.when(strong, 2).otherwise(1)).when(o.isin(WEAK_LONG, WEAK_SHORT), strong.cast("int")).otherwise(0),
            "_stop": stop,
        }
    )
    out = out.withColumns(
        {
            "label_end_ts": F.coalesce("_stop.bar_ts", "bar_ts"),
            "label_horizon_steps": F.coalesce(F.col("_stop._n") - F.col("_n"), F.lit(0)),
            "forward_return": F.coalesce((F.col("_stop.close") - F.col("close")) / F.greatest(F.abs("close"), F.lit(1e-8)), F.lit(0.0)),
            "event_flag": (is_event & F.col("bias_label").isin(LONG, SHORT) & (F.col("signal_quality") > 0)).cast("int"),
            "train_event_flag": (is_event & (F.col("bias_label") != NEUTRAL)).cast("int"),
        }
    )
    return out.drop("_future", "_n", "_end_hour", "_allowed", "_over", "_path", "_event", "_stop")


def simulate_touch(bars: DataFrame, h: int, tp: float, sl: float, atr_floor: float, tie: str = "tp_first", race: str = "coupled") -> DataFrame:
    """First touch under a tie rule: ``tp_first``, ``sl_first`` or ``ambiguous_neutral``.

    ``coupled`` ends at the first event of either side; ``independent`` races both sides and takes
    the earlier win. Bars without h bars after them are left out.
    """
    atr, entry = F.greatest("atr_14", F.lit(atr_floor)), F.col("close")
    out = bars.withColumns({"_tl": entry + atr * tp, "_ll": entry - atr * sl, "_ts": entry - atr * tp, "_ls": entry + atr * sl})
    out = out.withColumns({"_up": F.least("_tl", "_ls"), "_down": F.greatest("_ll", "_ts")})
    races = {"_any": ("_up", "_down")} if race == "coupled" else {"_long": ("_tl", "_ll"), "_short": ("_ls", "_ts")}
    out = _bar_ahead(out, h, races).filter(F.col("_end._n") == h)
    lt, ls = lambda x: x["high"] >= F.col("_tl"), lambda x: x["low"] <= F.col("_ll")
    st, ss = lambda x: x["low"] <= F.col("_ts"), lambda x: x["high"] >= F.col("_ls")

    def one_side(win, lose):
        if tie == "tp_first":
            return lambda x: F.when(win(x), "WIN").when(lose(x), "LOSE")
        return lambda x: F.when(lose(x), "LOSE").when(win(x), "WIN")

    def both(x):
        if tie == "ambiguous_neutral":
            bad = ls(x) | ss(x)
            return F.when(bad | (lt(x) & st(x)), "NEUTRAL").when(lt(x), "LONG").when(st(x), "SHORT")
        long, short = one_side(lt, ls)(x), one_side(st, ss)(x)
        return F.when(long.isNotNull(), F.when(long == "WIN", "LONG").otherwise("NEUTRAL")).when(short.isNotNull(), F.when(short == "WIN", "SHORT").otherwise("NEUTRAL"))

    def event(found: Column, fn: Callable[[Column], Column]) -> Column:
        return F.when(found.isNotNull(), F.struct(fn(found).alias("kind"), found["_n"].alias("bars")))

    if race == "coupled":
        out = out.withColumn("_e", event(F.col("_any"), both))
        label = F.when(F.col("_e.kind") == "LONG", LONG).when(F.col("_e.kind") == "SHORT", SHORT).otherwise(NEUTRAL)
        out = out.withColumns({"bias_label": label, "hit_bar": F.coalesce("_e.bars", F.lit(h))}).drop("_e")
    else:
        out = out.withColumns({"_l": event(F.col("_long"), one_side(lt, ls)), "_s": event(F.col("_short"), one_side(st, ss))})
        lw, sw = F.when(F.col("_l.kind") == "WIN", F.col("_l.bars")), F.when(F.col("_s.kind") == "WIN", F.col("_s.bars"))
        label = F.when(lw.isNotNull() & (sw.isNull() | (lw < sw)), LONG).when(sw.isNotNull() & (lw.isNull() | (sw < lw)), SHORT).otherwise(NEUTRAL)
        out = out.withColumns({"bias_label": label, "hit_bar": F.coalesce(F.least(lw, sw), F.lit(h))}).drop("_l", "_s")
    score = clip(1 - (F.col("hit_bar") - 1) / F.lit(float(max(h, 1))), 0.3, 1.0)
    return out.withColumn("event_score", F.when(F.col("bias_label") == NEUTRAL, 0.0).otherwise(score)).drop("_tl", "_ll", "_ts", "_ls", "_up", "_down", "_end", *races)


def ratio_soft_labels(df: DataFrame) -> DataFrame:
    """Soft labels from the event score against its mean over directional rows, with weights."""
    directional = F.col("bias_label") != NEUTRAL
    mean = df.agg(F.avg(F.when(directional, F.col("event_score"))).alias("_mean"))
    out = df.transform(beside, mean)  # one row
    part = F.col("event_score") / (F.coalesce("_mean", F.lit(0.0)) + 1e-9) * 0.5
    soft = F.when(F.col("bias_label") == LONG, clip(0.5 + part, 0.55, 1.0)).when(F.col("bias_label") == SHORT, clip(0.5 - part, 0.0, 0.45)).otherwise(0.5)
    out = out.withColumn("soft_label", soft).drop("_mean")
    far = F.abs(F.col("soft_label") - 0.5)
    usual = out.agg(F.avg(F.when(directional, far)).alias("_far"))
    out = out.transform(beside, usual)  # one row
    weight = F.when(~directional, 0.0).when(F.col("_far") <= 1e-9, 1.0).otherwise(clip(far / F.col("_far"), 0.25, 3.0))
    return out.withColumn("weight", weight).drop("_far")


def touch_summary(df: DataFrame) -> DataFrame:
    """One row: counts and shares of simulated labels, time to hit, distance of soft labels from a half."""
    directional = F.col("bias_label") != NEUTRAL
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    far = F.abs(F.col("soft_label") - 0.5)
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        one(F.col("bias_label") == LONG).alias("long"),
        one(F.col("bias_label") == SHORT).alias("short"),
        one(~directional).alias("neutral"),
        F.avg(F.when(directional, F.col("hit_bar"))).alias("mean_hit_time"),
        F.coalesce(F.avg(F.when(directional, F.col("event_score"))), F.lit(0.0)).alias("mean_event_score"),
        F.avg(far).alias("mean_abs_soft_dev"),
        F.avg((far >= 0.10).cast("double")).alias("pct_soft_extreme"),
    )
    return out.withColumns({"long_share": F.try_divide(F.col("long"), F.col("long") + F.col("short")), "event_rate": (F.col("long") + F.col("short")) / F.col("n_rows")})


def trend_filter(df: DataFrame, strict: bool = False, least: float = 0.05) -> DataFrame:
    """Labels against a strong trend (columns trend_label +1/-1/0, trend_strength) become neutral."""
    label, trend = F.col("bias_label"), F.col("trend_label")
    against = ((label == LONG) & (trend == -1)) | ((label == SHORT) & (trend == 1))
    drop = against & (F.col("trend_strength") >= least)
    if strict:
        drop = drop | ((label != NEUTRAL) & (trend == 0))
    return df.withColumn("bias_label", F.when(drop, NEUTRAL).otherwise(label))


def train_pool(df: DataFrame, strict: bool = True) -> DataFrame:
    """Directional rows; when strict only in a strong session with at least half the median ATR."""
    base = F.col("bias_label") != NEUTRAL
    if not strict:
        return df.withColumn("train_event_flag", base.cast("int"))
    q = exact_quantiles(df, {"_q": "atr_14"}, [0.5]).select(F.greatest(F.get("_q", 0) * 0.5, F.lit(1e-12)).alias("_floor"))
    out = df.transform(beside, q)  # one row
    keep = base & (F.col("strong_session") == 1) & (F.coalesce("atr_14", F.lit(0.0)) >= F.col("_floor"))
    return out.withColumn("train_event_flag", keep.cast("int")).drop("_floor")


def session_labels(rows: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Label of each (symbol, day, session) in columns symbol, trade_date, session.

    Barriers stand around the session's first price at 1.5 and 1 times the final exponentially
    weighted step. The weighted step is a sum of decayed steps, so it needs no loop: each step's
    weight follows from its distance to the session's end.
    """
    keys = ["symbol", "trade_date", "session"]
    rows = rows.select(*dict.fromkeys([*keys, *ORDER, "price"]))
    step = lambda df, w: df.withColumn("_r", F.abs(F.col("price") - F.lag("price").over(w)))
    decay = F.pow(F.lit(1 - alpha), (F.col("_last") - F.col("_i")).cast("double")) * F.when(F.col("_i") == 1, 1.0).otherwise(alpha)
    total = F.sum(F.col("_r") * decay)
    level = lambda m: F.when(F.col("_last") + 1 < 3, 0.001).otherwise(F.coalesce("_ema", F.lit(1e-8)) * m)
    ends = {"_last": F.max("_i"), "_open": F.min_by("price", "_i"), "_close": F.max_by("price", "_i")}
    if fits(rows, keys):  # one shuffle; there are nearly as many sessions as rows, so nothing is sent to all tasks
        whole = Window.partitionBy(*keys)
        out = numbered(step(rows, spec(keys, ORDER)), "_i", keys=keys)
        out = out.withColumns({n: c.over(whole) for n, c in ends.items()}).withColumn("_ema", F.greatest(total.over(whole), F.lit(1e-8)))
    else:
        out = numbered(windowed(rows, step, before=1, keys=keys), "_i", keys=keys)
        out = matched(out, out.groupBy(*keys).agg(*[c.alias(n) for n, c in ends.items()]), keys, salts=SALTS, spread=True)
        vol = out.groupBy(*keys).agg(F.greatest(total, F.lit(1e-8)).alias("_ema"))
        out = matched(out, vol, keys, salts=SALTS, spread=True)
    out = out.withColumns({"_tp": level(1.5), "_sl": level(1.0)})
    up, down = F.col("price") >= F.col("_open") + F.col("_tp"), F.col("price") <= F.col("_open") - F.col("_sl")
    hit = F.min_by(F.when(up, LONG).when(down, SHORT), F.when((F.col("_i") > 0) & (up | down), F.col("_i")))
    one = out.groupBy(*keys).agg(hit.alias("_hit"), *[F.max(c).alias(c) for c in ("_last", "_open", "_close", "_tp", "_sl")])
    move = F.col("_close") - F.col("_open")
    label = F.when(F.col("_last") < 1, NEUTRAL).otherwise(F.coalesce("_hit", F.when(move > F.col("_tp") * 0.5, LONG).when(move < -F.col("_sl") * 0.5, SHORT).otherwise(NEUTRAL)))
    return one.select(*keys, (F.col("_last") + 1).alias("rows"), F.col("_tp").alias("tp"), F.col("_sl").alias("sl"), label.alias("bias_label"))
