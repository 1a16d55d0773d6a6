"""Features of book snapshots: levels, order-flow imbalance, rolling statistics, flow since the last snapshot."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tapeloom.functions import book as B
from tapeloom.functions.market import is_trade, ratio
from tapeloom.operators.ordered import windowed
from tapeloom.operators.sliding import sliding

LEVELS = B.LEVELS
ROLLING = (5, 20, 50, 100)


def top_of_book(rows: DataFrame) -> DataFrame:
    """Mid, spread, microprice, depth and imbalances of each snapshot.

    Depths are columns before others use them, so each sum over the levels is taken once.
    """
    sums = {"bid_depth": B.depth("bid_sz"), "ask_depth": B.depth("ask_sz"), "_bids": B.weighted_depth("bid_sz"), "_asks": B.weighted_depth("ask_sz")}
    out = rows.withColumns({"mid_price": B.mid(), "spread": B.spread(), "microprice": B.microprice(), **sums})
    out = out.withColumns({"depth_imbalance": B.imbalance("bid_depth", "ask_depth"), "order_book_imbalance": B.imbalance("_bids", "_asks")})
    return out.withColumn("liquidity_pressure", B.pressure(F.col("order_book_imbalance"), F.col("spread"))).drop("_bids", "_asks")


def _side_flow(px: Column, sz: Column, prev_px: Column, prev_sz: Column, better: Column) -> Column:
    return F.when(better, sz).when(px == prev_px, sz - prev_sz).otherwise(-prev_sz)


def mlofi(levels: int, w: WindowSpec) -> Column:
    """Order-flow imbalance per level against the snapshot before; the first compares to itself."""
    prev = {c: F.coalesce(F.lag(c).over(w), F.col(c)) for c in ("bid_px", "bid_sz", "ask_px", "ask_sz")}
    out = []
    for i in range(levels):
        bp, bs, ap, as_ = (B.size_at(c, i) for c in ("bid_px", "bid_sz", "ask_px", "ask_sz"))
        pbp, pbs, pap, pas = (F.coalesce(F.get(prev[c], i), F.lit(0.0)) for c in ("bid_px", "bid_sz", "ask_px", "ask_sz"))
        out.append(_side_flow(bp, bs, pbp, pbs, bp > pbp) - _side_flow(ap, as_, pap, pas, ap < pap))
    return F.array(*out)


def with_mlofi(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    rows = windowed(rows, lambda df, w: df.withColumn("mlofi", mlofi(levels, w)), before=1)
    return rows.withColumns(
        {
            "mlofi_sum": reduce(add, [F.get("mlofi", i) for i in range(levels)]),
            "mlofi_top3": reduce(add, [F.get("mlofi", i) for i in range(min(3, levels))]),
        }
    )


def interval_flow(rows: DataFrame) -> DataFrame:
    """Flow since the previous snapshot, age of the flow state and time since the last snapshot."""
    pairs = {
        "mbo_signed_trade_size_since_prev_mbp": "mbo_cvd",
        "mbo_buy_trade_size_since_prev_mbp": "mbo_cum_buy_volume",
        "mbo_sell_trade_size_since_prev_mbp": "mbo_cum_sell_volume",
        "mbo_trade_count_since_prev_mbp": "mbo_cum_trade_count",
    }

    def since(df, w):
        t = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        return df.withColumns(
            {
                **{n: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for n, c in pairs.items()},
                "inter_event_time": F.greatest(F.coalesce((t("ts_event") - F.lag(t("ts_event")).over(w)) / 1e6, F.lit(0.0)), F.lit(0.0)),
                "mbo_state_age_ms": F.coalesce((t("ts_event") - t("mbo_state_ts")) / 1e3, F.lit(-1.0)),
                "mbo_cvd_momentum_20": F.col("mbo_cvd") - F.first("mbo_cvd").over(w.rowsBetween(-20, 0)),
            }
        )

    return windowed(rows, since, before=20)


def price_change(rows: DataFrame, tick: float) -> DataFrame:
    def change(df, w):
        prev = F.lag("mid_price").over(w)
        return df.withColumns(
            {
                "price_change": F.coalesce(F.col("mid_price") - prev, F.lit(0.0)),
                "return_1": F.coalesce(ratio(F.col("mid_price"), prev) - 1, F.lit(0.0)),
                "tick_return_1": F.coalesce((F.col("mid_price") - prev) / tick, F.lit(0.0)),
            }
        )

    return windowed(rows, change, before=1)


def rolling(rows: DataFrame, tick: float, frames: tuple[int, ...] = ROLLING, also: dict[str, tuple[str, str, int]] | None = None) -> DataFrame:
    """Means, volatilities and sums over the last n snapshots; short frames give the default.

    ``also``: frames of `sliding` that the same pass adds.
    """

    means = {"rolling_return_mean": "return_1", "rolling_obi_mean": "order_book_imbalance", "rolling_depth_imbalance_mean": "depth_imbalance"}
    if "mlofi_sum" in rows.columns:
        means["rolling_mlofi_sum_mean"] = "mlofi_sum"
    wanted, shown = dict(also or {}), {}
    for n in frames:
        least = min(max(2, n // 4), n)
        wanted.update({f"_rows_{n}": ("rows", "spread", n), f"_spreads_{n}": ("count", "spread", n), f"realized_vol_{n}": ("std", "_moved", n)})
        wanted.update({f"rolling_spread_{kind}_{n}": (kind, "spread", n) for kind in ("mean", "std")})
        wanted.update({f"{name}_{n}": ("mean", c, n) for name, c in means.items()})
        if "mbo_trade_count_since_prev_mbp" in rows.columns:
            wanted[f"rolling_trade_count_{n}"] = ("sum", "mbo_trade_count_since_prev_mbp", n)
        full = F.col(f"_rows_{n}") >= least
        shown[f"rolling_return_mean_{n}"] = F.when(full, F.col(f"rolling_return_mean_{n}")).otherwise(0.0)
        shown[f"realized_vol_{n}"] = F.when(full, F.col(f"realized_vol_{n}")).otherwise(F.lit(tick))
        shown[f"rolling_spread_mean_{n}"] = F.coalesce(f"rolling_spread_mean_{n}", F.lit(0.0))
        shown[f"rolling_spread_std_{n}"] = F.coalesce(F.when(F.col(f"_spreads_{n}") >= least, F.col(f"rolling_spread_std_{n}")), F.lit(0.0))

    out = sliding(rows.withColumn("_moved", F.abs("price_change")), wanted).withColumns(shown)
    out = out.drop("_moved", *[c for c in wanted if c.startswith(("_rows_", "_spreads_"))])
    if 50 in frames:
        out = out.withColumn("realized_vol", F.col("realized_vol_50"))
    return out


def clock_features(rows: DataFrame) -> DataFrame:
    """Hour, minute, weekday (Monday 0), minute-of-day angle and session flags."""
    minute = F.hour("ts_event") * 60 + F.minute("ts_event")
    angle = minute * (2 * 3.141592653589793 / 1440.0)
    flag = lambda lo, hi: ((minute >= lo * 60) & (minute < hi * 60)).cast("int")
    return rows.withColumns(
        {
            "hour": F.hour("ts_event"),
            "minute": F.minute("ts_event"),
            "second": F.second("ts_event"),
            "day_of_week": F.weekday("ts_event"),
            "minute_of_day": minute,
            "hour_sin": F.sin(angle),
            "hour_cos": F.cos(angle),
            "london_active": flag(8, 13),
            "ny_active": flag(13, 21),
            "overlap_active": flag(13, 16),
        }
    )


# Hours (UTC) of the older session table, [from, to), and codes in order of priority.
SESSION_HOURS = {"asia": (0, 8), "london": (7, 16), "ny": (13, 22), "overlap": (13, 16)}
SESSION_CODES = {"asia": 0, "london": 1, "ny": 2, "overlap": 3, "off": 4}


def session_flags(rows: DataFrame) -> DataFrame:
    """Flags of the sessions that are open, the code of the most important one, and hour and minute on a circle."""
    hour, minute = F.hour("ts_event"), F.minute("ts_event")
    flags = {f"session_{n}": ((hour >= a) & (hour < b)).cast("int") for n, (a, b) in SESSION_HOURS.items()}
    code = F.lit(SESSION_CODES["off"])
    for name in ("asia", "london", "ny", "overlap"):
        code = F.when(flags[f"session_{name}"] == 1, SESSION_CODES[name]).otherwise(code)
    turn = lambda value, n: value * (2 * 3.141592653589793 / n)
    return rows.withColumns(
        {
            **flags,
            "session_off": (code == SESSION_CODES["off"]).cast("int"),
            "session_label": code,
            "hour_sin": F.sin(turn(hour, 24.0)),
            "hour_cos": F.cos(turn(hour, 24.0)),
            "minute_sin": F.sin(turn(minute, 60.0)),
            "minute_cos": F.cos(turn(minute, 60.0)),
        }
    )


def level_features(rows: DataFrame, tick: float) -> DataFrame:
    """Per level: sizes, imbalance and distances from the mid in ticks, as arrays."""
    m = B.mid()
    return rows.withColumns(
        {
            "level_imbalance": B.level_imbalance(),
            "bid_distance_ticks": F.transform("bid_px", lambda p: F.coalesce((m - p) / tick, F.lit(0.0))),
            "ask_distance_ticks": F.transform("ask_px", lambda p: F.coalesce((p - m) / tick, F.lit(0.0))),
        }
    )


# Feature names an older model reads. Those without a formula are 0 and no feature.
COMPAT_ZERO = [
    "absorption_intensity",
    "cancel_ratio",
    "spoofing_ratio",
    "spoofing_duration",
    "liquidity_trap",
    "bid_wall_strength",
    "ask_wall_strength",
    "distance_to_wall",
    "gap_size",
    "fisher_signal",
    "anomaly",
    "correction_depth",
    "pdh",
    "pdl",
    "dist_to_pdh",
    "price_position",
    "vwap_z_score",
    "cvd_prev_session",
    "cvd_session_open_delta",
    "cvd_session_zscore_causal",
    "cvd_velocity_norm_by_volume",
    "cvd_slope_3b",
]


def cvd_step(rows: DataFrame) -> DataFrame:
    """Add ``_cvd_step``, the change of the running flow since the snapshot before."""
    return windowed(rows, lambda df, w: df.withColumn("_cvd_step", F.coalesce(F.col("mbo_cvd") - F.lag("mbo_cvd").over(w), F.lit(0.0))), before=1)


def compat_features(rows: DataFrame, tick: float, stepped: bool = False) -> DataFrame:
    """Columns an older model expects, from the ones here; ``raw__`` twins hold unscaled copies.

    ``stepped``: the rows have been through `cvd_step`.
    """
    c = F.col
    total = c("bid_depth") + c("ask_depth")
    vnet, change = c("mbo_signed_trade_size_since_prev_mbp"), c("price_change")

    out = (rows if stepped else cvd_step(rows)).withColumns(
        {
            "cvd": c("mbo_cvd"),
            "obi": c("order_book_imbalance"),
            "micro_price": F.coalesce("microprice", "mid_price"),
            "lob_depth_imbalance": c("depth_imbalance"),
            "micro_atr": c("realized_vol"),
            "volume_burst": c("mbo_trade_count_since_prev_mbp").cast("double"),
            "liquidity_density": total / F.greatest(F.coalesce(c("spread") / tick, F.lit(0.0)), F.lit(1.0)),
            "vnet": vnet,
            "cvd_momentum": c("mbo_cvd_momentum_20"),
            "cvd_price_divergence": c("_cvd_step") * F.signum(change),
            "trend_strength": c("rolling_return_mean_20") / F.greatest("realized_vol_20", F.lit(tick)),
            "liquidity_sweep": F.abs("mlofi_top3") / F.greatest(total, F.lit(1.0)),
            "kyle_lambda": F.abs(change) / F.greatest(F.abs(vnet), F.lit(1.0)),
            "hawkes_intensity": c("rolling_trade_count_20"),
            "liq_score": 1.0 / F.greatest(F.coalesce(c("spread"), F.lit(tick)), F.lit(tick)),
        }
    ).drop("_cvd_step")
    return out.withColumns({n: F.lit(0.0) for n in COMPAT_ZERO})


def raw_twins(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumns({f"raw__{n}": F.col(n) for n in names})


def compat_placeholders() -> list[str]:
    """Columns that must not count as features."""
    return sorted([n for n in COMPAT_ZERO] + [f"raw__{n}" for n in COMPAT_ZERO])


def wall_features(rows: DataFrame, tick: float, frame: int = 200, multiple: float = 3.0) -> DataFrame:
    """First wall on each side against the mean level size of the last snapshots, and the first soft gap."""

    def means(df, w):
        return df.withColumn("mean_level_size", F.greatest(F.avg(B.mean_size()).over(w.rowsBetween(-(frame - 1), 0)), F.lit(1e-9)))

    rows = windowed(rows, means, before=frame)
    mean, m = F.col("mean_level_size"), B.mid()
    bid, ask = B.first_wall("bid_px", "bid_sz", mean, multiple), B.first_wall("ask_px", "ask_sz", mean, multiple)
    rows = rows.withColumns({"_bw": bid, "_aw": ask})
    near = [F.when(d > 0, d) for d in ((m - F.col("_bw.px")) / tick, (F.col("_aw.px") - m) / tick)]
    gaps = [B.first_soft_gap(px, sz, mean, tick) for px, sz in (("bid_px", "bid_sz"), ("ask_px", "ask_sz"))]
    return rows.withColumns(
        {
            "bid_wall_strength": F.coalesce(F.col("_bw.sz") / mean, F.lit(0.0)),
            "ask_wall_strength": F.coalesce(F.col("_aw.sz") / mean, F.lit(0.0)),
            "distance_to_wall": F.coalesce(F.least(*near), F.lit(0.0)),
            "gap_size": F.greatest(*gaps),
        }
    ).drop("_bw", "_aw")


def gap_means(rows: DataFrame, tick: float, frame: int = 50) -> DataFrame:
    """Mean gap share of the last snapshots."""
    rows = rows.withColumn("_gap", B.gap_count(tick))
    return windowed(rows, lambda df, w: df.withColumn("liquidity_gaps", F.avg("_gap").over(w.rowsBetween(-(frame - 1), 0))), before=frame).drop("_gap")


def spoofing(rows: DataFrame, base: int = 200, frame: int = 50) -> DataFrame:
    """Cancels that take more than 1.5 usual best-level sizes out of the top three levels.

    Needs ``action`` beside the book. Gives their number per trade and their mean magnitude.
    """
    top = lambda c: B.depth(c, 3)

    def mark(df, w):
        before, past = lambda c: F.coalesce(F.lag(c).over(w), c), w.rowsBetween(-base, -1)
        best = (B.size_at("bid_sz", 0) + B.size_at("ask_sz", 0)) / 2
        best = F.when(best > 0, best)
        usual = F.greatest(F.coalesce(F.avg(best).over(past), best, F.lit(1.0)), F.lit(1e-9))
        drop = F.greatest(before(top("bid_sz")) - top("bid_sz"), before(top("ask_sz")) - top("ask_sz"), F.lit(0.0))
        return df.withColumns({"_usual": usual, "_drop": drop})

    rows = windowed(rows, mark, before=base)
    spoof = (F.upper("action") == "C") & (F.col("_drop") > F.col("_usual") * 1.5)
    rows = rows.withColumns({"_spoof": spoof.cast("int"), "_size": F.when(spoof, F.col("_drop") / F.col("_usual")).otherwise(0.0)})

    def rates(df, w):
        recent = w.rowsBetween(-(frame - 1), 0)
        trades = F.greatest(F.sum(is_trade().cast("int")).over(recent), F.lit(1))
        return df.withColumns(
            {
                "spoofing_ratio": F.least(F.sum("_spoof").over(recent) / trades, F.lit(1.0)),
                "spoofing_duration": F.avg("_size").over(recent),
            }
        )

    return windowed(rows, rates, before=frame).drop("_usual", "_drop", "_spoof", "_size")


def gap_scores(rows: DataFrame, tick: float, frame: int = 50) -> DataFrame:
    """Gap score of a snapshot and its mean over the last ones (itself while there are under 3)."""
    rows = rows.withColumn("gap_now", B.gap_score(tick))

    def mean(df, w):
        recent = w.rowsBetween(-(frame - 1), 0)
        return df.withColumn("gap_score", F.when(F.count("gap_now").over(recent) >= 3, F.avg("gap_now").over(recent)).otherwise(F.col("gap_now")))

    return windowed(rows, mean, before=frame)


def past_stats(rows: DataFrame, columns: list[str], frame: int = 50) -> DataFrame:
    """Mean and sample deviation of the rows before, without the row itself."""

    def stats(df, w):
        prior, out = w.rowsBetween(-frame, -1), {}
        for name in columns:
            out[f"{name}_mean"] = F.avg(name).over(prior)
            out[f"{name}_std"] = F.stddev_samp(name).over(prior)
        return df.withColumns(out)

    return windowed(rows, stats, before=frame)


def change_triple(rows: DataFrame, columns: list[str], frame: int = 20) -> DataFrame:
    """Change, z-score and mean of each column over the last rows."""

    def triple(df, w):
        recent, out = w.rowsBetween(-(frame - 1), 0), {}
        for name in columns:
            mean, std = F.avg(name).over(recent), F.stddev_samp(name).over(recent)
            out[f"{name}_diff"] = F.coalesce(F.col(name) - F.lag(name).over(w), F.lit(0.0))
            out[f"{name}_zscore"] = F.coalesce((F.col(name) - mean) / F.when(std == 0, 1e-9).otherwise(std), F.lit(0.0))
            out[f"{name}_rmean"] = mean
        return df.withColumns(out)

    return windowed(rows, triple, before=frame)
