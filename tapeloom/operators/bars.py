"""Time bars and features of bars.

Bars are sums, extremes and first/last values by (symbol, bar), which combine before the shuffle,
so a hot symbol costs one partial row per task and bar. Windows over bars need no skew guard: a
symbol has at most one bar per time step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import book as B
from tapeloom.functions.market import clip, deadband_sign, finite, is_buy, is_sell, is_trade, ratio, signed_size
from tapeloom.operators.ordered import SALTS, matched, running, windowed

BAR_KEYS = ["symbol", "bar_ts"]
BAR_ORDER = ["bar_ts"]


def with_bar(df: DataFrame, freq: str, ts: str = "ts_event") -> DataFrame:
    return df.withColumn("bar_ts", F.window(ts, freq)["start"])


def moment() -> Column:
    """Time and sequence as one number. Unlike a struct it can be updated in a hash table, so that
    first and last values need no sort before the partial aggregation."""
    micros = F.unix_micros(F.col("ts_event").cast("timestamp")).cast("decimal(19,0)")
    return (micros * F.lit(10**18).cast("decimal(19,0)") + F.coalesce("sequence", F.lit(0)).cast("decimal(19,0)")).cast("decimal(38,0)")


def at_first(c: str | Column) -> Column:
    return F.min_by(c, moment())


def at_last(c: str | Column) -> Column:
    return F.max_by(c, moment())


def bar_window():
    return Window.partitionBy("symbol").orderBy("bar_ts")


def rows_back(n: int):
    return bar_window().rowsBetween(-(n - 1), 0)


def price_bars(df: DataFrame, freq: str, price: str = "price", size: str | None = "size", count: str = "tick_count", extra: dict[str, Column] | None = None) -> DataFrame:
    """Open, high, low, close, volume and count of the rows with a positive price."""
    volume = F.sum(F.greatest(F.coalesce(F.col(size).cast("double"), F.lit(0.0)), F.lit(0.0))) if size else F.lit(0.0)
    rows = with_bar(df.filter(F.col(price) > 0), freq)
    return rows.groupBy(*BAR_KEYS).agg(
        at_first(price).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        at_last(price).alias("close"),
        volume.alias("volume"),
        F.count(F.lit(1)).alias(count),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )


def trade_bars(ticks: DataFrame, freq: str) -> DataFrame:
    """Bars of trades with the buyers' and sellers' volume."""
    size = F.greatest(F.coalesce(F.col("size").cast("double"), F.lit(0.0)), F.lit(0.0))
    side = {
        "buy_volume": F.sum(F.when(is_buy(), size).otherwise(0.0)),
        "sell_volume": F.sum(F.when(is_sell(), size).otherwise(0.0)),
    }
    bars = price_bars(ticks.filter(is_trade()), freq, extra=side)
    return bars.withColumn("buy_ratio", F.coalesce(ratio(F.col("buy_volume"), F.col("buy_volume") + F.col("sell_volume")), F.lit(0.5)))


def mid_bars(snapshots: DataFrame, freq: str) -> DataFrame:
    """Bars of the mid price with the snapshot count and the mean valid spread."""
    rows = snapshots.withColumns({"mid_price": B.mid(), "spread": B.spread()})
    return price_bars(rows, freq, price="mid_price", size=None, count="snapshot_count", extra={"avg_spread": F.avg("spread")})


def combine_bars(trades: DataFrame, mids: DataFrame) -> DataFrame:
    """All bars of both feeds; traded prices win over mid prices."""
    t, m = trades.alias("t"), mids.alias("m")
    out = t.join(m, BAR_KEYS, "full")
    zero = F.lit(0.0)
    return out.select(
        *BAR_KEYS,
        *[F.coalesce(f"t.{c}", f"m.{c}").alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce("t.volume", zero).alias("volume"),
        F.coalesce("t.tick_count", F.lit(0)).alias("tick_count"),
        F.coalesce("m.snapshot_count", F.lit(0)).alias("snapshot_count"),
        F.coalesce("t.buy_volume", zero).alias("buy_volume"),
        F.coalesce("t.sell_volume", zero).alias("sell_volume"),
        F.coalesce("t.buy_ratio", F.lit(0.5)).alias("buy_ratio"),
        F.col("m.avg_spread").alias("avg_spread"),
        F.when(F.col("t.open").isNotNull(), "MBO").otherwise("MBP").alias("source"),
    )


def true_range() -> Column:
    prev = F.lag("close").over(bar_window())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def with_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return bars.withColumn("_tr", true_range()).withColumn(f"atr_{n}", F.avg("_tr").over(rows_back(n))).drop("_tr")


def threshold_features(ticks: DataFrame, snapshots: DataFrame, freq: str) -> DataFrame:
    bars = with_atr(combine_bars(trade_bars(ticks, freq), mid_bars(snapshots, freq)))
    return bars.withColumn("price", F.col("close"))


def with_cvd(ticks: DataFrame) -> DataFrame:
    """Add the signed trade size and its running totals, over all time and since midnight."""
    rows = ticks.withColumns({"signed": signed_size(), "trade_date": F.to_date("ts_event")})
    rows = running(rows, {"cvd": ("sum", "signed")})
    before = running(rows.select("symbol", "trade_date", "signed", "ts_event", "sequence").groupBy("symbol", "trade_date").agg(F.sum("signed").alias("_day")), {"_open_cvd": ("sum", "_day")}, order=["trade_date"], exclusive=True, check=False)
    rows = matched(rows, before.select("symbol", "trade_date", "_open_cvd"), ["symbol", "trade_date"], salts=SALTS)
    return rows.withColumn("session_cvd", F.col("cvd") - F.coalesce("_open_cvd", F.lit(0.0))).drop("_open_cvd")


def _how(c: Column, how: str) -> Column:
    return {
        "last": lambda: F.max_by(c, F.when(c.isNotNull(), moment())),
        "mean": lambda: F.avg(c),
        "max": lambda: F.max(c),
        "sum": lambda: F.sum(c),
        "std": lambda: F.stddev_samp(c),
        "absmax": lambda: F.max_by(c, F.when(c.isNotNull(), F.struct(F.abs(c).alias("a"), (-F.unix_micros(F.col("ts_event").cast("timestamp"))).alias("t"), (-F.col("sequence")).alias("s")))),
    }[how]()


def rich_bars(ticks: DataFrame, freq: str, features: dict[str, tuple[str, str]]) -> DataFrame:
    """One wide aggregate per bar over ticks that carry cvd, session_cvd and feature columns.

    ``features`` maps an output name to (column, how), how being one of last, mean, max, sum, std,
    absmax. Bars without trades are dropped.
    """
    traded = is_trade() & (F.col("price") > 0) & (F.col("size") > 0)
    price, size = F.when(traded, F.col("price")), F.when(traded, F.col("size").cast("double")).otherwise(0.0)
    key = F.when(price.isNotNull(), moment())
    moved = at_last("cvd") - at_first("cvd")
    bars = with_bar(ticks, freq).groupBy(*BAR_KEYS).agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.sum(size).alias("volume"),
        F.sum(F.coalesce(price, F.lit(0.0)) * size).alias("_turnover"),
        F.sum(F.when(traded & is_buy(), size).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(traded & is_sell(), size).otherwise(0.0)).alias("sell_volume"),
        F.count(price).alias("tick_count"),
        F.count(F.lit(1)).alias("_rows"),
        at_last("cvd").alias("cvd"),
        moved.alias("bar_cvd_delta"),
        at_last("session_cvd").alias("session_cvd"),
        *[F.coalesce(_how(F.col(c), how), F.lit(0.0)).alias(name) for name, (c, how) in features.items()],
    )
    bars = bars.filter("volume > 0")
    total = F.col("buy_volume") + F.col("sell_volume")
    return bars.withColumns(
        {
            "micro_price": F.col("_turnover") / F.greatest("volume", F.lit(1e-9)),
            "buy_ratio": F.col("buy_volume") / F.greatest(total, F.lit(1.0)),
            "cvd_velocity": F.col("bar_cvd_delta") / F.col("_rows"),
            "cvd_net_direction": deadband_sign(F.col("bar_cvd_delta"), 1.0),
        }
    ).drop("_turnover", "_rows")


def liquidity_columns(bars: DataFrame) -> DataFrame:
    """Trade count, mean trade size and order-flow imbalance of a bar."""
    trades = F.greatest(F.col("tick_count").cast("double"), F.lit(1.0))
    total = F.greatest(F.col("buy_volume") + F.col("sell_volume"), F.lit(1e-9))
    return bars.withColumns(
        {
            "num_trades": trades,
            "avg_trade_size": F.col("volume") / trades,
            "absorption_bar": clip(F.col("buy_ratio"), 0, 1),
            "order_flow_imbalance": clip((F.col("buy_volume") - F.col("sell_volume")) / total, -1, 1),
        }
    )


def sign_reversals(rows: DataFrame, freq: str, column: str) -> DataFrame:
    """How often a column changes sign inside each bar."""

    def flips(df, w):
        now, prev = F.signum(F.coalesce(F.col(column), F.lit(0.0))), F.lag(F.signum(F.coalesce(F.col(column), F.lit(0.0)))).over(w)
        same_bar = F.lag("bar_ts").over(w) == F.col("bar_ts")
        return df.withColumn("_flip", F.when(same_bar & (now != prev), 1).otherwise(0))

    marked = windowed(with_bar(rows, freq), flips, before=1)
    return marked.groupBy(*BAR_KEYS).agg(F.sum("_flip").alias("reversals"))


def _slice_id(freq_seconds: int, slices: int) -> Column:
    micros = F.unix_micros(F.col("ts_event").cast("timestamp")) - F.unix_micros(F.col("bar_ts").cast("timestamp"))
    width = freq_seconds * 1_000_000 // slices
    return F.least(F.floor(micros / F.lit(width)), F.lit(slices - 1)).cast("int")


class _Slices:
    """Statistics over the slices of a bar where slices without rows count as 0."""

    def __init__(self, slices: int):
        self.n = slices
        self.missing = F.lit(slices) - F.count(F.lit(1))

    def top(self, c: str) -> Column:
        return F.greatest(F.max(c), F.when(self.missing > 0, 0.0))

    def mean(self, c: str) -> Column:
        return F.sum(c) / F.lit(float(self.n))

    def std(self, c: str) -> Column:
        here = F.count(F.lit(1))
        between = F.avg(c) * F.avg(c) * here * self.missing / F.lit(float(self.n))
        return F.sqrt((F.var_pop(c) * here + between) / F.lit(float(self.n)))

    def variation(self, c: str) -> Column:
        m = F.abs(self.mean(c))
        return F.when(m < 1e-12, F.lit(0.0)).otherwise(self.std(c) / (m + 1e-12))

    def agreement(self, c: str) -> Column:
        """Share of non-zero slices whose sign is the more common one."""
        plus, minus = (F.sum(F.when(t, 1).otherwise(0)) for t in (F.col(c) > 0, F.col(c) < 0))
        return F.coalesce(F.try_divide(F.greatest(plus, minus).cast("double"), (plus + minus).cast("double")), F.lit(0.0))

    def part(self, c: str, first: int, last: int) -> Column:
        """Sum over the slices from ``first`` to before ``last``."""
        return F.sum(F.when((F.col("slice") >= first) & (F.col("slice") < last), F.col(c)).otherwise(0.0))


def intrabar_slices(ticks: DataFrame, freq_seconds: int, slices: int = 12) -> DataFrame:
    """Cut each bar in equal time slices and describe how its activity spreads over them.

    Needs columns spoofing_ratio, cancel_ratio, absorption_intensity and cvd. Two aggregations:
    by slice, then by bar.
    """
    size = F.col("size").cast("double")
    flow = F.when(is_buy() & (size != 0), 1.0).when(is_sell() & (size != 0), 1.0).otherwise(0.0)  # |signed flow| of one tick
    rows = with_bar(ticks, f"{freq_seconds} seconds").withColumn("slice", _slice_id(freq_seconds, slices))
    parts = rows.groupBy(*BAR_KEYS, "slice").agg(
        F.max("spoofing_ratio").alias("spoof"),
        F.max("cancel_ratio").alias("cancel"),
        F.avg("absorption_intensity").alias("absorb"),
        F.max(flow).alias("ofi"),
        (at_last("cvd") - at_first("cvd")).alias("cvd_d"),
        F.avg(size).alias("size_m"),
    )
    of, cut, k = _Slices(slices), _thirds(slices), max(1, slices // 3)
    bars = parts.groupBy(*BAR_KEYS).agg(
        of.top("spoof").alias("spoof_peak_slice"),
        of.mean("spoof").alias("_spoof"),
        of.top("cancel").alias("cancel_burst"),
        of.variation("absorb").alias("absorption_speed"),
        of.top("absorb").alias("absorption_slice_max"),
        *[(of.part("absorb", c.start, c.stop) / F.lit(float(max(len(c), 1)))).alias(f"_t{i}") for i, c in enumerate(cut)],
        (F.max(F.abs("cvd_d")) / F.lit(freq_seconds / slices)).alias("cvd_velocity_max"),
        of.agreement("cvd_d").alias("cvd_direction_pct"),
        of.part("cvd_d", 0, k).alias("_early"),
        of.part("cvd_d", slices - k, slices).alias("_late"),
        of.top("ofi").alias("ofi_peak_slice"),
        of.variation("size_m").alias("size_dispersion"),
    )
    t0, t1, t2 = (F.col(f"_t{i}") for i in range(3))
    near = lambda a: F.abs(a - t0) <= 1e-6 + 1e-5 * F.abs(t0)
    best = F.greatest(t0, t1, t2)
    burst = (F.col("_spoof") > 1e-9) & (F.col("spoof_peak_slice") >= 2 * F.col("_spoof"))
    return bars.withColumns(
        {
            "spoof_burst_flag": burst.cast("int"),
            "pressure_phase": F.when(near(t1) & near(t2), "uniform").when(t0 == best, "early").when(t1 == best, "mid").otherwise("late"),
            "cvd_early_vs_late": (F.col("_early") - F.col("_late")) / (F.abs("_early") + F.abs("_late") + 1e-9),
        }
    ).drop("_spoof", "_t0", "_t1", "_t2", "_early", "_late")


def _thirds(slices: int) -> list[range]:
    base, extra = divmod(slices, 3)
    out, at = [], 0
    for i in range(3):
        n = base + (1 if i < extra else 0)
        out.append(range(at, at + n))
        at += n
    return out


def intrabar_book(snapshots: DataFrame, freq_seconds: int, slices: int = 12) -> DataFrame:
    """Spread, depth, imbalance, walls and depth slopes of the book over the slices of a bar."""
    rows = with_bar(snapshots, f"{freq_seconds} seconds").withColumn("slice", _slice_id(freq_seconds, slices))
    b0, a0 = B.level("bid_px", 0), B.level("ask_px", 0)
    bs, as_ = B.size_at("bid_sz", 0), B.size_at("ask_sz", 0)
    mid = (a0 + b0) / 2
    rows = rows.withColumns({"bd": B.depth("bid_sz"), "ad": B.depth("ask_sz")}).withColumns(
        {
            "spr": F.greatest(a0 - b0, F.lit(0.0)),
            "imb": F.coalesce(ratio(F.col("bd") - F.col("ad"), F.col("bd") + F.col("ad")), F.lit(0.0)),
            "dev": F.abs(F.coalesce(ratio(a0 * bs + b0 * as_, bs + as_), mid) - mid),
            "bw": F.coalesce(ratio(bs, F.col("bd")), F.lit(0.0)),
            "aw": F.coalesce(ratio(as_, F.col("ad")), F.lit(0.0)),
        }
    )

    in_slice = ["symbol", "bar_ts", "slice"]
    rows = running(rows, {"_pos": ("count", F.lit(1))}, keys=in_slice)
    change = (at_last("bd") - at_first("bd")) - (at_last("ad") - at_first("ad"))
    parts = rows.groupBy(*in_slice).agg(
        F.max("spr").alias("sp"),
        F.avg("imb").alias("im"),
        F.max("bd").alias("bdm"),
        F.max("ad").alias("adm"),
        F.max("dev").alias("mp"),
        F.max("bw").alias("bwm"),
        F.max("aw").alias("awm"),
        F.coalesce(F.regr_slope("bd", "_pos"), F.lit(0.0)).alias("bsl"),
        F.coalesce(F.regr_slope("ad", "_pos"), F.lit(0.0)).alias("asl"),
        change.alias("chg"),
    )
    of, both = _Slices(slices), F.col("bdm") + F.col("adm")
    bars = parts.groupBy(*BAR_KEYS).agg(
        of.top("sp").alias("mbp_spread_max"),
        of.mean("sp").alias("mbp_spread_mean"),
        of.std("sp").alias("mbp_spread_std"),
        of.top("bdm").alias("mbp_depth_bid_max"),
        of.top("adm").alias("mbp_depth_ask_max"),
        F.max(both).alias("mbp_depth_sum_max"),
        (F.sum(both) / F.lit(float(slices))).alias("_depth"),
        F.max_by("im", F.struct(F.abs("im"), -F.col("slice"))).alias("mbp_imbalance_signed_peak"),
        of.mean("im").alias("mbp_imbalance_mean"),
        of.agreement("im").alias("mbp_imbalance_direction_pct"),
        of.top("mp").alias("mbp_microprice_dev_max"),
        of.top("bwm").alias("mbp_wall_bid_peak"),
        of.top("awm").alias("mbp_wall_ask_peak"),
        F.avg("bsl").alias("mbp_bid_slope_intrabar"),
        F.avg("asl").alias("mbp_ask_slope_intrabar"),
        F.avg("chg").alias("mbp_depth_accel"),
    )
    shock = (F.col("_depth") > 1e-9) & (F.col("mbp_depth_sum_max") >= 2 * F.col("_depth"))
    return bars.withColumns({"mbp_imbalance_peak": F.abs("mbp_imbalance_signed_peak"), "mbp_depth_shock_flag": shock.cast("int")}).drop("_depth")


def book_coverage(bars: DataFrame, snapshots: DataFrame, freq_seconds: int, expected_seconds: float = 0.5) -> DataFrame:
    """Share of the expected snapshots that each bar holds."""
    counts = with_bar(snapshots, f"{freq_seconds} seconds").groupBy(*BAR_KEYS).agg(F.count(F.lit(1)).alias("_n"))
    slots = max(freq_seconds / max(expected_seconds, 1e-6), 1.0)
    out = bars.join(counts, BAR_KEYS, "left")
    return out.withColumn("mbp_bar_coverage", clip(F.coalesce("_n", F.lit(0)) / F.lit(slots), 0, 1)).drop("_n")


def technicals(bars: DataFrame, short: int = 6, micro: int = 3, hours: dict[str, int] | None = None) -> DataFrame:
    """Range, body, ATR, RSI, returns, volume ratios, CVD slopes and VWAP distance of bars."""
    w = bar_window()
    change = F.col("close") - F.lag("close").over(w)
    out = with_atr(bars).withColumns(
        {
            "bar_range": F.col("high") - F.col("low"),
            "_gain": F.when(change > 0, change).when(change.isNotNull(), 0.0),
            "_loss": F.when(change < 0, -change).when(change.isNotNull(), 0.0),
        }
    )
    gain, loss = F.avg("_gain").over(rows_back(14)), F.avg("_loss").over(rows_back(14))
    out = out.withColumns(
        {
            "body_ratio": clip(F.abs(F.col("close") - F.col("open")) / F.greatest(F.col("bar_range"), F.lit(1e-8)), 0, 1),
            "rsi_14": F.coalesce(clip(100 - 100 / (1 + gain / F.greatest(loss, F.lit(1e-8))), 0, 100), F.lit(0.0)),
            "cvd_slope_3b": F.coalesce((F.col("cvd") - F.lag("cvd", micro).over(w)) / F.lit(float(micro)), F.lit(0.0)),
            "vwap_dist": (F.col("close") - F.col("micro_price")) / F.greatest("micro_price", F.lit(1e-8)),
            "cvd_velocity_norm_by_volume": clip(F.col("bar_cvd_delta") / F.greatest("volume", F.lit(1.0)), -1, 1),
        }
    )
    for label, n in {"6b": short, **(hours or {})}.items():
        out = out.withColumns(
            {
                f"return_{label}": F.coalesce(F.col("close") / F.lag("close", n).over(w) - 1, F.lit(0.0)),
                f"volume_ratio_{label}": F.col("volume") / F.greatest(F.avg("volume").over(rows_back(n)), F.lit(1.0)),
                f"cvd_slope_{label}": F.coalesce((F.col("cvd") - F.lag("cvd", n).over(w)) / F.lit(float(n)), F.lit(0.0)),
            }
        )
    return out.drop("_gain", "_loss")


def trading_session() -> Column:
    """Session of a bar by its start, in UTC."""
    minute = F.hour("bar_ts") * 60 + F.minute("bar_ts")
    return (
        F.when((minute >= 420) & (minute < 720), "london")
        .when((minute >= 720) & (minute < 810), "overlap")
        .when((minute >= 810) & (minute < 1200), "ny")
        .otherwise("asia")
    )


def session_run_cvd(bars: DataFrame) -> DataFrame:
    """CVD against the session's open and the previous session's close, and its causal z-score."""
    w = bar_window()
    out = bars.withColumn("session", trading_session())
    out = out.withColumn("_new", F.when(F.col("session") != F.lag("session").over(w), 1).otherwise(0))
    out = out.withColumn("run", F.sum("_new").over(w))
    inside = Window.partitionBy("symbol", "run").orderBy("bar_ts")
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_prev", F.when(F.col("_new") == 1, F.lag("cvd").over(w)))
    out = out.withColumns(
        {
            "cvd_prev_session": F.coalesce(F.last("_prev", ignorenulls=True).over(w), F.lit(0.0)),
            "cvd_session_open_delta": F.col("cvd") - F.first("cvd").over(inside),
        }
    )
    n, delta = F.count(F.lit(1)).over(prior), F.col("cvd_session_open_delta")
    deviation = F.when(n >= 3, F.stddev_samp(delta).over(prior))
    z = ratio(delta - F.avg(delta).over(prior), F.when(deviation > 1e-12, deviation))
    return out.withColumn("cvd_session_zscore_causal", F.coalesce(z, F.lit(0.0))).drop("_new", "_prev")


def depth_source(bars: DataFrame) -> DataFrame:
    """Take the signed book imbalance where the book covers the bar, else the trade-flow proxy."""
    flow = F.coalesce(clip(F.col("order_flow_imbalance"), -1, 1), F.lit(0.0))
    book = F.coalesce(clip(F.col("mbp_imbalance_signed_peak"), -1, 1), F.lit(0.0))
    covered = F.coalesce("mbp_bar_coverage", F.lit(0.0)) > 0
    return bars.withColumns(
        {
            "lob_depth_imbalance": F.when(covered, book).otherwise(0.0),
            "lob_imbalance": F.when(covered, book).otherwise(flow),
            "lob_imbalance_is_depth": F.when(covered, 1).otherwise(0),
        }
    )


def regime(bars: DataFrame, frame: int = 100, least: int = 20) -> DataFrame:
    """low_liquidity > volatile > trending > ranging, from columns atr_14, hawkes_intensity, bar_cvd_delta, trend_strength and mbp_bar_coverage."""
    w = rows_back(frame)

    def median(c):
        return F.when(F.count(c).over(w) >= least, F.percentile(c, 0.5).over(w))

    hawkes = F.col("hawkes_intensity")
    out = bars.withColumns(
        {
            "_atr": ratio(F.col("atr_14"), median(F.col("atr_14"))),
            "_hz": F.when(F.count(hawkes).over(w) >= least, (hawkes - F.avg(hawkes).over(w)) / (F.stddev_samp(hawkes).over(w) + 1e-9)),
            "_cvd": F.coalesce(median(F.abs("bar_cvd_delta")), F.lit(0.0)),
        }
    )
    atr_ratio, hz = F.coalesce("_atr", F.lit(1.0)), F.coalesce("_hz", F.lit(0.0))
    directional = (F.abs("bar_cvd_delta") > F.col("_cvd") + 1e-12) | (F.abs("trend_strength") > 0.55)
    label = (
        F.when(F.coalesce("mbp_bar_coverage", F.lit(0.0)) < 0.30, "low_liquidity")
        .when((atr_ratio > 1.5) & (hz > 1.5), "volatile")
        .when((atr_ratio > 0.8) & directional, "trending")
        .otherwise("ranging")
    )
    out = out.withColumn("regime_label", label).drop("_atr", "_hz", "_cvd")
    return out.withColumn("regime_cluster", F.when(F.col("regime_label") == "trending", 0).when(F.col("regime_label") == "volatile", 2).when(F.col("regime_label") == "low_liquidity", 3).otherwise(1))


def direction_vote(bars: DataFrame, cvd: str = "bar_cvd_delta", obi: str = "order_flow_imbalance", trend: str = "kalman_direction") -> DataFrame:
    """+1 or -1 where at least two of three directions agree, else 0."""
    vote = deadband_sign(F.col(cvd), 1.0) + deadband_sign(F.col(obi), 0.05) + F.signum(trend).cast("int")
    return bars.withColumn("event_direction", F.when(vote >= 2, 1).when(vote <= -2, -1).otherwise(0))


def proxy_fill(bars: DataFrame, freq_seconds: int) -> DataFrame:
    """Fill missing tick features of a bar with estimates from its prices and volumes."""
    w = bar_window()
    c = F.col
    have = set(bars.columns)
    col = lambda n: finite(c(n)) if n in have else F.lit(None).cast("double")
    atr, micro_atr = F.greatest(c("atr_14"), F.lit(1e-12)), F.greatest(F.coalesce(col("micro_atr"), F.lit(0.0)), F.lit(1e-12))
    cancel = clip(F.coalesce(col("cancel_ratio"), F.lit(0.0)), 0, 1)
    absorb = clip(F.coalesce(col("absorption_intensity"), F.lit(0.0)), 0, 1)
    total = c("buy_volume") + c("sell_volume")
    micro = F.coalesce(col("micro_price"), (c("high") + c("low") + c("close")) / 3)
    estimate = {
        "obi": F.coalesce(clip(ratio(c("buy_volume") - c("sell_volume"), total), -1, 1), F.lit(0.0)),
        "spoofing_ratio": cancel * 0.85,
        "spoofing_duration": cancel * float(freq_seconds),
        "liquidity_trap": clip(absorb * cancel * 2, 0, 1),
        "inter_event_time": F.lit(float(freq_seconds)) / F.greatest(c("tick_count").cast("double"), F.lit(1.0)),
        "micro_price": micro,
        "bid_wall_strength": clip(c("buy_ratio") * 2, 0, 2),
        "ask_wall_strength": clip((1 - c("buy_ratio")) * 2, 0, 2),
        "distance_to_wall": F.abs(c("close") - micro) / micro_atr,
        "gap_size": F.coalesce(F.abs(c("open") - F.lag("close").over(w)) / atr, F.lit(0.0)),
        "liquidity_density": F.coalesce(ratio(c("volume"), F.when(c("high") > c("low"), c("high") - c("low")) + micro_atr * 1e-3), F.lit(0.0)),
    }
    return bars.withColumns({name: F.coalesce(col(name), value) for name, value in estimate.items()})


def period_levels(ticks: DataFrame, calendar: bool = False) -> DataFrame:
    """High and low of the previous day and ISO week beside each row, and the place inside them.

    The previous period is the last one that holds rows. ``calendar`` asks for the day (week) just
    before instead, carrying older levels over gaps.
    """
    rows = ticks.withColumns({"day": F.to_date("ts_event"), "week": F.to_date(F.date_trunc("week", "ts_event"))})
    for period, days, prefix in (("day", 1, "pd"), ("week", 7, "pw")):
        hl = rows.groupBy("symbol", period).agg(F.max("price").alias("_h"), F.min("price").alias("_l"))
        w = Window.partitionBy("symbol").orderBy(period)
        if calendar:
            near = F.lag(period).over(w) == F.date_sub(period, days)
            hl = hl.withColumns({n: F.when(near, F.lag(n).over(w)) for n in ("_h", "_l")}).withColumns({n: F.last(n, ignorenulls=True).over(w) for n in ("_h", "_l")})
        else:
            hl = hl.withColumns({n: F.lag(n).over(w) for n in ("_h", "_l")})
        rows = matched(rows, hl.withColumnsRenamed({"_h": f"{prefix}h", "_l": f"{prefix}l"}), ["symbol", period], salts=SALTS)
    rows = rows.withColumns({n: F.coalesce(n, "price") for n in ("pdh", "pdl", "pwh", "pwl")})
    return rows.withColumns(
        {
            "dist_to_pdh": F.round(F.col("pdh") - F.col("price"), 4),
            "dist_to_pdl": F.round(F.col("price") - F.col("pdl"), 4),
            "price_position": F.coalesce(clip(ratio(F.col("price") - F.col("pdl"), F.col("pdh") - F.col("pdl")), 0, 1), F.lit(0.5)),
        }
    ).drop("day", "week")


def session_liquidity(rows: DataFrame, keys: Sequence[str] = ("symbol", "trade_date"), least: int = 50) -> DataFrame:
    """Burst, absorption and imbalance of each session multiplied, and which session of the day has most.

    Columns session, volume_burst, absorption_intensity, obi; sessions with too few rows are left out.
    """
    score = F.avg("volume_burst") * F.avg(F.abs("absorption_intensity")) * (F.avg(F.abs("obi")) + 0.01)
    out = rows.groupBy(*keys, "session").agg(F.count(F.lit(1)).alias("rows"), score.alias("score")).filter(F.col("rows") >= least)
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "session")  # a few sessions per day
    return out.withColumn("is_best", F.row_number().over(w) == 1)


def partial_bars(ticks: DataFrame, freq: str) -> DataFrame:
    """Bars as sums, counts and first/last with their times, so that they can be merged later."""
    at = moment()
    return with_bar(ticks, freq).groupBy(*BAR_KEYS).agg(
        F.min_by("price", at).alias("open"), F.min(at).alias("first_at"), F.max_by("price", at).alias("close"), F.max(at).alias("last_at"),
        F.max("price").alias("high"), F.min("price").alias("low"), F.sum("price").alias("price_sum"), F.count("price").alias("price_count"), F.sum("size").alias("size"),
    )


def merge_partials(parts: DataFrame, freq: str) -> DataFrame:
    """Merge partial bars of any stretch into longer bars, in time order whatever order they come in."""
    longer = parts.withColumn("bar_ts", F.window("bar_ts", freq)["start"])
    return longer.groupBy(*BAR_KEYS).agg(
        F.min_by("open", "first_at").alias("open"), F.max_by("close", "last_at").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"),
        (F.sum("price_sum") / F.sum("price_count")).alias("mean_price"), F.sum("size").alias("size"),
    )
