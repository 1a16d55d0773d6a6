"""Causal windows over tick rows. All frames are counted in rows, so hot symbols can be cut in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import book as B
from tapeloom.functions.market import at_least, clip, is_buy, is_sell, is_trade, ratio
from tapeloom.operators.asof import asof
from tapeloom.operators.ordered import SALTS, beside, exact_quantiles, fits, matched, numbered, running, spec, windowed
from tapeloom.operators.sliding import split_extremes


def _last(w, n: int):
    """Frame of the last n rows, this one included."""
    return w.rowsBetween(-(n - 1), 0)


def _micros(c: str = "ts_event") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def rates_of_change(rows: DataFrame, column: str = "cvd", lags: tuple[int, ...] = (10, 50, 200)) -> DataFrame:
    def roc(df, w):
        out = {f"{column}_roc_{k}": F.coalesce(F.col(column) - F.lag(column, k).over(w), F.lit(0.0)) for k in lags}
        return df.withColumns(out)

    rows = windowed(rows, roc, before=max(lags))
    return rows.withColumn(f"{column}_accel", F.col(f"{column}_roc_{lags[0]}") - F.col(f"{column}_roc_{lags[1]}"))


def micro_atr(rows: DataFrame, n: int = 100, least: int = 5) -> DataFrame:
    """Mean absolute price step of the last n steps."""

    def move(df, w):
        return df.withColumn("_move", F.abs(F.col("price") - F.lag("price").over(w)))

    def mean(df, w):
        f = _last(w, n)
        return df.withColumn("micro_atr", F.coalesce(at_least(F.count("_move").over(f), least, F.avg("_move").over(f)), F.lit(0.0)))

    return windowed(windowed(rows, move, before=1), mean, before=n).drop("_move")


def trade_pace(rows: DataFrame, sizes: int = 500, least_sizes: int = 10, intervals: int = 50, least_intervals: int = 5) -> DataFrame:
    """Volume burst and mean time between trades (ms), carried to the rows between trades."""

    def pace(df, w):
        prior = w.rowsBetween(-sizes, -1)
        gap = (_micros() - F.lag(_micros()).over(w)) / F.lit(1000.0)
        burst = ratio(F.col("size"), F.avg("size").over(prior))
        return df.withColumns({"_burst": F.coalesce(at_least(F.count("size").over(prior), least_sizes, burst), F.lit(1.0)), "_gap": gap})

    def mean_gap(df, w):
        f = _last(w, intervals)
        return df.withColumn("_iet", at_least(F.count("_gap").over(f), least_intervals, F.avg("_gap").over(f)))

    traded = is_trade() & (F.col("size") > 0)
    trades = windowed(windowed(rows.filter(traded), pace, before=sizes), mean_gap, before=intervals)
    both = trades.drop("_gap").unionByName(rows.filter(~F.coalesce(traded, F.lit(False))), allowMissingColumns=True)
    both = running(both, {"volume_burst": ("last", "_burst"), "trade_interval_ms": ("last", "_iet")})
    return both.withColumns({"volume_burst": F.coalesce("volume_burst", F.lit(1.0)), "trade_interval_ms": F.coalesce("trade_interval_ms", F.lit(0.0))}).drop("_burst", "_iet")


def tape_speed(rows: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Trades in the last ``seconds``, both ends included."""
    micros = int(seconds * 1_000_000)
    traded = is_trade().cast("int")
    if fits(rows, ["symbol"]):
        w = spec(["symbol"], [_micros()]).rangeBetween(-micros, 0)
        # Rows of the same time that come later are not known yet.
        ahead = F.sum(traded).over(spec(["symbol", "ts_event"], ["sequence"]).rowsBetween(1, 2**31 - 1))
        return rows.withColumn("tape_speed", F.sum(traded).over(w) - F.coalesce(ahead, F.lit(0)))
    counted = running(rows, {"_n": ("sum", traded)})
    cut = (F.col("ts_event").cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))).cast(dict(rows.dtypes)["ts_event"])
    starts = rows.select("symbol", cut.alias("ts_event"), "sequence")
    before = asof(starts, counted.select("symbol", "ts_event", "sequence", "_n"), columns=["_n"], strict=True)
    before = before.select("symbol", "sequence", F.col("_n").alias("_before"))
    return matched(counted, before, ["symbol", "sequence"]).withColumn("tape_speed", F.col("_n") - F.coalesce("_before", F.lit(0))).drop("_n", "_before")


def kyle_lambda(trades: DataFrame, n: int = 50, tail: int = 20, least: int = 5, least_z: int = 10) -> DataFrame:
    """Price impact per unit of volume: median of the last impacts, and z-score of the signed impact."""

    def impact(df, w):
        signed = (F.col("price") - F.lag("price").over(w)) / F.greatest(F.col("size").cast("double"), F.lit(1e-8))
        return df.withColumn("_signed", signed)

    def stats(df, w):
        recent, f = _last(w, min(tail, n)), _last(w, n)
        size = F.abs("_signed")
        enough = F.count("_signed").over(f)
        z = (F.col("_signed") - F.avg("_signed").over(f)) / (F.stddev_pop("_signed").over(f) + 1e-8)
        return df.withColumns(
            {
                "kyle_lambda": F.coalesce(F.when(enough >= least, F.percentile(size, 0.5).over(recent)).otherwise(size), F.lit(0.0)),
                "kyle_z": F.coalesce(at_least(enough, least_z, clip(z, -4, 4)), F.lit(0.0)),
            }
        )

    return windowed(windowed(trades, impact, before=1), stats, before=n).drop("_signed")


def vnet(trades: DataFrame, n: int = 100, sizes: int = 200, least_sizes: int = 10, large: float = 2.0, least: int = 5) -> DataFrame:
    """Signed share of volume, large trades counted twice."""
    size = F.col("size").cast("double")

    def weigh(df, w):
        f = _last(w, sizes)
        usual = F.when(F.count("size").over(f) >= least_sizes, F.avg("size").over(f)).otherwise(1.0)
        weight = F.when(size >= usual * large, 2.0).otherwise(1.0)
        side = F.when(is_buy(), 1.0).when(is_sell(), -1.0).otherwise(0.0)
        return df.withColumns({"_vol": size * weight, "_sv": size * weight * side})

    def share(df, w):
        f = _last(w, n)
        value = clip(ratio(F.sum("_sv").over(f), F.sum("_vol").over(f)), -1, 1)
        return df.withColumn("vnet", F.coalesce(at_least(F.count("_vol").over(f), least, value), F.lit(0.0)))

    return windowed(windowed(trades.filter("size > 0"), weigh, before=sizes), share, before=n).drop("_vol", "_sv")


def absorption(trades: DataFrame, n: int = 50, min_move: float = 0.25, buffer: int = 200, least: int = 20, first_scale: float = 500.0) -> DataFrame:
    """Flow per price move over the last n trades, against its own past median, on a log scale."""

    def raw(df, w):
        f = w.rowsBetween(-n, 0)
        flow = F.abs(F.col("cvd") - F.first("cvd").over(f))
        move = F.greatest(F.abs(F.col("price") - F.first("price").over(f)), F.lit(min_move))
        return df.withColumn("_raw", at_least(F.count("price").over(f), n, flow / move))

    def scaled(df, w):
        prior = w.rowsBetween(-buffer, -1)
        scale = F.when(F.count("_raw").over(prior) >= least, F.greatest(F.percentile("_raw", 0.5).over(prior), F.lit(1e-6))).otherwise(first_scale)
        return df.withColumn("absorption_intensity", F.coalesce(clip(F.log1p(F.col("_raw") / scale), 0, 25), F.lit(0.0)))

    return windowed(windowed(trades, raw, before=n), scaled, before=buffer).drop("_raw")


def momentum(trades: DataFrame, n: int = 100, swing: int = 200, least: int = 20) -> DataFrame:
    """CVD momentum, agreement of price and CVD over half windows, trend strength, correction depth."""

    def context(df, w):
        past = F.lag("cvd", n - 1).over(w)
        half = swing // 2
        new, old = _last(w, swing - half), w.rowsBetween(-(swing - 1), -(swing - half))
        full = F.count("price").over(_last(w, swing)) >= swing
        p = F.signum(F.avg("price").over(new) - F.avg("price").over(old))
        c = F.signum(F.avg("cvd").over(new) - F.avg("cvd").over(old))
        t, s = _last(w, n), _last(w, swing)
        span_t = F.max("price").over(t) - F.min("price").over(t)
        span_s = F.max("price").over(s) - F.min("price").over(s)
        strength = F.least(F.abs(F.col("price") - F.first("price").over(t)) / span_t, F.lit(1.0))
        up = F.col("price") > F.first("price").over(s)
        depth = F.when(up, F.max("price").over(s) - F.col("price")).otherwise(F.col("price") - F.min("price").over(s)) / span_s
        return df.withColumns(
            {
                "cvd_momentum": F.coalesce((F.col("cvd") - past) / F.greatest(F.abs("cvd"), F.abs(past), F.lit(1.0)), F.lit(0.0)),
                "cvd_price_divergence": F.when(full & (p != 0), F.when(p == c, 1.0).otherwise(-1.0)).otherwise(0.0),
                "trend_strength": F.when((F.count("price").over(t) >= least) & (span_t > 0), strength).otherwise(0.0),
                "correction_depth": F.when((F.count("price").over(s) >= least) & (span_s > 0), depth).otherwise(0.0),
            }
        )

    return windowed(trades, context, before=swing)


def liquidity_sweep(rows: DataFrame, n: int = 300, least: int = 50, threshold: float = 0.05) -> DataFrame:
    """How far the newest fifth of the window broke the older range before price came back."""

    edges = ["_hi", "_lo", "_nhi", "_nlo"]
    out = split_extremes(rows, "price", n, 0.8, ["_seen", "_sd", *edges])
    out = out.withColumns({c: F.when(F.col("_seen") >= least, F.col(c)) for c in edges})
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.col("_sd") * 2, F.lit(1e-8))
    up, down = (F.col("_nhi") - F.col("_hi")) / span, (F.col("_lo") - F.col("_nlo")) / span
    value = (
        F.when((up > threshold) & (F.col("price") < F.col("_hi")), F.least(up * 5, F.lit(1.0)))
        .when((down > threshold) & (F.col("price") > F.col("_lo")), -F.least(down * 5, F.lit(1.0)))
        .otherwise(0.0)
    )
    return out.withColumn("liquidity_sweep", value).drop("_seen", "_sd", *edges)


def snapshot_spoofing(rows: DataFrame, n: int = 50, base: int = 200, least: int = 10, large: float = 1.5) -> DataFrame:
    """Older spoofing rule: any drop of the top three levels without a trade, above 1.5 usual sizes."""

    def mark(df, w):
        bid, ask, f = B.depth("bid_sz", 3), B.depth("ask_sz", 3), _last(w, base)
        top = F.greatest(bid, ask)
        top = F.when(top > 0, top)
        usual = F.when(F.count(top).over(f) >= least, F.avg(top).over(f)).otherwise(1.0)
        return df.withColumns({"_usual": usual, "_bd": F.coalesce(F.lag(bid).over(w) - bid, F.lit(0.0)), "_ad": F.coalesce(F.lag(ask).over(w) - ask, F.lit(0.0))})

    rows = windowed(rows, mark, before=base)
    limit, traded = F.col("_usual") * large, is_trade()
    drop = F.when(traded, None).when(F.col("_bd") > limit, F.col("_bd")).when(F.col("_ad") > limit, F.col("_ad"))
    rows = rows.withColumns({"_drop": drop, "_trade": traded.cast("int")})

    def rates(df, w):
        f = _last(w, n)
        return df.withColumns(
            {
                "spoofing_ratio": F.least(F.count("_drop").over(f) / F.greatest(F.sum("_trade").over(f), F.lit(1)), F.lit(1.0)),
                "spoofing_duration": F.coalesce(F.col("_drop") / F.greatest("_usual", F.lit(1.0)), F.lit(0.0)),
            }
        )

    return windowed(rows, rates, before=n).drop("_usual", "_bd", "_ad", "_drop", "_trade")


def session_vwap(trades: DataFrame, n: int = 500, least: int = 50, slope: int = 20) -> DataFrame:
    """Daily VWAP, deviation z-score over the day's last n trades, slope and session CVD."""
    keys = ("symbol", "trade_date")
    size = F.col("size").cast("double")
    rows = trades.withColumn("trade_date", F.to_date("ts_event"))
    rows = running(rows, {"_v": ("sum", size), "_pv": ("sum", F.col("price") * size), "session_cvd": ("sum", F.when(is_buy(), size).otherwise(-size))}, keys=keys)
    rows = rows.withColumn("current_vwap", F.coalesce(ratio(F.col("_pv"), F.col("_v")), F.col("price")))

    def score(df, w):
        gap, f = F.col("price") - F.col("current_vwap"), _last(w, n)
        return df.withColumns(
            {
                "vwap_z_score": F.when(F.count(gap).over(f) > least, gap / (F.stddev_pop(gap).over(f) + 1e-8)).otherwise(0.0),
                "vwap_slope": F.coalesce(F.col("current_vwap") - F.lag("current_vwap", slope - 1).over(w), F.lit(0.0)),
            }
        )

    return windowed(rows, score, before=max(n, slope), keys=keys).drop("_v", "_pv", "trade_date")


def daily_context(rows: DataFrame, tick: float, open_hour: int = 8, days: int = 20, least: int = 3, default_adr: float = 80.0) -> DataFrame:
    """Break of the first hour's range, and what the day's range leaves of the usual one."""
    keys = ("symbol", "trade_date")
    rows = rows.withColumn("trade_date", F.to_date("ts_event"))
    opening = F.when(F.hour("ts_event") == open_hour, F.col("price"))
    rows = running(rows, {"_hi": ("max", "price"), "_lo": ("min", "price"), "_ibh": ("max", opening), "_ibl": ("min", opening)}, keys=keys)
    daily = rows.groupBy(*keys).agg(F.greatest(F.max("price") - F.min("price"), F.lit(tick)).alias("_range"))
    prior = spec(["symbol"], ["trade_date"]).rowsBetween(-days, -1)
    usual = F.when(F.count("_range").over(prior) >= least, F.percentile("_range", 0.5).over(prior)).otherwise(default_adr * tick if default_adr > 1 else default_adr)
    daily = daily.withColumn("adr", F.greatest(usual, F.lit(tick)))
    rows = matched(rows, daily.select(*keys, "adr"), keys, salts=SALTS)
    status = F.when(F.hour("ts_event") == open_hour, 0).when(F.col("price") > F.col("_ibh"), 1).when(F.col("price") < F.col("_ibl"), -1).otherwise(0)
    rows = rows.withColumns({"ib_status": status, "remaining_fuel": F.greatest(F.lit(0.0), F.col("adr") - (F.col("_hi") - F.col("_lo")))})
    return rows.withColumn("fuel_exhausted", (F.col("remaining_fuel") <= F.col("adr") * 0.1).cast("int")).drop("_hi", "_lo", "_ibh", "_ibl", "trade_date")


def regime_features(rows: DataFrame, persistence: int, trend: int) -> DataFrame:
    """Volume ratio, CVD impulse and persistence, activity and trend efficiency, from past rows."""

    def first(df, w):
        size = F.greatest(F.col("size").cast("double"), F.lit(0.0))
        base = F.coalesce(F.avg(size).over(w.rowsBetween(-20, -1)), F.lit(1.0))
        gap = (_micros() - F.lag(_micros()).over(w)) / F.lit(1e6)
        return df.withColumns(
            {
                "volume_ratio": clip(size / F.greatest(base, F.lit(1e-8)), 0, 5),
                "_step": F.coalesce(F.abs(F.col("cvd") - F.lag("cvd").over(w)), F.lit(0.0)),
                "_far": F.abs(F.lag("cvd", 1).over(w) - F.lag("cvd", persistence + 1).over(w)),
                "_move": F.abs(F.col("price") - F.lag("price").over(w)),
                "_gap": gap,
                "_net": F.abs(F.col("price") - F.lag("price", trend).over(w)),
            }
        )

    def second(df, w):
        f = _last(w, trend)
        gross = at_least(F.count("_move").over(f), 2, F.sum("_move").over(f))
        base = F.percentile("_gap", 0.5).over(w.rowsBetween(-20, -1))
        return df.withColumns(
            {
                "cvd_impulse": F.coalesce(F.avg("_step").over(w.rowsBetween(-10, -1)), F.lit(0.0)),
                "cvd_persistence": F.coalesce(F.avg("_far").over(_last(w, 5)), F.lit(0.0)),
                "activity": F.coalesce(clip(base / F.greatest("_gap", F.lit(1e-6)), 0, 5), F.col("volume_ratio")),
                "trend_efficiency": F.coalesce(clip(F.col("_net") / F.greatest(gross, F.lit(1e-8)), 0, 1), F.lit(0.0)),
            }
        )

    back = max(20, persistence + 1, trend)
    return windowed(windowed(rows, first, before=back), second, before=max(20, trend)).drop("_step", "_far", "_move", "_gap", "_net")


def fim_anomaly(trades: DataFrame, n: int = 20, multiple: float = 1.5) -> DataFrame:
    """Flag bursts in the variance of standardised log returns."""

    def returns(df, w):
        prev = F.lag("price").over(w)
        return df.withColumn("_lr", F.when((prev > 0) & (F.col("price") > 0), F.ln(F.col("price") / prev)))

    def score(df, w):
        f = _last(w, n)
        variance = F.greatest(F.var_samp("_lr").over(f), F.lit(1e-8))
        return df.withColumn("_score", at_least(F.count("_lr").over(f), n, (F.col("_lr") - F.avg("_lr").over(f)) / variance))

    def fim(df, w):
        f = _last(w, n)
        return df.withColumn("_fim", at_least(F.count("_score").over(f), n, F.var_samp("_score").over(f)))

    def flag(df, w):
        f = _last(w, 2 * n)
        limit = F.avg("_fim").over(f) + multiple * F.stddev_samp("_fim").over(f)
        return df.withColumn("anomaly", F.when((F.count("_fim").over(f) >= 2 * n) & (F.col("_fim") > limit), 1).otherwise(0))

    out = trades
    for step, reach in ((returns, 1), (score, n), (fim, n), (flag, 2 * n)):
        out = windowed(out, step, before=reach)
    return out.drop("_lr", "_score", "_fim")


def cancel_ratio(rows: DataFrame, n: int = 500, sizes: int = 200, least_sizes: int = 10, large: float = 3.0, least: int = 3) -> DataFrame:
    """Mean weight of order events: adds 0, cancels 0.3, cancels of a large live order 1."""
    action = F.upper("action")
    adds = F.when(action == "A", F.col("size").cast("double"))
    life = windowed(
        rows.filter(action.isin("A", "C") | is_trade()),
        lambda df, w: df.withColumns({"_was": F.lag(action).over(w), "_had": F.lag(F.col("size").cast("double")).over(w)}),
        before=1,
        keys=("symbol", "order_id"),
    )
    life = life.filter(action.isin("A", "C")).withColumn("_live", F.when(F.col("_was") == "A", F.col("_had")))

    # The mean size looks at the last adds, however many cancels lie between them.
    only_adds = windowed(life.filter(action == "A"), lambda df, w: df.withColumn("_usual", at_least(F.count("size").over(_last(w, sizes)), least_sizes, F.avg("size").over(_last(w, sizes)))), before=sizes)
    both = only_adds.unionByName(life.filter(action == "C"), allowMissingColumns=True)
    both = running(both, {"_mean": ("last", "_usual")})
    weight = F.when(adds.isNotNull(), 0.0).when(F.col("_live") >= F.coalesce("_mean", F.lit(1.0)) * large, 1.0).otherwise(0.3)

    def mean(df, w):
        f = _last(w, n)
        return df.withColumn("cancel_ratio", F.coalesce(at_least(F.count("_weight").over(f), least, F.avg("_weight").over(f)), F.lit(0.0)))

    return windowed(both.withColumn("_weight", weight), mean, before=n).drop("_was", "_had", "_live", "_usual", "_mean", "_weight")


def runs(rows: DataFrame, flag: str) -> DataFrame:
    """Number, length, first and last time of the run of equal flags that a row belongs to, and its place in it."""
    rows = windowed(rows, lambda df, w: df.withColumn("_new", F.when(F.col(flag) != F.lag(flag).over(w), 1).otherwise(0)), before=1)
    rows = running(rows, {"run": ("sum", "_new")}).drop("_new")
    rows = running(rows, {"run_position": ("count", F.lit(1))}, keys=("symbol", "run"))
    ends = rows.groupBy("symbol", "run").agg(F.count(F.lit(1)).alias("run_length"), F.min("ts_event").alias("run_start"), F.max("ts_event").alias("run_end"))
    return matched(rows, ends, ["symbol", "run"])


def forward_delta(rows: DataFrame, columns: dict[str, str], k: int) -> DataFrame:
    """Value k rows later less the value now."""
    return windowed(rows, lambda df, w: df.withColumns({out: F.lead(c, k).over(w) - F.col(c) for out, c in columns.items()}), after=k)


def stability(rows: DataFrame, label: str, shifts: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of the neighbours at the given distances, both ways, with the same label."""

    def share(df, w):
        same, seen = F.lit(0), F.lit(0)
        for k in shifts:
            for other in (F.lag(label, k).over(w), F.lead(label, k).over(w)):
                same, seen = same + F.coalesce((other == F.col(label)).cast("int"), F.lit(0)), seen + other.isNotNull().cast("int")
        return df.withColumn("label_stability", F.coalesce(F.try_divide(same.cast("double"), seen.cast("double")), F.lit(1.0)))

    return windowed(rows, share, before=max(shifts), after=max(shifts))


def turns(rows: DataFrame, direction: str) -> DataFrame:
    """Rows where the direction differs from the row before, with the old value."""
    rows = windowed(rows, lambda df, w: df.withColumn("previous", F.lag(direction).over(w)), before=1)
    return rows.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(direction)))


def relative_volatility(rows: DataFrame, column: str, n: int = 200) -> DataFrame:
    def rel(df, w):
        base = F.avg(column).over(_last(w, n))
        return df.withColumn("relative_volatility", F.coalesce(ratio(F.col(column), base), F.lit(1.0)))

    return windowed(rows, rel, before=n)


def shape_features(rows: DataFrame, n: int) -> DataFrame:
    """Deviation of the price steps, mean step per deviation, usual volume and skew of the last n rows."""

    def step(df, w):
        return df.withColumn("_d", F.coalesce(F.col("price") - F.lag("price").over(w), F.lit(0.0)))

    def shape(df, w):
        f = _last(w, n)
        k = F.count("_d").over(f).cast("double")
        std = F.coalesce(at_least(k, 3, F.stddev_samp("_d").over(f)), F.lit(0.0))
        # Sample skew from the population skew that Spark gives.
        skew = F.skewness("_d").over(f) * F.sqrt(k * (k - 1)) / (k - 2)
        return df.withColumns(
            {
                "shape_std": std,
                "shape_trend": F.coalesce(at_least(k, 2, F.avg(F.abs("_d")).over(f)), F.lit(0.0)) / F.greatest(std, F.lit(1e-10)),
                "shape_volume": F.avg(F.col("size").cast("double")).over(f),
                "shape_skew": F.coalesce(F.when((k >= 3) & (std > 1e-12), skew), F.lit(0.0)),
            }
        )

    rows = windowed(windowed(rows, step, before=1), shape, before=n).drop("_d")
    middle = exact_quantiles(rows, {"_q": "size"}, [0.5]).select(F.get("_q", 0).alias("_median"))
    rows = rows.transform(beside, middle)  # one row
    return rows.withColumn("shape_liquidity", F.col("shape_volume") / F.greatest("_median", F.lit(1e-10))).drop("_median", "shape_volume")


def calibration(rows: DataFrame, sample: int = 2000, least: int = 10) -> DataFrame:
    """Per symbol, from its first rows: tick size, smallest move, usual size and volatility.

    The rows of a symbol are at most ``sample`` here, so plain percentiles are safe.
    """
    head = numbered(rows, "_at").filter(F.col("_at") < sample)
    priced = head.filter("price > 0")
    q = priced.groupBy("symbol").agg(F.percentile("price", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    q = q.withColumn("_iqr", F.get("_q", 1) - F.get("_q", 0))
    priced = priced.join(q, "symbol")
    inside = F.col("price").between(F.get("_q", 0) - 3 * F.col("_iqr"), F.get("_q", 1) + 3 * F.col("_iqr"))
    priced = priced.filter((F.col("_iqr") <= 0) | inside)
    w = spec(["symbol"], ["_at"])
    steps = priced.withColumn("_step", F.abs(F.col("price") - F.lag("price").over(w))).filter("_step > 0")
    counted = steps.groupBy("symbol", F.round("_step", 4).alias("_r")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).filter("_n >= 3")
    top = spec(["symbol"], [F.desc("_n"), "_first"])
    usual = counted.withColumn("_rank", F.row_number().over(top)).filter("_rank <= 10").groupBy("symbol").agg(F.min("_r").alias("_tick"))
    moves = steps.groupBy("symbol").agg(F.percentile("_step", F.array(F.lit(0.05), F.lit(0.25))).alias("_sq"), F.count(F.lit(1)).alias("_steps"))
    traded = head.filter(is_trade() & F.col("price").isNotNull())
    traded = traded.withColumn("_ts", F.abs(F.col("price") - F.lag("price").over(w))).groupBy("symbol").agg(F.avg("_ts").alias("_vol"), F.count(F.lit(1)).alias("_trades"))
    sizes = head.filter("size > 0").groupBy("symbol").agg(F.percentile("size", 0.5).alias("typical_size"))
    base = priced.groupBy("symbol").agg(F.count(F.lit(1)).alias("_prices"), F.avg("price").alias("mean_price"), F.stddev_samp("price").alias("price_scale")).filter(F.col("_prices") >= least)
    out = base.join(moves, "symbol").join(usual, "symbol", "left").join(sizes, "symbol").join(traded, "symbol", "left")
    out = out.withColumn("tick_size", F.coalesce("_tick", F.get("_sq", 0)))
    return out.select(
        "symbol",
        "tick_size",
        F.greatest("tick_size", F.get("_sq", 1)).alias("min_price_move"),
        "typical_size",
        F.when(F.col("_trades") > least, F.greatest("_vol", "tick_size")).otherwise(1.0).alias("volatility"),
        "mean_price",
        "price_scale",
    )
