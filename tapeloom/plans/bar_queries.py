"""Queries over bars, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import book as B
from tapeloom.functions.market import is_trade, signed_size
from tapeloom.operators import bars as O
from tapeloom.plans import views as V
from tapeloom.plans.registry import query

TRADE_BARS_CTE = """trade_bars AS (
  SELECT symbol, date_trunc('{unit}', ts_event) AS bar_ts,
         first(price ORDER BY ts_event, sequence) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts_event, sequence) AS close, sum(size)::DOUBLE AS volume, count(*) AS tick_count,
         sum(CASE WHEN side = 'A' THEN size ELSE 0 END)::DOUBLE AS buy_volume,
         sum(CASE WHEN side = 'B' THEN size ELSE 0 END)::DOUBLE AS sell_volume,
         coalesce(sum(CASE WHEN side = 'A' THEN size ELSE 0 END)::DOUBLE / nullif(sum(size), 0), 0.5) AS buy_ratio
  FROM ticks WHERE action = 'T' AND price > 0 GROUP BY ALL)"""
MID_BARS_CTE = """mid_bars AS (
  SELECT symbol, bar_ts, first(mid ORDER BY ts_event, sequence) AS open, max(mid) AS high, min(mid) AS low,
         last(mid ORDER BY ts_event, sequence) AS close, 0.0::DOUBLE AS volume, count(*) AS snapshot_count, avg(spr) AS avg_spread
  FROM (SELECT symbol, ts_event, sequence, date_trunc('{unit}', ts_event) AS bar_ts,
               (bid_px[1] + ask_px[1]) / 2 AS mid, ask_px[1] - bid_px[1] AS spr FROM book) WHERE mid > 0 GROUP BY ALL)"""
OHLC = "open high low close volume"
ATR = """(SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS 13 PRECEDING) AS atr_14 FROM
   (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM
     (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_ts) AS pc FROM {src})))"""
HOUR, DAY = "1 hour", "1 day"


@query(
    "a1_a2_w12_bars_flow_atr",
    V.TICKS + ", " + TRADE_BARS_CTE.format(unit="hour") + " SELECT * EXCLUDE (pc, tr) FROM " + ATR.format(src="trade_bars"),
    OHLC + " buy_volume sell_volume buy_ratio atr_14",
)
def bars_flow_atr(spark, sf_dir):
    return O.with_atr(O.trade_bars(V.ticks(spark, sf_dir), HOUR))


@query("a1_ohlcv_bars", V.TICKS + ", " + TRADE_BARS_CTE.format(unit="hour") + " SELECT symbol, bar_ts, open, high, low, close, volume, tick_count FROM trade_bars", OHLC)
def ohlcv_bars(spark, sf_dir):
    return O.price_bars(V.ticks(spark, sf_dir).filter(is_trade()), HOUR)


@query("a2_buy_sell_bars", V.TICKS + ", " + TRADE_BARS_CTE.format(unit="day") + " SELECT symbol, bar_ts, buy_volume, sell_volume, buy_ratio FROM trade_bars", "buy_volume sell_volume buy_ratio")
def buy_sell_bars(spark, sf_dir):
    return O.trade_bars(V.ticks(spark, sf_dir), DAY).select("symbol", "bar_ts", "buy_volume", "sell_volume", "buy_ratio")


@query("a3_mid_bars", V.BOOK + ", " + MID_BARS_CTE.format(unit="hour") + " SELECT * FROM mid_bars", OHLC + " avg_spread")
def mid_bars(spark, sf_dir):
    return O.mid_bars(V.book(spark, sf_dir), HOUR)


THRESHOLD = (
    V.BOOK
    + ", "
    + TRADE_BARS_CTE.format(unit="day")
    + ", "
    + MID_BARS_CTE.format(unit="day")
    + """, joined AS (
  SELECT coalesce(t.symbol, m.symbol) AS symbol, coalesce(t.bar_ts, m.bar_ts) AS bar_ts, coalesce(t.open, m.open) AS open,
         coalesce(t.high, m.high) AS high, coalesce(t.low, m.low) AS low, coalesce(t.close, m.close) AS close,
         coalesce(t.volume, 0) AS volume, coalesce(t.tick_count, 0) AS tick_count, coalesce(m.snapshot_count, 0) AS snapshot_count,
         coalesce(t.buy_volume, 0) AS buy_volume, coalesce(t.sell_volume, 0) AS sell_volume, coalesce(t.buy_ratio, 0.5) AS buy_ratio,
         m.avg_spread AS avg_spread, CASE WHEN t.open IS NOT NULL THEN 'MBO' ELSE 'MBP' END AS source
  FROM trade_bars t FULL JOIN mid_bars m ON t.symbol = m.symbol AND t.bar_ts = m.bar_ts)
"""
)


@query("j7_combined_bars", THRESHOLD + "SELECT * FROM joined", OHLC + " buy_volume sell_volume buy_ratio avg_spread")
def combined_bars(spark, sf_dir):
    return O.combine_bars(O.trade_bars(V.ticks(spark, sf_dir), DAY), O.mid_bars(V.book(spark, sf_dir), DAY))


@query(
    "a34_threshold_features",
    THRESHOLD + "SELECT * EXCLUDE (pc, tr), close AS price FROM " + ATR.format(src="joined"),
    OHLC + " buy_volume sell_volume buy_ratio avg_spread atr_14 price",
)
def threshold_features(spark, sf_dir):
    return O.threshold_features(V.ticks(spark, sf_dir), V.book(spark, sf_dir), DAY)


@query(
    "j8_side_bars_joined",
    V.TICKS
    + """, base AS (SELECT symbol, date_trunc('day', ts_event) AS bar_ts, count(*) AS n FROM ticks GROUP BY ALL),
buys AS (SELECT symbol, date_trunc('day', ts_event) AS bar_ts, sum(size)::BIGINT AS buy_size FROM ticks WHERE action = 'T' AND side = 'A' GROUP BY ALL)
SELECT b.symbol, b.bar_ts, b.n, coalesce(s.buy_size, 0)::BIGINT AS buy_size FROM base b LEFT JOIN buys s USING (symbol, bar_ts)""",
)
def side_bars_joined(spark, sf_dir):
    ticks = O.with_bar(V.ticks(spark, sf_dir), DAY)
    base = ticks.groupBy("symbol", "bar_ts").agg(F.count(F.lit(1)).alias("n"))
    buys = ticks.filter(is_trade() & (F.col("side") == "A")).groupBy("symbol", "bar_ts").agg(F.sum("size").alias("buy_size"))
    return base.join(buys, ["symbol", "bar_ts"], "left").withColumn("buy_size", F.coalesce("buy_size", F.lit(0)))


SIGNED = "CASE WHEN action = 'T' AND side = 'A' THEN size WHEN action = 'T' AND side = 'B' THEN -size ELSE 0 END::DOUBLE"
CVD_CTE = f"""cvd_ticks AS (
  SELECT *, sum(signed) OVER (PARTITION BY symbol ORDER BY ts_event, sequence) AS cvd,
         sum(signed) OVER (PARTITION BY symbol, ts_event::DATE ORDER BY ts_event, sequence) AS session_cvd
  FROM (SELECT *, {SIGNED} AS signed FROM ticks))"""


@query("w2_w3_running_and_session_cvd", f"{V.TICKS}, {CVD_CTE} SELECT symbol, ts_event, sequence, cvd, session_cvd_check AS session_cvd FROM (SELECT *, sum(signed) OVER (PARTITION BY symbol, ts_event::DATE ORDER BY ts_event, sequence) AS session_cvd_check FROM cvd_ticks)", "cvd session_cvd")
def running_cvd(spark, sf_dir):
    from tapeloom.operators.ordered import running

    ticks = V.ticks(spark, sf_dir).withColumns({"signed": signed_size(), "trade_date": F.to_date("ts_event")})
    ticks = running(ticks, {"cvd": ("sum", "signed")})
    ticks = running(ticks, {"session_cvd": ("sum", "signed")}, keys=("symbol", "trade_date"))
    return ticks.select("symbol", "ts_event", "sequence", "cvd", "session_cvd")


# Simple tick features that need no window, so that the bar SQL stays readable.
TICK_FEATURES_CTE = (
    CVD_CTE
    + """, tf AS (
  SELECT *, date_trunc('day', ts_event) AS bar_ts, signed / 100.0 AS kyle_lambda, (size % 7)::DOUBLE AS absorption_intensity,
         CASE WHEN action = 'C' THEN 0.3 ELSE 0.0 END::DOUBLE AS cancel_ratio, (size % 5)::DOUBLE / 10 AS spoofing_ratio FROM cvd_ticks)"""
)


def tick_features(spark, sf_dir):
    return O.with_cvd(V.ticks(spark, sf_dir)).withColumns(
        {
            "kyle_lambda": F.col("signed") / 100.0,
            "absorption_intensity": (F.col("size") % 7).cast("double"),
            "cancel_ratio": F.when(F.col("action") == "C", 0.3).otherwise(0.0),
            "spoofing_ratio": (F.col("size") % 5).cast("double") / 10,
        }
    )


RICH = {
    "kyle_lambda": ("kyle_lambda", "absmax"),
    "kyle_std": ("kyle_lambda", "std"),
    "absorption_intensity": ("absorption_intensity", "max"),
    "absorption_std": ("absorption_intensity", "std"),
    "cancel_ratio": ("cancel_ratio", "mean"),
    "spoofing_last": ("spoofing_ratio", "last"),
    "signed_sum": ("signed", "sum"),
}
RICH_CTE = (
    TICK_FEATURES_CTE
    + """, rich AS (
  SELECT symbol, bar_ts, first(price ORDER BY ts_event, sequence) FILTER (action = 'T') AS open, max(price) FILTER (action = 'T') AS high,
    min(price) FILTER (action = 'T') AS low, last(price ORDER BY ts_event, sequence) FILTER (action = 'T') AS close,
    sum(CASE WHEN action = 'T' THEN size ELSE 0 END)::DOUBLE AS volume,
    sum(CASE WHEN action = 'T' AND side = 'A' THEN size ELSE 0 END)::DOUBLE AS buy_volume,
    sum(CASE WHEN action = 'T' AND side = 'B' THEN size ELSE 0 END)::DOUBLE AS sell_volume,
    count(*) FILTER (action = 'T') AS tick_count, last(cvd ORDER BY ts_event, sequence) AS cvd,
    last(cvd ORDER BY ts_event, sequence) - first(cvd ORDER BY ts_event, sequence) AS bar_cvd_delta,
    last(session_cvd ORDER BY ts_event, sequence) AS session_cvd,
    first(kyle_lambda ORDER BY abs(kyle_lambda) DESC, ts_event, sequence) AS kyle_lambda,
    coalesce(stddev_samp(kyle_lambda), 0) AS kyle_std, max(absorption_intensity) AS absorption_intensity,
    coalesce(stddev_samp(absorption_intensity), 0) AS absorption_std, avg(cancel_ratio) AS cancel_ratio,
    last(spoofing_ratio ORDER BY ts_event, sequence) AS spoofing_last, sum(signed) AS signed_sum,
    sum(CASE WHEN action = 'T' THEN size * price ELSE 0 END) / greatest(sum(CASE WHEN action = 'T' THEN size ELSE 0 END), 1e-9) AS micro_price,
    sum(CASE WHEN action = 'T' AND side = 'A' THEN size ELSE 0 END)::DOUBLE / greatest(sum(CASE WHEN action = 'T' THEN size ELSE 0 END), 1) AS buy_ratio,
    (last(cvd ORDER BY ts_event, sequence) - first(cvd ORDER BY ts_event, sequence)) / count(*) AS cvd_velocity
  FROM tf GROUP BY ALL HAVING sum(CASE WHEN action = 'T' THEN size ELSE 0 END) > 0)"""
)
RICH_DOUBLES = OHLC + " buy_volume sell_volume cvd bar_cvd_delta session_cvd kyle_lambda kyle_std absorption_intensity absorption_std cancel_ratio spoofing_last signed_sum micro_price buy_ratio cvd_velocity"


def rich(spark, sf_dir):
    return O.rich_bars(tick_features(spark, sf_dir), DAY, RICH)


@query(
    "a5_a6_rich_bars",
    f"{V.TICKS}, {RICH_CTE} SELECT *, CASE WHEN bar_cvd_delta > 1 THEN 1 WHEN bar_cvd_delta < -1 THEN -1 ELSE 0 END::BIGINT AS cvd_net_direction FROM rich",
    RICH_DOUBLES,
)
def rich_bars(spark, sf_dir):
    return rich(spark, sf_dir)


@query(
    "a29_bar_liquidity",
    f"""{V.TICKS}, {RICH_CTE} SELECT symbol, bar_ts, greatest(tick_count, 1)::DOUBLE AS num_trades, volume / greatest(tick_count, 1) AS avg_trade_size,
    buy_ratio AS absorption_bar, (buy_volume - sell_volume) / greatest(buy_volume + sell_volume, 1e-9) AS order_flow_imbalance FROM rich""",
    "num_trades avg_trade_size absorption_bar order_flow_imbalance",
)
def bar_liquidity(spark, sf_dir):
    return O.liquidity_columns(rich(spark, sf_dir)).select("symbol", "bar_ts", "num_trades", "avg_trade_size", "absorption_bar", "order_flow_imbalance")


@query(
    "a7_obi_reversals",
    V.BOOK
    + """, o AS (SELECT symbol, ts_event, sequence, date_trunc('day', ts_event) AS bar_ts, sign(list_sum(bid_sz) - list_sum(ask_sz)) AS s FROM book)
SELECT symbol, bar_ts, sum(CASE WHEN p IS NOT NULL AND s <> p THEN 1 ELSE 0 END)::BIGINT AS reversals
FROM (SELECT *, lag(s) OVER (PARTITION BY symbol, bar_ts ORDER BY ts_event, sequence) AS p FROM o) GROUP BY ALL""",
)
def obi_reversals(spark, sf_dir):
    rows = V.book(spark, sf_dir).withColumn("obi", B.depth("bid_sz") - B.depth("ask_sz"))
    return O.sign_reversals(rows, DAY, "obi")


GRID = """grid AS (SELECT b.symbol, b.bar_ts, s.slice FROM (SELECT DISTINCT symbol, bar_ts FROM parts) b CROSS JOIN (SELECT unnest(range(0, 12))::INT AS slice) s),
filled AS (SELECT g.symbol, g.bar_ts, g.slice, {cols} FROM grid g LEFT JOIN parts p USING (symbol, bar_ts, slice))"""
AGREE = "coalesce(greatest(sum((({c}) > 0)::INT), sum((({c}) < 0)::INT))::DOUBLE / nullif(sum((({c}) <> 0)::INT), 0), 0)"
SLICE = "least(((epoch_us(ts_event) - epoch_us(bar_ts)) // 7200000000), 11)::INT"


@query(
    "a8_intrabar_slices",
    f"""{V.TICKS}, {TICK_FEATURES_CTE}, parts AS (
  SELECT symbol, bar_ts, {SLICE} AS slice, max(spoofing_ratio) AS spoof, max(cancel_ratio) AS cancel, avg(absorption_intensity) AS absorb,
         max(CASE WHEN size <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS ofi,
         last(cvd ORDER BY ts_event, sequence) - first(cvd ORDER BY ts_event, sequence) AS cvd_d, avg(size::DOUBLE) AS size_m
  FROM tf GROUP BY ALL), """
    + GRID.format(cols=", ".join(f"coalesce(p.{c}, 0) AS {c}" for c in ("spoof", "cancel", "absorb", "ofi", "cvd_d", "size_m")))
    + f""", agg AS (SELECT symbol, bar_ts, max(spoof) AS spoof_peak_slice, avg(spoof) AS spoof_mean, max(cancel) AS cancel_burst,
    CASE WHEN avg(absorb) < 1e-12 THEN 0 ELSE stddev_pop(absorb) / (avg(absorb) + 1e-12) END AS absorption_speed, max(absorb) AS absorption_slice_max,
    avg(absorb) FILTER (slice < 4) AS t0, avg(absorb) FILTER (slice BETWEEN 4 AND 7) AS t1, avg(absorb) FILTER (slice > 7) AS t2,
    max(abs(cvd_d)) / 7200.0 AS cvd_velocity_max, {AGREE.format(c='cvd_d')} AS cvd_direction_pct,
    sum(cvd_d) FILTER (slice < 4) AS early, sum(cvd_d) FILTER (slice > 7) AS late, max(ofi) AS ofi_peak_slice,
    CASE WHEN avg(size_m) < 1e-12 THEN 0 ELSE stddev_pop(size_m) / (avg(size_m) + 1e-12) END AS size_dispersion FROM filled GROUP BY ALL)
SELECT symbol, bar_ts, spoof_peak_slice, (spoof_mean > 1e-9 AND spoof_peak_slice >= 2 * spoof_mean)::BIGINT AS spoof_burst_flag, cancel_burst, absorption_speed,
  absorption_slice_max, CASE WHEN abs(t1 - t0) <= 1e-6 + 1e-5 * abs(t0) AND abs(t2 - t0) <= 1e-6 + 1e-5 * abs(t0) THEN 'uniform'
    WHEN t0 >= t1 AND t0 >= t2 THEN 'early' WHEN t1 >= t2 THEN 'mid' ELSE 'late' END AS pressure_phase,
  cvd_velocity_max, cvd_direction_pct, (early - late) / (abs(early) + abs(late) + 1e-9) AS cvd_early_vs_late, ofi_peak_slice, size_dispersion FROM agg""",
    "spoof_peak_slice cancel_burst absorption_speed absorption_slice_max cvd_velocity_max cvd_direction_pct cvd_early_vs_late ofi_peak_slice size_dispersion",
)
def intrabar_slices(spark, sf_dir):
    return O.intrabar_slices(tick_features(spark, sf_dir), 86400, 12)


BOOK_SLICES = (
    V.BOOK
    + f""", raw AS (SELECT symbol, ts_event, sequence, date_trunc('day', ts_event) AS bar_ts, list_sum(bid_sz) AS bd, list_sum(ask_sz) AS ad,
   bid_px[1] AS b0, ask_px[1] AS a0, bid_sz[1] AS bs, ask_sz[1] AS az FROM book),
x AS (SELECT *, {SLICE} AS slice, a0 - b0 AS spr, (bd - ad) / (bd + ad) AS imb, abs((a0 * bs + b0 * az) / (bs + az) - (a0 + b0) / 2) AS dev, bs / bd AS bw, az / ad AS aw,
   row_number() OVER (PARTITION BY symbol, bar_ts, {SLICE} ORDER BY ts_event, sequence) AS pos FROM raw),
parts AS (SELECT symbol, bar_ts, slice, max(spr) AS sp, avg(imb) AS im, max(bd) AS bdm, max(ad) AS adm, max(dev) AS mp, max(bw) AS bwm, max(aw) AS awm,
   CASE WHEN count(*) > 1 THEN regr_slope(bd, pos) ELSE 0 END AS bsl, CASE WHEN count(*) > 1 THEN regr_slope(ad, pos) ELSE 0 END AS asl,
   last(bd ORDER BY pos) - first(bd ORDER BY pos) - (last(ad ORDER BY pos) - first(ad ORDER BY pos)) AS chg FROM x GROUP BY ALL), """
    + GRID.format(cols=", ".join([f"coalesce(p.{c}, 0) AS {c}" for c in ("sp", "im", "bdm", "adm", "mp", "bwm", "awm")] + ["p.bsl", "p.asl", "p.chg"]))
    + f""", book_bars AS (SELECT symbol, bar_ts, max(sp) AS mbp_spread_max, avg(sp) AS mbp_spread_mean, stddev_pop(sp) AS mbp_spread_std, max(bdm) AS mbp_depth_bid_max,
  max(adm) AS mbp_depth_ask_max, max(bdm + adm) AS mbp_depth_sum_max, (avg(bdm + adm) > 1e-9 AND max(bdm + adm) >= 2 * avg(bdm + adm))::BIGINT AS mbp_depth_shock_flag, max(abs(im)) AS mbp_imbalance_peak, first(im ORDER BY abs(im) DESC, slice) AS mbp_imbalance_signed_peak,
  avg(im) AS mbp_imbalance_mean, {AGREE.format(c='im')} AS mbp_imbalance_direction_pct, max(mp) AS mbp_microprice_dev_max, max(bwm) AS mbp_wall_bid_peak, max(awm) AS mbp_wall_ask_peak,
  avg(bsl) AS mbp_bid_slope_intrabar, avg(asl) AS mbp_ask_slope_intrabar, avg(chg) AS mbp_depth_accel FROM filled GROUP BY ALL)
"""
)
BOOK_BAR_DOUBLES = "mbp_spread_max mbp_spread_mean mbp_spread_std mbp_depth_bid_max mbp_depth_ask_max mbp_depth_sum_max mbp_imbalance_peak mbp_imbalance_signed_peak mbp_imbalance_mean mbp_imbalance_direction_pct mbp_microprice_dev_max mbp_wall_bid_peak mbp_wall_ask_peak mbp_bid_slope_intrabar mbp_ask_slope_intrabar mbp_depth_accel"


@query("a9_intrabar_book", BOOK_SLICES + "SELECT * FROM book_bars", BOOK_BAR_DOUBLES)
def intrabar_book(spark, sf_dir):
    return O.intrabar_book(V.book(spark, sf_dir), 86400, 12)




@query(
    "p22_j9_book_coverage",
    V.BOOK + ", " + TRADE_BARS_CTE.format(unit="day") + """, cnt AS (SELECT symbol, date_trunc('day', ts_event) AS bar_ts, count(*) AS n FROM book GROUP BY ALL)
SELECT t.symbol, t.bar_ts, t.tick_count, least(coalesce(c.n, 0) / 24.0, 1.0)::DOUBLE AS mbp_bar_coverage FROM trade_bars t LEFT JOIN cnt c USING (symbol, bar_ts)""",
    "mbp_bar_coverage",
)
def book_coverage(spark, sf_dir):
    bars = O.trade_bars(V.ticks(spark, sf_dir), DAY).select("symbol", "bar_ts", "tick_count")
    return O.book_coverage(bars, V.book(spark, sf_dir), 86400, expected_seconds=3600)


@query(
    "f31_depth_source",
    BOOK_SLICES.replace("WITH ", "WITH ", 1)
    + ", "
    + TRADE_BARS_CTE.format(unit="day")
    + """, cnt AS (SELECT symbol, date_trunc('day', ts_event) AS bar_ts, count(*) AS n FROM book GROUP BY ALL)
SELECT t.symbol, t.bar_ts, CASE WHEN c.n > 0 THEN b.mbp_imbalance_signed_peak ELSE 0 END AS lob_depth_imbalance,
  CASE WHEN c.n > 0 THEN b.mbp_imbalance_signed_peak ELSE (t.buy_volume - t.sell_volume) / greatest(t.buy_volume + t.sell_volume, 1e-9) END AS lob_imbalance,
  (coalesce(c.n, 0) > 0)::BIGINT AS lob_imbalance_is_depth
FROM trade_bars t LEFT JOIN cnt c USING (symbol, bar_ts) LEFT JOIN book_bars b USING (symbol, bar_ts)""",
    "lob_depth_imbalance lob_imbalance",
)
def depth_source(spark, sf_dir):
    book = V.book(spark, sf_dir)
    bars = O.liquidity_columns(O.trade_bars(V.ticks(spark, sf_dir), DAY))
    bars = O.book_coverage(bars, book, 86400, expected_seconds=3600).join(O.intrabar_book(book, 86400, 12), ["symbol", "bar_ts"], "left")
    return O.depth_source(bars).select("symbol", "bar_ts", "lob_depth_imbalance", "lob_imbalance", "lob_imbalance_is_depth")


BW = "PARTITION BY symbol ORDER BY bar_ts"


@query(
    "w13_w14_w15_technicals",
    f"""{V.TICKS}, {RICH_CTE}, a AS (SELECT *, close - pc AS ch FROM {ATR.format(src='rich')}),
g AS (SELECT *, CASE WHEN ch IS NOT NULL THEN greatest(ch, 0) END AS gain, CASE WHEN ch IS NOT NULL THEN greatest(-ch, 0) END AS loss FROM a)
SELECT symbol, bar_ts, high - low AS bar_range, least(abs(close - open) / greatest(high - low, 1e-8), 1) AS body_ratio, atr_14,
 coalesce(100 - 100 / (1 + avg(gain) OVER w14 / greatest(avg(loss) OVER w14, 1e-8)), 0) AS rsi_14,
 coalesce((cvd - lag(cvd, 3) OVER w) / 3, 0) AS cvd_slope_3b, coalesce(close / lag(close, 6) OVER w - 1, 0) AS return_6b,
 volume / greatest(avg(volume) OVER w6, 1) AS volume_ratio_6b, coalesce((cvd - lag(cvd, 6) OVER w) / 6, 0) AS cvd_slope_6b,
 coalesce(close / lag(close, 12) OVER w - 1, 0) AS return_1h, volume / greatest(avg(volume) OVER w12, 1) AS volume_ratio_1h,
 coalesce((cvd - lag(cvd, 12) OVER w) / 12, 0) AS cvd_slope_1h,
 (close - micro_price) / greatest(micro_price, 1e-8) AS vwap_dist, greatest(least(bar_cvd_delta / greatest(volume, 1), 1), -1) AS cvd_velocity_norm_by_volume
FROM g WINDOW w AS ({BW}), w14 AS ({BW} ROWS 13 PRECEDING), w6 AS ({BW} ROWS 5 PRECEDING), w12 AS ({BW} ROWS 11 PRECEDING)""",
    "bar_range body_ratio atr_14 rsi_14 cvd_slope_3b return_6b volume_ratio_6b cvd_slope_6b return_1h volume_ratio_1h cvd_slope_1h vwap_dist cvd_velocity_norm_by_volume",
)
def technicals(spark, sf_dir):
    out = O.technicals(rich(spark, sf_dir), hours={"1h": 12})
    names = "symbol bar_ts bar_range body_ratio atr_14 rsi_14 cvd_slope_3b return_6b volume_ratio_6b cvd_slope_6b return_1h volume_ratio_1h cvd_slope_1h vwap_dist cvd_velocity_norm_by_volume"
    return out.select(*names.split())


@query(
    "w16_session_run_cvd",
    f"""{V.TICKS}, {RICH_CTE.replace("date_trunc('day'", "date_trunc('hour'")},
m AS (SELECT symbol, bar_ts, cvd, hour(bar_ts) * 60 + minute(bar_ts) AS mi FROM rich),
s AS (SELECT *, CASE WHEN mi >= 420 AND mi < 720 THEN 'london' WHEN mi >= 720 AND mi < 810 THEN 'overlap' WHEN mi >= 810 AND mi < 1200 THEN 'ny' ELSE 'asia' END AS session FROM m),
n AS (SELECT *, coalesce((session <> lag(session) OVER ({BW}))::INT, 0) AS new, lag(cvd) OVER ({BW}) AS pcvd FROM s),
r AS (SELECT *, sum(new) OVER ({BW}) AS run FROM n),
d AS (SELECT *, cvd - first_value(cvd) OVER (PARTITION BY symbol, run ORDER BY bar_ts) AS delta,
      coalesce(last_value(CASE WHEN new = 1 THEN pcvd END IGNORE NULLS) OVER ({BW}), 0) AS cvd_prev_session FROM r),
z AS (SELECT *, count(*) OVER p AS c, avg(delta) OVER p AS mu, stddev_samp(delta) OVER p AS sd FROM d WINDOW p AS (PARTITION BY symbol, run ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, bar_ts, session, cvd_prev_session, delta AS cvd_session_open_delta, CASE WHEN c >= 3 AND sd > 1e-12 THEN (delta - mu) / sd ELSE 0 END AS cvd_session_zscore_causal FROM z""",
    "cvd_prev_session cvd_session_open_delta cvd_session_zscore_causal",
)
def session_run_cvd(spark, sf_dir):
    bars = O.rich_bars(tick_features(spark, sf_dir), HOUR, RICH)
    return O.session_run_cvd(bars).select("symbol", "bar_ts", "session", "cvd_prev_session", "cvd_session_open_delta", "cvd_session_zscore_causal")


@query(
    "w41_regime_w42_vote",
    f"""{V.TICKS}, {RICH_CTE}, a AS (SELECT *, (tick_count % 4)::DOUBLE AS hawkes_intensity FROM {ATR.format(src='rich')}),
z AS (SELECT *, count(*) OVER w AS n, quantile_cont(atr_14, 0.5) OVER w AS atr_med, avg(hawkes_intensity) OVER w AS hm, stddev_samp(hawkes_intensity) OVER w AS hs,
  quantile_cont(abs(bar_cvd_delta), 0.5) OVER w AS cref FROM a WINDOW w AS ({BW} ROWS 11 PRECEDING)),
q AS (SELECT *, CASE WHEN n >= 4 AND atr_med <> 0 THEN atr_14 / atr_med ELSE 1 END AS ar, CASE WHEN n >= 4 THEN (hawkes_intensity - hm) / (hs + 1e-9) ELSE 0 END AS hz, CASE WHEN n >= 4 THEN cref ELSE 0 END AS cr FROM z),
l AS (SELECT *, CASE WHEN tick_count / 3.0 < 0.30 THEN 'low_liquidity' WHEN ar > 1.5 AND hz > 1.5 THEN 'volatile'
  WHEN ar > 0.8 AND (abs(bar_cvd_delta) > cr + 1e-12 OR buy_ratio > 0.55) THEN 'trending' ELSE 'ranging' END AS regime_label,
  (CASE WHEN bar_cvd_delta > 1 THEN 1 WHEN bar_cvd_delta < -1 THEN -1 ELSE 0 END) + (CASE WHEN buy_volume - sell_volume > 0.05 * (buy_volume + sell_volume) THEN 1 WHEN sell_volume - buy_volume > 0.05 * (buy_volume + sell_volume) THEN -1 ELSE 0 END) + sign(cvd)::INT AS vote FROM q)
SELECT symbol, bar_ts, regime_label, CASE regime_label WHEN 'trending' THEN 0 WHEN 'ranging' THEN 1 WHEN 'volatile' THEN 2 ELSE 3 END::BIGINT AS regime_cluster,
  CASE WHEN vote >= 2 THEN 1 WHEN vote <= -2 THEN -1 ELSE 0 END::BIGINT AS event_direction FROM l""",
)
def regime_and_vote(spark, sf_dir):
    bars = O.liquidity_columns(O.with_atr(rich(spark, sf_dir))).withColumns(
        {"hawkes_intensity": (F.col("tick_count") % 4).cast("double"), "trend_strength": F.col("buy_ratio"), "mbp_bar_coverage": F.col("tick_count") / 3.0, "kalman_direction": F.signum("cvd")}
    )
    out = O.direction_vote(O.regime(bars, frame=12, least=4))
    return out.select("symbol", "bar_ts", "regime_label", "regime_cluster", "event_direction")


@query(
    "f30_proxy_fill",
    f"""{V.TICKS}, {RICH_CTE}, a AS (SELECT * FROM {ATR.format(src='rich')})
SELECT symbol, bar_ts, coalesce((buy_volume - sell_volume) / nullif(buy_volume + sell_volume, 0), 0) AS obi, cancel_ratio * 0.85 AS spoofing_ratio, cancel_ratio * 86400 AS spoofing_duration,
 least(least(absorption_intensity, 1) * cancel_ratio * 2, 1) AS liquidity_trap, 86400.0 / greatest(tick_count, 1) AS inter_event_time, micro_price,
 buy_ratio * 2 AS bid_wall_strength, (1 - buy_ratio) * 2 AS ask_wall_strength, abs(close - micro_price) / 1e-12 / 1e15 AS wall_distance_scaled,
 coalesce(abs(open - pc) / greatest(atr_14, 1e-12), 0) / 1e9 AS gap_scaled, CASE WHEN high > low THEN volume / (high - low + 1e-15) ELSE 0 END AS liquidity_density FROM a""",
    "obi spoofing_ratio spoofing_duration liquidity_trap inter_event_time micro_price bid_wall_strength ask_wall_strength wall_distance_scaled gap_scaled liquidity_density",
    digits=4,
)
def proxy_fill(spark, sf_dir):
    out = O.proxy_fill(O.with_atr(rich(spark, sf_dir)), 86400)
    return out.select(
        "symbol", "bar_ts", "obi", "spoofing_ratio", "spoofing_duration", "liquidity_trap", "inter_event_time", "micro_price", "bid_wall_strength", "ask_wall_strength",
        (F.col("distance_to_wall") / 1e15).alias("wall_distance_scaled"), (F.col("gap_size") / 1e9).alias("gap_scaled"), "liquidity_density",
    )


LEVELS_SQL = V.TICKS + """, d AS (SELECT symbol, ts_event::DATE AS day, max(price) AS h, min(price) AS l FROM ticks GROUP BY ALL),
w AS (SELECT symbol, date_trunc('week', ts_event)::DATE AS week, max(price) AS h, min(price) AS l FROM ticks GROUP BY ALL),
"""
LEVELS_END = """ SELECT symbol, ts_event, sequence, pdh, pdl, pwh, pwl, round(pdh - price, 4) AS dist_to_pdh, round(price - pdl, 4) AS dist_to_pdl,
 CASE WHEN pdh - pdl = 0 THEN 0.5 ELSE greatest(least((price - pdl) / (pdh - pdl), 1), 0) END AS price_position FROM j"""
LEVEL_DOUBLES = "pdh pdl pwh pwl dist_to_pdh dist_to_pdl price_position"


@query(
    "a14_w32_previous_levels",
    LEVELS_SQL
    + """dl AS (SELECT symbol, day, lag(h) OVER (PARTITION BY symbol ORDER BY day) AS h, lag(l) OVER (PARTITION BY symbol ORDER BY day) AS l FROM d),
wl AS (SELECT symbol, week, lag(h) OVER (PARTITION BY symbol ORDER BY week) AS h, lag(l) OVER (PARTITION BY symbol ORDER BY week) AS l FROM w),
j AS (SELECT t.*, coalesce(dl.h, price) AS pdh, coalesce(dl.l, price) AS pdl, coalesce(wl.h, price) AS pwh, coalesce(wl.l, price) AS pwl FROM ticks t
  JOIN dl ON t.symbol = dl.symbol AND t.ts_event::DATE = dl.day JOIN wl ON t.symbol = wl.symbol AND date_trunc('week', t.ts_event)::DATE = wl.week)"""
    + LEVELS_END,
    LEVEL_DOUBLES,
)
def previous_levels(spark, sf_dir):
    return O.period_levels(V.ticks(spark, sf_dir)).select("symbol", "ts_event", "sequence", *LEVEL_DOUBLES.split())


@query(
    "a14_calendar_levels",
    LEVELS_SQL
    + """c AS (SELECT t.*, dl.h AS dh, dl.l AS dlo, wl.h AS wh, wl.l AS wlo FROM ticks t
  LEFT JOIN d dl ON t.symbol = dl.symbol AND t.ts_event::DATE = dl.day + 1 LEFT JOIN w wl ON t.symbol = wl.symbol AND date_trunc('week', t.ts_event)::DATE = wl.week + 7),
j AS (SELECT symbol, ts_event, sequence, price,
  coalesce(last_value(dh IGNORE NULLS) OVER f, price) AS pdh, coalesce(last_value(dlo IGNORE NULLS) OVER f, price) AS pdl,
  coalesce(last_value(wh IGNORE NULLS) OVER f, price) AS pwh, coalesce(last_value(wlo IGNORE NULLS) OVER f, price) AS pwl FROM c WINDOW f AS (PARTITION BY symbol ORDER BY ts_event, sequence))"""
    + LEVELS_END,
    LEVEL_DOUBLES,
)
def calendar_levels(spark, sf_dir):
    return O.period_levels(V.ticks(spark, sf_dir), calendar=True).select("symbol", "ts_event", "sequence", *LEVEL_DOUBLES.split())
