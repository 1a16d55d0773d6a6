"""Queries over tick windows, with their SQL. Windows are short here, as the given events are sparse."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.market import is_trade, signed_size
from tapeloom.operators import tickwin as W
from tapeloom.operators.ordered import running
from tapeloom.plans import views as V
from tapeloom.plans.bar_queries import CVD_CTE
from tapeloom.plans.registry import query

KEY = ["symbol", "ts_event", "sequence"]
K = "symbol, ts_event, sequence"
BY = "PARTITION BY symbol ORDER BY ts_event, sequence"
CVD = f"{V.TICKS}, {CVD_CTE}"
TRADES = f"{CVD}, tr AS (SELECT * FROM cvd_ticks WHERE action = 'T')"


def last(n: int) -> str:
    return f"({BY} ROWS {n - 1} PRECEDING)"


def cvd_ticks(spark, sf_dir):
    return running(V.ticks(spark, sf_dir).withColumn("signed", signed_size()), {"cvd": ("sum", "signed")})


def cvd_trades(spark, sf_dir):
    return cvd_ticks(spark, sf_dir).filter(is_trade())


@query(
    "w17_cvd_roc",
    f"""{CVD} SELECT {K}, coalesce(cvd - lag(cvd, 2) OVER w, 0) AS cvd_roc_2, coalesce(cvd - lag(cvd, 5) OVER w, 0) AS cvd_roc_5, coalesce(cvd - lag(cvd, 20) OVER w, 0) AS cvd_roc_20,
 coalesce(cvd - lag(cvd, 2) OVER w, 0) - coalesce(cvd - lag(cvd, 5) OVER w, 0) AS cvd_accel FROM cvd_ticks WINDOW w AS ({BY})""",
    "cvd_roc_2 cvd_roc_5 cvd_roc_20 cvd_accel",
)
def cvd_roc(spark, sf_dir):
    return W.rates_of_change(cvd_ticks(spark, sf_dir), lags=(2, 5, 20)).select(*KEY, "cvd_roc_2", "cvd_roc_5", "cvd_roc_20", "cvd_accel")


@query(
    "w18_micro_atr",
    f"""{V.TICKS}, m AS (SELECT *, abs(price - lag(price) OVER ({BY})) AS mv FROM ticks)
SELECT {K}, CASE WHEN count(mv) OVER {last(20)} >= 5 THEN avg(mv) OVER {last(20)} ELSE 0 END AS micro_atr FROM m""",
    "micro_atr",
)
def micro_atr(spark, sf_dir):
    return W.micro_atr(V.ticks(spark, sf_dir), n=20).select(*KEY, "micro_atr")


@query(
    "w19_w20_trade_pace",
    f"""{V.TICKS}, tr AS (SELECT *, count(*) OVER p AS pc, avg(size) OVER p AS pm, (epoch_us(ts_event) - lag(epoch_us(ts_event)) OVER ({BY})) / 1000.0 AS gap FROM ticks WHERE action = 'T' AND size > 0
   WINDOW p AS ({BY} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
t2 AS (SELECT *, CASE WHEN pc >= 3 THEN size / pm ELSE 1 END AS burst, CASE WHEN count(gap) OVER {last(6)} >= 3 THEN avg(gap) OVER {last(6)} END AS iet FROM tr),
j AS (SELECT k.symbol, k.ts_event, k.sequence, t2.burst, t2.iet FROM ticks k LEFT JOIN t2 ON k.sequence = t2.sequence)
SELECT {K}, coalesce(last_value(burst IGNORE NULLS) OVER w, 1) AS volume_burst, coalesce(last_value(iet IGNORE NULLS) OVER w, 0) AS trade_interval_ms FROM j WINDOW w AS ({BY})""",
    "volume_burst trade_interval_ms",
    digits=5,
)
def trade_pace(spark, sf_dir):
    return W.trade_pace(V.ticks(spark, sf_dir), 8, 3, 6, 3).select(*KEY, "volume_burst", "trade_interval_ms")


@query(
    "w21_tape_speed",
    f"""{V.TICKS} SELECT {K}, (sum((action = 'T')::INT) OVER (PARTITION BY symbol ORDER BY ts_event RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))::BIGINT AS tape_speed FROM ticks""",
)
def tape_speed(spark, sf_dir):
    return W.tape_speed(V.ticks(spark, sf_dir), 86400).select(*KEY, "tape_speed")


@query(
    "w22_kyle_lambda",
    f"""{TRADES}, s AS (SELECT *, (price - lag(price) OVER ({BY})) / greatest(size, 1e-8) AS sg FROM tr)
SELECT {K}, coalesce(CASE WHEN count(sg) OVER {last(8)} >= 3 THEN quantile_cont(abs(sg), 0.5) OVER {last(4)} ELSE abs(sg) END, 0) AS kyle_lambda,
 coalesce(CASE WHEN sg IS NOT NULL AND count(sg) OVER {last(8)} >= 4 THEN greatest(least((sg - avg(sg) OVER {last(8)}) / (stddev_pop(sg) OVER {last(8)} + 1e-8), 4), -4) ELSE 0 END, 0) AS kyle_z FROM s""",
    "kyle_lambda kyle_z",
)
def kyle(spark, sf_dir):
    return W.kyle_lambda(cvd_trades(spark, sf_dir), 8, 4, 3, 4).select(*KEY, "kyle_lambda", "kyle_z")


@query(
    "w23_vnet",
    f"""{TRADES}, s AS (SELECT *, CASE WHEN size >= (CASE WHEN count(*) OVER {last(6)} >= 3 THEN avg(size) OVER {last(6)} ELSE 1 END) * 1.5 THEN 2 ELSE 1 END AS wt FROM tr WHERE size > 0)
SELECT {K}, CASE WHEN count(*) OVER {last(5)} >= 2 THEN greatest(least(sum(size * wt * (CASE side WHEN 'A' THEN 1 ELSE -1 END)) OVER {last(5)}::DOUBLE / sum(size * wt) OVER {last(5)}, 1), -1) ELSE 0 END AS vnet FROM s""",
    "vnet",
)
def vnet(spark, sf_dir):
    return W.vnet(cvd_trades(spark, sf_dir), 5, 6, 3, 1.5, 2).select(*KEY, "vnet")


@query(
    "w24_absorption",
    f"""{TRADES}, s AS (SELECT *, CASE WHEN count(*) OVER f >= 4 THEN abs(cvd - first_value(cvd) OVER f) / greatest(abs(price - first_value(price) OVER f), 0.25) END AS rw FROM tr WINDOW f AS ({BY} ROWS 4 PRECEDING)),
b AS (SELECT *, CASE WHEN count(rw) OVER p >= 3 THEN greatest(quantile_cont(rw, 0.5) OVER p, 1e-6) ELSE 500 END AS sc FROM s WINDOW p AS ({BY} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT {K}, CASE WHEN rw IS NULL THEN 0 ELSE least(ln(1 + rw / sc), 25) END AS absorption_intensity FROM b""",
    "absorption_intensity",
)
def absorption(spark, sf_dir):
    return W.absorption(cvd_trades(spark, sf_dir), 4, buffer=6, least=3).select(*KEY, "absorption_intensity")


@query(
    "w25_momentum",
    f"""{TRADES}, s AS (SELECT *, lag(cvd, 3) OVER ({BY}) AS past, count(*) OVER {last(6)} AS n6, count(*) OVER {last(4)} AS n4,
  sign(avg(price) OVER {last(3)} - avg(price) OVER ({BY} ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING)) AS pd, sign(avg(cvd) OVER {last(3)} - avg(cvd) OVER ({BY} ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING)) AS cd,
  max(price) OVER {last(4)} - min(price) OVER {last(4)} AS r4, first_value(price) OVER {last(4)} AS f4, max(price) OVER {last(6)} AS mx, min(price) OVER {last(6)} AS mn, first_value(price) OVER {last(6)} AS f6 FROM tr)
SELECT {K}, coalesce((cvd - past) / greatest(abs(cvd), abs(past), 1), 0) AS cvd_momentum, CASE WHEN n6 >= 6 AND pd <> 0 THEN (CASE WHEN pd = cd THEN 1.0 ELSE -1.0 END) ELSE 0 END::DOUBLE AS cvd_price_divergence,
 CASE WHEN n4 >= 3 AND r4 > 0 THEN least(abs(price - f4) / r4, 1) ELSE 0 END AS trend_strength,
 CASE WHEN n6 >= 3 AND mx > mn THEN (CASE WHEN price > f6 THEN mx - price ELSE price - mn END) / (mx - mn) ELSE 0 END AS correction_depth FROM s""",
    "cvd_momentum cvd_price_divergence trend_strength correction_depth",
)
def momentum(spark, sf_dir):
    return W.momentum(cvd_trades(spark, sf_dir), 4, 6, 3).select(*KEY, "cvd_momentum", "cvd_price_divergence", "trend_strength", "correction_depth")


@query(
    "w26_liquidity_sweep",
    f"""{V.TICKS}, g AS (SELECT *, list(price) OVER {last(12)} AS p, stddev_pop(price) OVER {last(12)} AS sd FROM ticks),
h AS (SELECT *, len(p) AS n, floor(len(p) * 0.8)::INT AS c FROM g),
x AS (SELECT *, list_max(p[1:c]) AS hi, list_min(p[1:c]) AS lo, list_max(p[c + 1:n]) AS nhi, list_min(p[c + 1:n]) AS nlo FROM h),
z AS (SELECT *, (nhi - hi) / greatest(hi - lo, sd * 2, 1e-8) AS up, (lo - nlo) / greatest(hi - lo, sd * 2, 1e-8) AS dn FROM x)
SELECT {K}, CASE WHEN n < 5 THEN 0 WHEN up > 0.05 AND price < hi THEN least(up * 5, 1) WHEN dn > 0.05 AND price > lo THEN -least(dn * 5, 1) ELSE 0 END AS liquidity_sweep FROM z""",
    "liquidity_sweep",
)
def liquidity_sweep(spark, sf_dir):
    return W.liquidity_sweep(V.ticks(spark, sf_dir).select(*KEY, "price"), 12, 5).select(*KEY, "liquidity_sweep")


@query(
    "w29_snapshot_spoofing",
    f"""{V.TICKS}, a AS (SELECT *, ((sequence * 7) % 50 + 1 + (sequence * 7 + 13) % 50 + 1 + (sequence * 7 + 26) % 50 + 1)::DOUBLE AS tb, ((sequence * 11) % 50 + 1 + (sequence * 11 + 17) % 50 + 1 + (sequence * 11 + 34) % 50 + 1)::DOUBLE AS ta FROM ticks),
b AS (SELECT *, CASE WHEN count(*) OVER {last(20)} >= 3 THEN avg(greatest(tb, ta)) OVER {last(20)} ELSE 1 END AS usual, coalesce(lag(tb) OVER ({BY}) - tb, 0) AS bd, coalesce(lag(ta) OVER ({BY}) - ta, 0) AS ad FROM a),
c AS (SELECT *, CASE WHEN action = 'T' THEN NULL WHEN bd > usual * 0.5 THEN bd WHEN ad > usual * 0.5 THEN ad END AS drp FROM b)
SELECT {K}, least(count(drp) OVER {last(10)}::DOUBLE / greatest(sum((action = 'T')::INT) OVER {last(10)}, 1), 1) AS spoofing_ratio, coalesce(drp / greatest(usual, 1), 0) AS spoofing_duration FROM c""",
    "spoofing_ratio spoofing_duration",
)
def snapshot_spoofing(spark, sf_dir):
    i = F.sequence(F.lit(0), F.lit(9))
    rows = V.ticks(spark, sf_dir).select(
        *KEY,
        "action",
        F.transform(i, lambda k: ((F.col("sequence") * 7 + k * 13) % 50 + 1).cast("double")).alias("bid_sz"),
        F.transform(i, lambda k: ((F.col("sequence") * 11 + k * 17) % 50 + 1).cast("double")).alias("ask_sz"),
    )
    return W.snapshot_spoofing(rows, 10, 20, 3, 0.5).select(*KEY, "spoofing_ratio", "spoofing_duration")


DBY = "PARTITION BY symbol, ts_event::DATE ORDER BY ts_event, sequence"


@query(
    "w30_session_vwap",
    f"""{V.TICKS}, v AS (SELECT *, sum(price * size) OVER d / sum(size) OVER d AS current_vwap, (sum(CASE WHEN side = 'A' THEN size ELSE -size END) OVER d)::DOUBLE AS session_cvd FROM ticks WINDOW d AS ({DBY})),
g AS (SELECT *, price - current_vwap AS dev FROM v)
SELECT {K}, current_vwap, session_cvd, CASE WHEN count(*) OVER f > 1 THEN dev / (stddev_pop(dev) OVER f + 1e-8) ELSE 0 END AS vwap_z_score, coalesce(current_vwap - lag(current_vwap, 1) OVER ({DBY}), 0) AS vwap_slope
FROM g WINDOW f AS ({DBY} ROWS 4 PRECEDING)""",
    "current_vwap session_cvd vwap_z_score vwap_slope",
    digits=7,
)
def session_vwap(spark, sf_dir):
    return W.session_vwap(V.ticks(spark, sf_dir), 5, 1, 2).select(*KEY, "current_vwap", "session_cvd", "vwap_z_score", "vwap_slope")


@query(
    "w31_daily_context",
    f"""{V.TICKS}, d AS (SELECT symbol, ts_event::DATE AS day, greatest(max(price) - min(price), 0.01) AS rg FROM ticks GROUP BY ALL),
a AS (SELECT *, greatest(CASE WHEN count(*) OVER p >= 3 THEN quantile_cont(rg, 0.5) OVER p ELSE 0.8 END, 0.01) AS adr FROM d WINDOW p AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
r AS (SELECT t.*, adr, max(price) OVER w AS hi, min(price) OVER w AS lo, max(CASE WHEN hour(ts_event) BETWEEN 8 AND 8 THEN price END) OVER w AS ibh, min(CASE WHEN hour(ts_event) = 8 THEN price END) OVER w AS ibl
  FROM ticks t JOIN a ON t.symbol = a.symbol AND t.ts_event::DATE = a.day WINDOW w AS (PARTITION BY t.symbol, t.ts_event::DATE ORDER BY t.ts_event, t.sequence))
SELECT {K}, adr, CASE WHEN hour(ts_event) = 8 THEN 0 WHEN price > ibh THEN 1 WHEN price < ibl THEN -1 ELSE 0 END::BIGINT AS ib_status, greatest(0, adr - (hi - lo)) AS remaining_fuel,
 (greatest(0, adr - (hi - lo)) <= adr * 0.1)::BIGINT AS fuel_exhausted FROM r""",
    "adr remaining_fuel",
)
def daily_context(spark, sf_dir):
    return W.daily_context(V.ticks(spark, sf_dir), 0.01).select(*KEY, "adr", "ib_status", "remaining_fuel", "fuel_exhausted")


@query(
    "w35_regime_features",
    f"""{CVD}, s AS (SELECT *, least(size / greatest(coalesce(avg(size) OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 1), 1e-8), 5) AS volume_ratio, coalesce(abs(cvd - lag(cvd) OVER ({BY})), 0) AS stp,
  abs(lag(cvd, 1) OVER ({BY}) - lag(cvd, 6) OVER ({BY})) AS far, abs(price - lag(price) OVER ({BY})) AS mv, (epoch_us(ts_event) - lag(epoch_us(ts_event)) OVER ({BY})) / 1e6 AS gap, abs(price - lag(price, 5) OVER ({BY})) AS net FROM cvd_ticks),
q AS (SELECT *, quantile_cont(gap, 0.5) OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS base, CASE WHEN count(mv) OVER {last(5)} >= 2 THEN sum(mv) OVER {last(5)} END AS gross,
  coalesce(avg(stp) OVER ({BY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS cvd_impulse, coalesce(avg(far) OVER {last(5)}, 0) AS cvd_persistence FROM s)
SELECT {K}, volume_ratio, cvd_impulse, cvd_persistence, CASE WHEN base IS NULL OR gap IS NULL THEN volume_ratio ELSE least(base / greatest(gap, 1e-6), 5) END AS activity, CASE WHEN net IS NULL OR gross IS NULL THEN 0 ELSE least(net / greatest(gross, 1e-8), 1) END AS trend_efficiency FROM q""",
    "volume_ratio cvd_impulse cvd_persistence activity trend_efficiency",
)
def regime_features(spark, sf_dir):
    return W.regime_features(cvd_ticks(spark, sf_dir), 5, 5).select(*KEY, "volume_ratio", "cvd_impulse", "cvd_persistence", "activity", "trend_efficiency")


@query(
    "w36_shape_features",
    f"""{V.TICKS}, s AS (SELECT *, coalesce(price - lag(price) OVER ({BY}), 0) AS d FROM ticks), md AS (SELECT quantile_cont(size, 0.5) AS m FROM ticks),
q AS (SELECT *, count(*) OVER f AS n, coalesce(stddev_samp(d) OVER f, 0) AS sd, avg(abs(d)) OVER f AS l1, avg(size) OVER f AS vol, skewness(d) OVER f AS sk FROM s WINDOW f AS {last(15)})
SELECT {K}, CASE WHEN n >= 3 THEN sd ELSE 0 END AS shape_std, CASE WHEN n >= 2 THEN l1 ELSE 0 END / greatest(CASE WHEN n >= 3 THEN sd ELSE 0 END, 1e-10) / 1e6 AS shape_trend_scaled, vol / greatest(m, 1e-10) AS shape_liquidity,
 CASE WHEN n >= 3 AND sd > 1e-12 THEN sk ELSE 0 END AS shape_skew FROM q, md""",
    "shape_std shape_trend_scaled shape_liquidity shape_skew",
    digits=5,
)
def shape_features(spark, sf_dir):
    out = W.shape_features(V.ticks(spark, sf_dir), 15)
    return out.select(*KEY, "shape_std", (F.col("shape_trend") / 1e6).alias("shape_trend_scaled"), "shape_liquidity", "shape_skew")


@query(
    "w37_fim_anomaly",
    f"""{V.TICKS}, a AS (SELECT *, ln(price / lag(price) OVER ({BY})) AS lr FROM ticks),
b AS (SELECT *, CASE WHEN count(lr) OVER {last(4)} >= 4 THEN (lr - avg(lr) OVER {last(4)}) / greatest(var_samp(lr) OVER {last(4)}, 1e-8) END AS sc FROM a),
c AS (SELECT *, CASE WHEN count(sc) OVER {last(4)} >= 4 THEN var_samp(sc) OVER {last(4)} END AS fim FROM b)
SELECT {K}, (count(fim) OVER {last(8)} >= 8 AND coalesce(fim > avg(fim) OVER {last(8)} + 1.5 * stddev_samp(fim) OVER {last(8)}, false))::BIGINT AS anomaly FROM c""",
)
def fim(spark, sf_dir):
    return W.fim_anomaly(V.ticks(spark, sf_dir), 4).select(*KEY, "anomaly")


@query(
    "w48_cancel_ratio",
    f"""{V.TICKS}, o AS (SELECT symbol, ts_event, sequence, action, size, sequence % 5 AS order_id FROM ticks WHERE action IN ('A', 'C', 'T')),
l AS (SELECT *, lag(action) OVER x AS was, lag(size) OVER x AS had FROM o WINDOW x AS (PARTITION BY symbol, order_id ORDER BY ts_event, sequence)),
ad AS (SELECT symbol, ts_event, sequence, CASE WHEN count(*) OVER {last(10)} >= 3 THEN avg(size) OVER {last(10)} END AS usual FROM l WHERE action = 'A'),
e AS (SELECT l.*, ad.usual FROM l LEFT JOIN ad USING (symbol, ts_event, sequence) WHERE action IN ('A', 'C')),
m AS (SELECT *, coalesce(last_value(usual IGNORE NULLS) OVER ({BY}), 1) AS mean FROM e),
w AS (SELECT *, CASE WHEN action = 'A' THEN 0 WHEN was = 'A' AND had >= mean * 1.2 THEN 1 ELSE 0.3 END::DOUBLE AS wt FROM m)
SELECT {K}, CASE WHEN count(*) OVER {last(15)} >= 3 THEN avg(wt) OVER {last(15)} ELSE 0 END AS cancel_ratio FROM w""",
    "cancel_ratio",
)
def cancel_ratio(spark, sf_dir):
    rows = V.ticks(spark, sf_dir).withColumn("order_id", F.col("sequence") % 5)  # ids that come back, so that cancels find adds
    return W.cancel_ratio(rows, 15, 10, 3, 1.2).select(*KEY, "cancel_ratio")


FLAG = f"fl AS (SELECT *, (size > 50) AS flag FROM ticks), nw AS (SELECT *, coalesce((flag <> lag(flag) OVER ({BY}))::INT, 0) AS nw FROM fl), rn AS (SELECT *, sum(nw) OVER ({BY}) AS run FROM nw)"


@query(
    "w38_l23_flag_runs",
    f"""{V.TICKS}, {FLAG} SELECT {K}, flag, row_number() OVER (PARTITION BY symbol, run ORDER BY ts_event, sequence) AS run_position, count(*) OVER (PARTITION BY symbol, run) AS run_length,
 min(ts_event) OVER (PARTITION BY symbol, run) AS run_start, max(ts_event) OVER (PARTITION BY symbol, run) AS run_end FROM rn""",
)
def flag_runs(spark, sf_dir):
    return W.runs(V.ticks(spark, sf_dir).withColumn("flag", F.col("size") > 50), "flag").select(*KEY, "flag", "run_position", "run_length", "run_start", "run_end")


@query(
    "w39_forward_delta",
    f"SELECT symbol, ts_event, sequence, lead(price, 3) OVER w - price AS price_fwd_3, (lead(size, 3) OVER w - size)::DOUBLE AS size_fwd_3 FROM ({V.TICKS} SELECT * FROM ticks) WINDOW w AS ({BY})",
    "price_fwd_3 size_fwd_3",
)
def forward_delta(spark, sf_dir):
    rows = W.forward_delta(V.ticks(spark, sf_dir), {"price_fwd_3": "price", "size_fwd_3": "size"}, 3)
    return rows.select(*KEY, "price_fwd_3", F.col("size_fwd_3").cast("double").alias("size_fwd_3"))


def _neighbour(k: int, fn: str) -> tuple[str, str]:
    return f"coalesce(({fn}(side, {k}) OVER w = side)::INT, 0)", f"({fn}(side, {k}) OVER w IS NOT NULL)::INT"


_N = [_neighbour(k, fn) for k in (1, 3, 5) for fn in ("lag", "lead")]


@query(
    "w40_label_stability",
    f"{V.TICKS} SELECT {K}, coalesce(({' + '.join(n[0] for n in _N)})::DOUBLE / nullif({' + '.join(n[1] for n in _N)}, 0), 1) AS label_stability FROM ticks WINDOW w AS ({BY})",
    "label_stability",
)
def label_stability(spark, sf_dir):
    return W.stability(V.ticks(spark, sf_dir), "side").select(*KEY, "label_stability")


@query("w43_turns", f"{V.TICKS}, p AS (SELECT *, lag(side) OVER ({BY}) AS previous FROM ticks) SELECT {K}, side, previous FROM p WHERE previous <> side")
def turns(spark, sf_dir):
    return W.turns(V.ticks(spark, sf_dir), "side").select(*KEY, "side", "previous")


@query("w47_relative_volatility", f"{V.TICKS} SELECT {K}, coalesce(size / nullif(avg(size) OVER {last(200)}, 0), 1) AS relative_volatility FROM ticks", "relative_volatility")
def relative_volatility(spark, sf_dir):
    return W.relative_volatility(V.ticks(spark, sf_dir), "size").select(*KEY, "relative_volatility")


@query(
    "p14_calibration",
    f"""{V.TICKS}, h AS (SELECT *, row_number() OVER ({BY}) AS pos FROM ticks QUALIFY pos <= 2000),
q AS (SELECT symbol, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM h WHERE price > 0 GROUP BY symbol),
p AS (SELECT h.* FROM h JOIN q USING (symbol) WHERE price > 0 AND (q3 - q1 <= 0 OR price BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1))),
st AS (SELECT * FROM (SELECT *, abs(price - lag(price) OVER (PARTITION BY symbol ORDER BY pos)) AS stp FROM p) WHERE stp > 0),
c AS (SELECT symbol, round(stp, 4) AS r, count(*) AS n, min(pos) AS f FROM st GROUP BY ALL HAVING count(*) >= 3),
u AS (SELECT symbol, min(r) AS tick FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, f) AS k FROM c) WHERE k <= 10 GROUP BY symbol),
mv AS (SELECT symbol, quantile_cont(stp, 0.05) AS s5, quantile_cont(stp, 0.25) AS s25 FROM st GROUP BY symbol),
tv AS (SELECT symbol, avg(d) AS vol, count(*) AS n FROM (SELECT symbol, abs(price - lag(price) OVER (PARTITION BY symbol ORDER BY pos)) AS d FROM h WHERE action = 'T') GROUP BY symbol),
sz AS (SELECT symbol, quantile_cont(size, 0.5) AS typical_size FROM h WHERE size > 0 GROUP BY symbol),
b AS (SELECT symbol, avg(price) AS mean_price, stddev_samp(price) AS price_scale FROM p GROUP BY symbol HAVING count(*) >= 10)
SELECT b.symbol, coalesce(tick, s5) AS tick_size, greatest(coalesce(tick, s5), s25) AS min_price_move, typical_size, CASE WHEN tv.n > 10 THEN greatest(vol, coalesce(tick, s5)) ELSE 1 END AS volatility, mean_price, price_scale
FROM b JOIN mv USING (symbol) LEFT JOIN u USING (symbol) JOIN sz USING (symbol) LEFT JOIN tv USING (symbol)""",
    "tick_size min_price_move typical_size volatility mean_price price_scale",
)
def calibration(spark, sf_dir):
    return W.calibration(V.ticks(spark, sf_dir))
