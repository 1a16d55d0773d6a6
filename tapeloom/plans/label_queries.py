"""Queries over labels and weights, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import book as B
from tapeloom.functions.market import is_trade
from tapeloom.operators import bars as O
from tapeloom.operators import labels as L
from tapeloom.operators import tickwin as W
from tapeloom.operators import weights as Q
from tapeloom.plans import views as V
from tapeloom.plans.bar_queries import ATR, TRADE_BARS_CTE
from tapeloom.plans.registry import query

KEY = ["symbol", "ts_event", "sequence"]
K = "symbol, ts_event, sequence"
BY = "PARTITION BY symbol ORDER BY ts_event, sequence"
RULE = L.BarrierRule(horizon=12, tick=0.01)


def mids(spark, sf_dir):
    return V.book(spark, sf_dir).select(*KEY, B.mid().alias("mid_price"), B.spread().alias("spread"))


MIDS_CTE = f"""mids AS (SELECT symbol, ts_event, sequence, (bid_px[1] + ask_px[1]) / 2 AS mid, ask_px[1] - bid_px[1] AS spread FROM book),
steps AS (SELECT *, row_number() OVER ({BY}) AS n, abs(mid - lag(mid) OVER ({BY})) AS stp FROM mids),
vols AS (SELECT *, greatest(coalesce(CASE WHEN count(stp) OVER f >= 5 THEN quantile_cont(stp, 0.5) OVER f END, 0.01::DOUBLE), 0.01::DOUBLE) AS vol,
  greatest(1.0::DOUBLE, 1.0::DOUBLE + 1.0::DOUBLE * spread / 0.01::DOUBLE) AS fl FROM steps WINDOW f AS ({BY} ROWS 49 PRECEDING)),
bases AS (SELECT *, fl * 0.01::DOUBLE AS flp, greatest(vol, fl * 0.01::DOUBLE) AS base FROM vols)"""


def barrier_ctes(prefix: str, h: str, tp: str, sl: str, ne: str, source: str = "bases", keys: str = "symbol") -> str:
    """Labels by a self join over the next h rows; ``keys`` beside the row number identify a row."""
    return f"""{prefix}d AS (SELECT *, greatest(base * {tp}, flp) AS ud, greatest(base * {sl}, flp) AS ld, greatest(base * {ne}, flp) AS nd FROM {source}),
{prefix}j AS (SELECT {', '.join(f'd.{k}' for k in keys.split())}, d.n, min(CASE WHEN f.mid >= d.mid + d.ud OR f.mid <= d.mid - d.ld THEN f.n END) AS hn, max(f.n) AS en
  FROM {prefix}d d LEFT JOIN steps f ON d.symbol = f.symbol AND f.n > d.n AND f.n <= d.n + {h} GROUP BY ALL),
{prefix}r AS (SELECT d.*, hn, en, coalesce(hn, en, d.n) AS sn, h.mid AS hp, e.mid AS ep, e.ts_event AS ets, s.mid AS sp, s.ts_event AS sts
  FROM {prefix}d d JOIN {prefix}j j USING ({keys.replace(' ', ', ')}, n) LEFT JOIN steps h ON h.symbol = d.symbol AND h.n = j.hn LEFT JOIN steps e ON e.symbol = d.symbol AND e.n = j.en
  LEFT JOIN steps s ON s.symbol = d.symbol AND s.n = coalesce(j.hn, j.en, d.n)),
{prefix}o AS (SELECT *, CASE WHEN hp >= mid + ud THEN 'upper_hit' WHEN hn IS NOT NULL THEN 'lower_hit' WHEN en IS NULL THEN 'no_future' WHEN ep - mid >= nd THEN 'timeout_directional_up'
  WHEN ep - mid <= -nd THEN 'timeout_directional_down' ELSE 'timeout_neutral' END AS barrier_hit_type FROM {prefix}r),
{prefix}labeled AS (SELECT *, CASE WHEN barrier_hit_type IN ('upper_hit', 'timeout_directional_up') THEN 0 WHEN barrier_hit_type IN ('lower_hit', 'timeout_directional_down') THEN 1 ELSE 2 END AS bias_label,
  (hn IS NOT NULL)::BIGINT AS tradeability_label, coalesce(sts, ts_event) AS label_end_ts, coalesce(ets, ts_event) AS horizon_end_ts, sn - n AS label_horizon_steps, sp - mid AS realized_return FROM {prefix}o)"""


LABELED = f"{V.BOOK}, {MIDS_CTE}, {barrier_ctes('', '12', '1.5::DOUBLE', '1.0::DOUBLE', '0.5::DOUBLE')}"
L1_COLS = ["bias_label", "tradeability_label", "barrier_hit_type", "label_end_ts", "horizon_end_ts", "label_horizon_steps", "realized_return"]


def labeled(spark, sf_dir):
    return L.triple_barrier(mids(spark, sf_dir), RULE)


@query(
    "l1_j11_triple_barrier",
    f"{LABELED} SELECT {K}, {', '.join(L1_COLS)}, mid + ud AS upper_barrier, mid - ld AS lower_barrier, nd AS neutral_distance FROM labeled",
    "realized_return upper_barrier lower_barrier neutral_distance",
)
def triple_barrier(spark, sf_dir):
    return labeled(spark, sf_dir).select(*KEY, *L1_COLS, "upper_barrier", "lower_barrier", "neutral_distance")


GRID = "g AS (SELECT * FROM (VALUES (4), (12)) a(hz), (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) b(tpm), (VALUES (1.0::DOUBLE)) c(slm), (VALUES (0.5::DOUBLE), (1.5::DOUBLE)) d(nem)), gb AS (SELECT * FROM bases, g)"


@query(
    "l2_j14_label_grid",
    f"""{V.BOOK}, {MIDS_CTE}, {GRID}, {barrier_ctes('g', 'd.hz', 'tpm', 'slm', 'nem', 'gb', 'symbol hz tpm slm nem')},
s AS (SELECT hz::BIGINT AS horizon, tpm AS tp_mult, slm AS sl_mult, nem AS neutral_mult, count(*) AS rows, avg((bias_label = 0)::INT) AS long_share, avg((bias_label = 1)::INT) AS short_share, avg((bias_label = 2)::INT) AS neutral_share,
  avg(tradeability_label) AS event_share, avg(realized_return) AS realized_return_mean, stddev_pop(realized_return) AS realized_return_std FROM glabeled GROUP BY ALL),
t AS (SELECT *, long_share + short_share AS directional_share, abs(long_share - short_share) / greatest(long_share + short_share, 1.0 / rows) AS long_short_imbalance FROM s)
SELECT *, abs(directional_share - 0.12) + 0.25 * long_short_imbalance + abs(event_share - least(directional_share, 0.12)) + CASE WHEN directional_share BETWEEN 0.05 AND 0.25 THEN 0 ELSE 1 + abs(directional_share - 0.12) END
  + CASE WHEN neutral_share <= 0 THEN 1 ELSE 0 END + CASE WHEN long_short_imbalance > 0.6 THEN 0.5 ELSE 0 END AS score FROM t""",
    "tp_mult sl_mult neutral_mult long_share short_share neutral_share event_share realized_return_mean realized_return_std directional_share long_short_imbalance score",
)
def label_grid(spark, sf_dir):
    return L.label_grid(mids(spark, sf_dir), [4, 12], [1.0, 2.0], [1.0], [0.5, 1.5], RULE)


@query(
    "l3_rule_summary",
    f"""{LABELED} SELECT 'base' AS rule, sum((bias_label = 0)::INT)::BIGINT AS long_count, sum((bias_label = 1)::INT)::BIGINT AS short_count, sum((bias_label = 2)::INT)::BIGINT AS neutral_count,
 avg((base * 1.5 <= flp)::INT) AS tp_clamp_share, avg((base * 1.0 <= flp)::INT) AS sl_clamp_share, avg((base * 0.5 <= flp)::INT) AS neutral_clamp_share, avg(tradeability_label) AS event_share,
 quantile_cont(ud / 0.01::DOUBLE, 0.5) AS upper_median, quantile_cont(ud / 0.01::DOUBLE, 0.95) AS upper_p95, quantile_cont(ld / 0.01::DOUBLE, 0.5) AS lower_median, quantile_cont(ld / 0.01::DOUBLE, 0.95) AS lower_p95 FROM labeled""",
    "tp_clamp_share sl_clamp_share neutral_clamp_share event_share upper_median upper_p95 lower_median lower_p95",
)
def rule_summary(spark, sf_dir):
    return L.rule_summary(mids(spark, sf_dir), RULE, "base")


@query("p29_rule_sample")
def rule_sample(spark, sf_dir):
    return L.compare_rules(mids(spark, sf_dir), RULE, L.BarrierRule(horizon=6, tick=0.01, tp=1.0), rows=200, seed=7)


@query(
    "l4_terminal_labels",
    f"""{V.TICKS}, a AS (SELECT *, coalesce(last_value(price) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) - price, 0) AS fr FROM ticks),
b AS (SELECT *, CASE WHEN fr > 40.0 THEN 0 WHEN fr < -40.0 THEN 1 ELSE 2 END AS bias_label FROM a),
c AS (SELECT *, greatest(coalesce(CASE WHEN count(CASE WHEN bias_label < 2 THEN fr END) OVER p >= 8 THEN quantile_cont(CASE WHEN bias_label < 2 THEN abs(fr) END, 0.7) OVER p END, 80.0), 64.0) AS quality_threshold FROM b
  WINDOW p AS ({BY} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT {K}, fr AS future_return, bias_label::BIGINT AS bias_label, quality_threshold, CASE WHEN bias_label = 2 THEN 0 WHEN abs(fr) >= quality_threshold THEN 2 ELSE 1 END::BIGINT AS signal_quality,
 CASE bias_label WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END::BIGINT AS long_label, CASE bias_label WHEN 1 THEN 1 WHEN 0 THEN 0 ELSE 2 END::BIGINT AS short_label FROM c""",
    "future_return quality_threshold",
)
def terminal_labels(spark, sf_dir):
    out = L.terminal_labels(V.ticks(spark, sf_dir), 8, 8.0, least=8, frame=30)
    return out.select(*KEY, "future_return", "bias_label", "quality_threshold", "signal_quality", "long_label", "short_label")


def touch_sql(h: str, source: str, floor: str = "0", up: str = "target", down: str = "target") -> str:
    return f"""td AS (SELECT *, row_number() OVER ({BY}) AS n, greatest(threshold, 0.01::DOUBLE) * 1.0::DOUBLE AS sl, greatest(greatest(threshold, 0.01::DOUBLE) * 1.5::DOUBLE, {floor} * 0.01::DOUBLE) AS target FROM {source}),
tx AS (SELECT *, {up} AS tl, {down} AS tsh FROM td),
tj AS (SELECT d.symbol, d.n, min(CASE WHEN f.price - d.price >= d.tl OR f.price - d.price <= -d.sl THEN f.n END) AS ln, min(CASE WHEN f.price - d.price <= -d.tsh OR f.price - d.price >= d.sl THEN f.n END) AS sn
  FROM tx d LEFT JOIN td f ON d.symbol = f.symbol AND f.n > d.n AND f.n <= d.n + {h} GROUP BY ALL),
tp AS (SELECT d.*, ln, sn, coalesce(l.price - d.price >= d.tl, false) AS lw, coalesce(s.price - d.price <= -d.tsh, false) AS sw FROM tx d JOIN tj USING (symbol, n) LEFT JOIN td l ON l.symbol = d.symbol AND l.n = ln LEFT JOIN td s ON s.symbol = d.symbol AND s.n = sn),
tq AS (SELECT *, CASE WHEN lw AND (NOT sw OR ln <= sn) THEN 0 WHEN sw THEN 1 WHEN ln IS NULL AND sn IS NULL THEN 4 WHEN ln IS NOT NULL AND (sn IS NULL OR ln <= sn) THEN 2 ELSE 3 END AS path_outcome FROM tp),
touched AS (SELECT q.*, e.ts_event AS ets, coalesce(e.n - q.n, 0) AS label_horizon_steps, coalesce(e.price - q.price, 0) AS terminal_move FROM tq q LEFT JOIN td e ON e.symbol = q.symbol AND e.n = CASE WHEN path_outcome IN (0, 2) THEN ln WHEN path_outcome IN (1, 3) THEN sn END)"""


PATH_SQL = """path_outcome::BIGINT AS path_outcome, CASE path_outcome WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS bias_label, CASE WHEN path_outcome < 2 THEN 2 ELSE 1 END::BIGINT AS signal_quality, (path_outcome IN (2, 3))::BIGINT AS adverse_path_flag,
 CASE path_outcome WHEN 4 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END::BIGINT AS neutral_reason, CASE path_outcome WHEN 0 THEN 1 WHEN 2 THEN 0 ELSE 2 END::BIGINT AS long_label, CASE path_outcome WHEN 1 THEN 1 WHEN 3 THEN 0 ELSE 2 END::BIGINT AS short_label"""
PATH_COLS = ["path_outcome", "bias_label", "signal_quality", "adverse_path_flag", "neutral_reason", "long_label", "short_label"]
THR_CTE = f"thr AS (SELECT *, CASE WHEN count(mv) OVER f >= 3 THEN avg(mv) OVER f ELSE 0 END AS threshold FROM (SELECT *, abs(price - lag(price) OVER ({BY})) AS mv FROM ticks) WINDOW f AS ({BY} ROWS 9 PRECEDING))"


def with_threshold(spark, sf_dir):
    return W.micro_atr(V.ticks(spark, sf_dir), 10, 3).withColumnRenamed("micro_atr", "threshold")


@query(
    "l5_l12_first_touch",
    f"{V.TICKS}, {THR_CTE}, {touch_sql('10', 'thr', '8')} SELECT {K}, tl AS tp_long, sl AS stop_distance, {PATH_SQL}, coalesce(ets, ts_event) AS label_end_ts, label_horizon_steps, terminal_move FROM touched",
    "tp_long stop_distance terminal_move",
)
def first_touch(spark, sf_dir):
    out = L.first_touch(with_threshold(spark, sf_dir), 10, 0.01, floor_ticks=8)
    return out.select(*KEY, "tp_long", "stop_distance", *PATH_COLS, "label_end_ts", "label_horizon_steps", "terminal_move")


WALLS = """wl AS (SELECT *, price + (sequence % 40) AS ask_wall_px, price - (sequence % 30) AS bid_wall_px, (sequence % 6)::DOUBLE AS ask_wall_strength, (sequence % 5) / 2.0::DOUBLE AS bid_wall_strength FROM thr)"""


def _wall_sql(ahead: str, away: str, strength: str) -> str:
    return f"CASE WHEN {ahead} AND NOT ({strength} > 0 AND {strength} < CASE WHEN {strength} <= 1 THEN 0.5 ELSE 2.5 END) AND {away} >= 2.0 * 0.01::DOUBLE THEN least(target, {away}) ELSE target END"


@query(
    "l5_wall_capped_touch",
    f"""{V.TICKS}, {THR_CTE}, {WALLS}, {touch_sql('10', 'wl', '0', _wall_sql('ask_wall_px > price', '(ask_wall_px - 0.01::DOUBLE * 1.0 - price)', 'ask_wall_strength'), _wall_sql('bid_wall_px < price', '(price - (bid_wall_px + 0.01::DOUBLE * 1.0))', 'bid_wall_strength'))}
SELECT {K}, tl AS tp_long, tsh AS tp_short, {PATH_SQL} FROM touched""",
    "tp_long tp_short",
)
def wall_capped_touch(spark, sf_dir):
    s, p = F.col("sequence"), F.col("price")
    rows = with_threshold(spark, sf_dir).withColumns(
        {"ask_wall_px": p + s % 40, "bid_wall_px": p - s % 30, "ask_wall_strength": (s % 6).cast("double"), "bid_wall_strength": (s % 5) / 2.0}
    )
    return L.first_touch(rows, 10, 0.01, walls=True).select(*KEY, "tp_long", "tp_short", *PATH_COLS)


HORIZON_CTE = f"""rr AS (SELECT *, coalesce(price - lag(price) OVER ({BY}), 0) AS r FROM thr), sd AS (SELECT *, stddev_pop(r) OVER ({BY} ROWS 19 PRECEDING) AS sd FROM rr),
sm AS (SELECT *, quantile_cont(CASE WHEN sd > 1e-10 THEN sd END, 0.5) OVER ({BY}) AS med FROM sd), mvol AS (SELECT *, CASE WHEN sd < 1e-10 THEN coalesce(med, 1e-5) ELSE sd END AS micro_vol FROM sm),
m2 AS (SELECT *, quantile_cont(CASE WHEN micro_vol > 1e-10 THEN micro_vol END, 0.5) OVER ({BY}) AS med2 FROM mvol),
hz AS (SELECT *, coalesce(round_even(greatest(least(micro_vol / med2, 3.0), 0.5) * 8, 0), 8)::BIGINT AS effective_horizon FROM m2)"""


@query("l6_l7_w11_adaptive_horizon", f"{V.TICKS}, {THR_CTE}, {HORIZON_CTE} SELECT {K}, micro_vol, effective_horizon FROM hz", "micro_vol")
def adaptive_horizon(spark, sf_dir):
    return L.adaptive_horizon(L.micro_volatility(with_threshold(spark, sf_dir)), "micro_vol", 8).select(*KEY, "micro_vol", "effective_horizon")


@query(
    "l6_adaptive_touch",
    f"{V.TICKS}, {THR_CTE}, {HORIZON_CTE}, {touch_sql('d.effective_horizon', 'hz')} SELECT {K}, effective_horizon, {PATH_SQL}, label_horizon_steps FROM touched",
)
def adaptive_touch(spark, sf_dir):
    rows = L.adaptive_horizon(L.micro_volatility(with_threshold(spark, sf_dir)), "micro_vol", 8)
    return L.first_touch(rows, 24, 0.01, horizon="effective_horizon").select(*KEY, "effective_horizon", *PATH_COLS, "label_horizon_steps")


@query(
    "l11_trend_filter",
    f"""{LABELED}, t AS (SELECT *, sequence % 3 - 1 AS trend_label, (sequence % 20) / 100.0::DOUBLE AS trend_strength FROM labeled)
SELECT {K}, CASE WHEN (bias_label = 0 AND trend_label = -1 OR bias_label = 1 AND trend_label = 1) AND trend_strength >= 0.05::DOUBLE THEN 2 WHEN bias_label <> 2 AND trend_label = 0 THEN 2 ELSE bias_label END::BIGINT AS bias_label FROM t""",
)
def trend_filter(spark, sf_dir):
    rows = labeled(spark, sf_dir).withColumns({"trend_label": F.col("sequence") % 3 - 1, "trend_strength": (F.col("sequence") % 20) / 100.0})
    return L.trend_filter(rows, strict=True).select(*KEY, "bias_label")


@query(
    "l13_timeout_exceeded",
    f"{V.TICKS}, {THR_CTE}, {touch_sql('10', 'thr')} SELECT {K}, (path_outcome = 4 AND abs(coalesce(x.price - t.price, 0)) >= 0.5 * threshold)::BIGINT AS timeout_move_exceeded_band FROM touched t LEFT JOIN (SELECT symbol AS s2, n AS n2, price FROM td) x ON s2 = symbol AND n2 = least(n + 3, (SELECT max(n) FROM td z WHERE z.symbol = t.symbol))",
)
def timeout_exceeded(spark, sf_dir):
    rows = L.first_touch(with_threshold(spark, sf_dir), 10, 0.01)
    rows = L.windowed(rows, lambda df, w: df.withColumn("_later", F.coalesce(F.last("price").over(w.rowsBetween(1, 3)) - F.col("price"), F.lit(0.0))), after=3)
    return rows.select(*KEY, L.timeout_exceeded(F.col("_later"), 0.5 * F.col("threshold")).alias("timeout_move_exceeded_band"))


# ------------------------------------------------------------------------------------- bars
BARS_CTE = TRADE_BARS_CTE.format(unit="day") + f", ab AS (SELECT * EXCLUDE (pc, tr), row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS n, count(*) OVER (PARTITION BY symbol) AS nb FROM {ATR.format(src='trade_bars')})"


def atr_bars(spark, sf_dir):
    return O.with_atr(O.trade_bars(V.ticks(spark, sf_dir), "1 day"))


def _pick(side: str, tp: str, sl: str, up: bool) -> str:
    t = f"f.high >= {tp}" if up else f"f.low <= {tp}"
    s = f"f.low <= {sl}" if up else f"f.high >= {sl}"
    return f"CASE WHEN {t} AND {s} THEN CASE WHEN abs({tp} - f.open) <= abs({sl} - f.open) THEN '{side}_tp' ELSE '{side}_sl' END WHEN {t} THEN '{side}_tp' WHEN {s} THEN '{side}_sl' END"


RACE = f"coalesce({_pick('long', 'd.close + d.tpd', 'd.close - d.sld', True)}, {_pick('short', 'd.close - d.tpd', 'd.close + d.sld', False)})"


@query(
    "l8_bar_barriers",
    f"""{V.TICKS}, {BARS_CTE}, d AS (SELECT *, 1.5 * greatest(atr_14, 0.0003) AS tpd, 1.0 * greatest(atr_14, 0.0003) AS sld FROM ab),
e AS (SELECT d.symbol, d.n, arg_min({RACE}, CASE WHEN {RACE} IS NOT NULL THEN f.n END) AS kind, min(CASE WHEN {RACE} IS NOT NULL THEN f.n END) AS en FROM d JOIN ab f ON d.symbol = f.symbol AND f.n > d.n AND f.n <= d.n + 4 WHERE d.n + 4 <= d.nb GROUP BY ALL),
o AS (SELECT d.*, CASE kind WHEN 'long_tp' THEN 0 WHEN 'short_tp' THEN 1 WHEN 'long_sl' THEN 2 WHEN 'short_sl' THEN 3 ELSE 4 END AS po, x.bar_ts AS ets, z.bar_ts AS zts, z.close AS zc FROM d LEFT JOIN e USING (symbol, n) LEFT JOIN ab x ON x.symbol = d.symbol AND x.n = e.en LEFT JOIN ab z ON z.symbol = d.symbol AND z.n = d.n + 4)
SELECT symbol, bar_ts, po::BIGINT AS path_outcome, CASE po WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS bias_label, coalesce(ets, zts, bar_ts) AS label_end_ts, coalesce((zc - close) / greatest(close, 1e-8), 0) AS forward_return FROM o""",
    "forward_return",
)
def bar_barriers(spark, sf_dir):
    return L.bar_barriers(atr_bars(spark, sf_dir), 4).select("symbol", "bar_ts", "path_outcome", "bias_label", "label_end_ts", "forward_return")


EVENTS_CTE = """ev AS (SELECT *, ['trending', 'ranging', 'volatile'][tick_count % 3 + 1] AS regime_label, 'asia' AS session, (volume > 40)::BIGINT AS is_event, (volume::BIGINT % 100) / 100.0::DOUBLE AS event_score,
  sign(buy_volume - sell_volume)::BIGINT * (volume::BIGINT % 2) AS event_direction, sign(close - open)::BIGINT AS kalman_direction, (volume::BIGINT % 2) AS strong_session FROM ab)"""


def event_bars(spark, sf_dir):
    v = F.col("volume").cast("long")
    return atr_bars(spark, sf_dir).withColumns(
        {
            "regime_label": F.get(F.array(*[F.lit(r) for r in ("trending", "ranging", "volatile")]), (F.col("tick_count") % 3).cast("int")),
            "session": F.lit("asia"),
            "is_event": (F.col("volume") > 40).cast("long"),
            "event_score": (v % 100) / 100.0,
            "event_direction": F.signum(F.col("buy_volume") - F.col("sell_volume")).cast("long") * (v % 2),
            "kalman_direction": F.signum(F.col("close") - F.col("open")).cast("long"),
            "strong_session": v % 2,
        }
    )


L9_RACE = f"coalesce(CASE WHEN d.al THEN {_pick('long', 'd.close + d.tpd', 'd.close - d.sld', True)} END, CASE WHEN d.sh THEN {_pick('short', 'd.close - d.tpd', 'd.close + d.sld', False)} END)"
L9_CTE = f"""d AS (SELECT *, CASE regime_label WHEN 'trending' THEN 2.0 WHEN 'ranging' THEN 1.1 ELSE 1.8 END::DOUBLE * greatest(atr_14, 0.0003) AS tpd, CASE regime_label WHEN 'ranging' THEN 0.6 ELSE 1.0 END::DOUBLE * greatest(atr_14, 0.0003) AS sld,
  CASE regime_label WHEN 'trending' THEN 12 WHEN 'ranging' THEN 6 ELSE 3 END AS mb,
  NOT (event_direction < 0 OR event_direction = 0 AND kalman_direction = -1 AND event_score < 0.7::DOUBLE) AS al, NOT (event_direction > 0 OR event_direction = 0 AND kalman_direction = 1 AND event_score < 0.7::DOUBLE) AS sh FROM ev),
ends AS (SELECT d.symbol, d.n, max(f.n) AS zn FROM d LEFT JOIN ab f ON d.symbol = f.symbol AND f.n > d.n AND f.n <= d.n + d.mb GROUP BY ALL),
e AS (SELECT d.symbol, d.n, arg_min({L9_RACE}, CASE WHEN {L9_RACE} IS NOT NULL THEN f.n END) AS kind, min(CASE WHEN {L9_RACE} IS NOT NULL THEN f.n END) AS en FROM d JOIN ab f ON d.symbol = f.symbol AND f.n > d.n AND f.n <= d.n + d.mb WHERE d.is_event = 1 GROUP BY ALL),
o AS (SELECT d.*, e.en, z.zn, CASE kind WHEN 'long_tp' THEN 0 WHEN 'short_tp' THEN 1 WHEN 'long_sl' THEN 2 WHEN 'short_sl' THEN 3 ELSE 4 END AS po FROM d LEFT JOIN e USING (symbol, n) LEFT JOIN ends z USING (symbol, n)),
p AS (SELECT o.*, CASE WHEN is_event = 1 THEN coalesce(en, zn, o.n) ELSE o.n END AS stop_n FROM o),
outcome AS (SELECT p.*, x.bar_ts AS label_end_ts, x.n - p.n AS label_horizon_steps, (x.close - p.close) / greatest(abs(p.close), 1e-8) AS forward_return, CASE po WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS bias_label,
  CASE WHEN is_event = 0 THEN 5 WHEN po = 4 THEN CASE WHEN al AND sh THEN 1 ELSE 4 END WHEN po = 2 THEN 2 WHEN po = 3 THEN 3 ELSE 0 END AS neutral_reason, CASE WHEN po < 2 THEN CASE WHEN strong_session = 1 THEN 2 ELSE 1 END ELSE 0 END AS signal_quality
  FROM p JOIN ab x ON x.symbol = p.symbol AND x.n = p.stop_n)"""
L9 = f"{V.TICKS}, {BARS_CTE}, {EVENTS_CTE}, {L9_CTE}"


def outcome(spark, sf_dir):
    return L.outcome_labels(event_bars(spark, sf_dir))


@query(
    "l9_outcome_labels",
    f"""{L9} SELECT symbol, bar_ts, po::BIGINT AS path_outcome, bias_label::BIGINT AS bias_label, neutral_reason::BIGINT AS neutral_reason, signal_quality::BIGINT AS signal_quality, label_end_ts, label_horizon_steps, forward_return,
 (is_event = 1 AND bias_label < 2 AND signal_quality > 0)::BIGINT AS event_flag, (is_event = 1 AND bias_label < 2)::BIGINT AS train_event_flag FROM outcome""",
    "forward_return",
)
def outcome_labels(spark, sf_dir):
    return outcome(spark, sf_dir).select("symbol", "bar_ts", "path_outcome", "bias_label", "neutral_reason", "signal_quality", "label_end_ts", "label_horizon_steps", "forward_return", "event_flag", "train_event_flag")


@query(
    "l16_train_pool",
    f"""{L9}, md AS (SELECT greatest(quantile_cont(atr_14, 0.5) * 0.5, 1e-12) AS fl FROM outcome) SELECT symbol, bar_ts, (bias_label < 2 AND strong_session = 1 AND atr_14 >= fl)::BIGINT AS train_event_flag FROM outcome, md""",
)
def train_pool(spark, sf_dir):
    return L.train_pool(outcome(spark, sf_dir)).select("symbol", "bar_ts", "train_event_flag")


def _touch_case(tie: str) -> str:
    lt, ls, st, ss = "f.high >= d.close + d.a * 1.5", "f.low <= d.close - d.a * 1.0", "f.low <= d.close - d.a * 1.5", "f.high >= d.close + d.a * 1.0"
    if tie == "tp_first":
        return f"CASE WHEN {lt} THEN 0 WHEN {ls} THEN 2 WHEN {st} THEN 1 WHEN {ss} THEN 2 END"
    if tie == "sl_first":
        return f"CASE WHEN {ls} THEN 2 WHEN {lt} THEN 0 WHEN {ss} THEN 2 WHEN {st} THEN 1 END"
    return f"CASE WHEN {ls} OR {ss} OR ({lt} AND {st}) THEN 2 WHEN {lt} THEN 0 WHEN {st} THEN 1 END"


def touch_ctes(tie: str) -> str:
    c = _touch_case(tie)
    return f"""d AS (SELECT *, greatest(atr_14, 0.01::DOUBLE) AS a FROM ab WHERE n + 4 <= nb),
e AS (SELECT d.symbol, d.n, arg_min({c}, CASE WHEN {c} IS NOT NULL THEN f.n END) AS kind, min(CASE WHEN {c} IS NOT NULL THEN f.n END) AS en FROM d JOIN ab f ON d.symbol = f.symbol AND f.n > d.n AND f.n <= d.n + 4 GROUP BY ALL),
sim AS (SELECT d.symbol, d.bar_ts, coalesce(kind, 2) AS bias_label, coalesce(en - d.n, 4) AS hit_bar, CASE WHEN coalesce(kind, 2) = 2 THEN 0 ELSE greatest(least(1 - (en - d.n - 1) / 4.0, 1.0), 0.3) END::DOUBLE AS event_score FROM d JOIN e USING (symbol, n))"""


for _tie in ("tp_first", "sl_first", "ambiguous_neutral"):

    @query(f"l10_touch_{_tie}", f"{V.TICKS}, {BARS_CTE}, {touch_ctes(_tie)} SELECT symbol, bar_ts, bias_label::BIGINT AS bias_label, hit_bar, event_score FROM sim", "event_score")
    def touch_tie(spark, sf_dir, tie=_tie):
        return L.simulate_touch(atr_bars(spark, sf_dir), 4, 1.5, 1.0, 0.01, tie).select("symbol", "bar_ts", "bias_label", "hit_bar", "event_score")


@query(
    "l26_independent_race",
    f"""{V.TICKS}, {BARS_CTE}, d AS (SELECT *, greatest(atr_14, 0.01::DOUBLE) AS a FROM ab WHERE n + 4 <= nb),
e AS (SELECT d.symbol, d.bar_ts, d.n, min(CASE WHEN f.high >= d.close + d.a * 1.5 THEN f.n - d.n END) AS lw, min(CASE WHEN f.low <= d.close - d.a * 1.0 THEN f.n - d.n END) AS ll,
  min(CASE WHEN f.low <= d.close - d.a * 1.5 THEN f.n - d.n END) AS sw, min(CASE WHEN f.high >= d.close + d.a * 1.0 THEN f.n - d.n END) AS sl FROM d JOIN ab f ON d.symbol = f.symbol AND f.n > d.n AND f.n <= d.n + 4 GROUP BY ALL),
w AS (SELECT symbol, bar_ts, CASE WHEN lw <= coalesce(ll, 99) THEN lw END AS lw, CASE WHEN sw <= coalesce(sl, 99) THEN sw END AS sw FROM e)
SELECT symbol, bar_ts, CASE WHEN lw IS NOT NULL AND (sw IS NULL OR lw < sw) THEN 0 WHEN sw IS NOT NULL AND (lw IS NULL OR sw < lw) THEN 1 ELSE 2 END::BIGINT AS bias_label, coalesce(least(lw, sw), 4) AS hit_bar FROM w""",
)
def independent_race(spark, sf_dir):
    return L.simulate_touch(atr_bars(spark, sf_dir), 4, 1.5, 1.0, 0.01, "tp_first", "independent").select("symbol", "bar_ts", "bias_label", "hit_bar")


SOFT_RATIO = """mu AS (SELECT avg(event_score) FILTER (bias_label < 2) AS m FROM sim), sr AS (SELECT sim.*, CASE bias_label WHEN 0 THEN greatest(least(0.5 + event_score / (m + 1e-9) * 0.5, 1.0), 0.55) WHEN 1 THEN greatest(least(0.5 - event_score / (m + 1e-9) * 0.5, 0.45), 0.0) ELSE 0.5 END::DOUBLE AS soft_label FROM sim, mu),
fd AS (SELECT avg(abs(soft_label - 0.5)) FILTER (bias_label < 2) AS fm FROM sr)"""


@query("l26_ratio_soft_labels", f"{V.TICKS}, {BARS_CTE}, {touch_ctes('tp_first')}, {SOFT_RATIO} SELECT symbol, bar_ts, soft_label, CASE WHEN bias_label = 2 THEN 0 ELSE greatest(least(abs(soft_label - 0.5) / fm, 3.0), 0.25) END AS weight FROM sr, fd", "soft_label weight")
def ratio_soft_labels(spark, sf_dir):
    return L.ratio_soft_labels(L.simulate_touch(atr_bars(spark, sf_dir), 4, 1.5, 1.0, 0.01)).select("symbol", "bar_ts", "soft_label", "weight")


@query(
    "l26_touch_summary",
    f"""{V.TICKS}, {BARS_CTE}, {touch_ctes('tp_first')}, {SOFT_RATIO} SELECT count(*) AS n_rows, sum((bias_label = 0)::INT)::BIGINT AS long, sum((bias_label = 1)::INT)::BIGINT AS short, sum((bias_label = 2)::INT)::BIGINT AS neutral,
 avg(hit_bar) FILTER (bias_label < 2) AS mean_hit_time, avg(event_score) FILTER (bias_label < 2) AS mean_event_score, avg(abs(soft_label - 0.5)) AS mean_abs_soft_dev, avg((abs(soft_label - 0.5) >= 0.10::DOUBLE)::INT) AS pct_soft_extreme,
 sum((bias_label = 0)::INT)::DOUBLE / sum((bias_label < 2)::INT) AS long_share, sum((bias_label < 2)::INT)::DOUBLE / count(*) AS event_rate FROM sr""",
    "mean_hit_time mean_event_score mean_abs_soft_dev pct_soft_extreme long_share event_rate",
)
def touch_summary(spark, sf_dir):
    return L.touch_summary(L.ratio_soft_labels(L.simulate_touch(atr_bars(spark, sf_dir), 4, 1.5, 1.0, 0.01)))


@query(
    "l27_agreement",
    f"""{V.TICKS}, {BARS_CTE}, {touch_ctes('tp_first')}, s1 AS (SELECT * FROM sim), k AS (SELECT s.symbol, s.bar_ts, s.bias_label AS a, o.b FROM s1 s JOIN (SELECT symbol, bar_ts, CASE WHEN close > open THEN 0 WHEN close < open THEN 1 ELSE 2 END AS b FROM ab) o USING (symbol, bar_ts))
SELECT count(*) AS rows, avg((a = b)::INT) AS agreement, avg(abs(a - b)) AS mae, corr(a, b) AS correlation FROM k""",
    "agreement mae correlation",
)
def agreement(spark, sf_dir):
    bars = atr_bars(spark, sf_dir)
    mine = L.simulate_touch(bars, 4, 1.5, 1.0, 0.01).select("symbol", "bar_ts", F.col("bias_label").alias("a"))
    stored = bars.select("symbol", "bar_ts", F.when(F.col("close") > F.col("open"), 0).when(F.col("close") < F.col("open"), 1).otherwise(2).alias("b"))
    both = mine.join(stored, ["symbol", "bar_ts"])
    return both.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.corr("a", "b").alias("correlation"))


SESSION = "CASE WHEN hour(ts_event) < 8 THEN 'asia' WHEN hour(ts_event) < 16 THEN 'london' ELSE 'ny' END"


def sessions(spark, sf_dir):
    h = F.hour("ts_event")
    return V.ticks(spark, sf_dir).withColumns({"trade_date": F.to_date("ts_event"), "session": F.when(h < 8, "asia").when(h < 16, "london").otherwise("ny")})


@query(
    "l17_session_labels",
    f"""{V.TICKS}, x AS (SELECT symbol, ts_event::DATE AS trade_date, {SESSION} AS session, price, row_number() OVER w - 1 AS i, abs(price - lag(price) OVER w) AS r FROM ticks WINDOW w AS (PARTITION BY symbol, ts_event::DATE, {SESSION} ORDER BY ts_event, sequence)),
g AS (SELECT symbol, trade_date, session, max(i) AS li, arg_min(price, i) AS op, arg_max(price, i) AS cl, list(r ORDER BY i) FILTER (i > 0) AS rs FROM x GROUP BY ALL),
v AS (SELECT *, greatest(CASE WHEN li >= 1 THEN list_reduce(rs, lambda a, b: 0.1::DOUBLE * b + 0.9::DOUBLE * a) END, 1e-8) AS ema FROM g),
b AS (SELECT *, CASE WHEN li < 2 THEN 0.001 ELSE ema * 1.5 END AS tp, CASE WHEN li < 2 THEN 0.001 ELSE ema * 1.0 END AS sl FROM v),
h AS (SELECT b.symbol, b.trade_date, b.session, arg_min(CASE WHEN price >= op + tp THEN 0 WHEN price <= op - sl THEN 1 END, CASE WHEN price >= op + tp OR price <= op - sl THEN i END) AS hit FROM b JOIN x USING (symbol, trade_date, session) WHERE i > 0 GROUP BY ALL)
SELECT symbol, trade_date::VARCHAR AS trade_date, session, li + 1 AS rows, tp, sl, CASE WHEN li < 1 THEN 2 ELSE coalesce(hit, CASE WHEN cl - op > tp * 0.5 THEN 0 WHEN cl - op < -sl * 0.5 THEN 1 ELSE 2 END) END::BIGINT AS bias_label FROM b LEFT JOIN h USING (symbol, trade_date, session)""",
    "tp sl",
)
def session_labels(spark, sf_dir):
    return L.session_labels(sessions(spark, sf_dir))


# ---------------------------------------------------------------------------------- weights
SOFT_IN = f"""{V.TICKS}, {THR_CTE}, {touch_sql('10', 'thr')}, si AS (SELECT {K}, price AS close, {PATH_SQL}, label_horizon_steps, 10 AS effective_horizon, (sequence % 2) AS timeout_move_exceeded_band, terminal_move AS forward_return,
  CASE WHEN sequence % 9 <> 0 THEN threshold END AS ldt0, (sequence % 6)::DOUBLE AS bid_wall_strength, (sequence % 5)::DOUBLE AS ask_wall_strength, (sequence % 11) / 10.0::DOUBLE AS label_stability FROM touched),
si2 AS (SELECT *, coalesce(ldt0, (SELECT quantile_cont(ldt0, 0.5) FROM si)) AS ldt FROM si)"""


def soft_input(spark, sf_dir):
    s = F.col("sequence")
    rows = L.first_touch(with_threshold(spark, sf_dir), 10, 0.01)
    return rows.select(
        *KEY, F.col("price").alias("close"), *PATH_COLS, "label_horizon_steps", F.lit(10).alias("effective_horizon"), (s % 2).alias("timeout_move_exceeded_band"), F.col("terminal_move").alias("forward_return"),
        F.when(s % 9 != 0, F.col("threshold")).alias("label_dynamic_threshold"), (s % 6).cast("double").alias("bid_wall_strength"), (s % 5).cast("double").alias("ask_wall_strength"), ((s % 11) / 10.0).alias("label_stability"),
    )


SOFT_CTE = """s1 AS (SELECT *, 0.5 + 0.4::DOUBLE * (1 / (1 + exp(-greatest(least(1.5 * forward_return / greatest(ldt, 1e-10), 60), -60))) - 0.5) AS late,
  CASE WHEN path_outcome = 4 THEN least(0.40::DOUBLE + CASE WHEN signal_quality = 2 THEN 0.1 ELSE 0 END + 0.15::DOUBLE * least(label_horizon_steps / 10.0, 1) + 0.05::DOUBLE * timeout_move_exceeded_band, 1) ELSE 0.75 + CASE WHEN signal_quality = 2 THEN 0.10 ELSE 0 END END::DOUBLE AS label_confidence FROM si2),
s2 AS (SELECT *, CASE path_outcome WHEN 4 THEN late WHEN 0 THEN CASE WHEN signal_quality = 2 THEN 0.90 ELSE 0.78 END WHEN 2 THEN CASE WHEN signal_quality = 2 THEN 0.08 ELSE 0.10 END WHEN 1 THEN 0.10 ELSE CASE WHEN signal_quality = 2 THEN 0.72 ELSE 0.68 END END::DOUBLE AS soft_label_long,
  CASE path_outcome WHEN 4 THEN 1 - late WHEN 1 THEN CASE WHEN signal_quality = 2 THEN 0.90 ELSE 0.78 END WHEN 3 THEN CASE WHEN signal_quality = 2 THEN 0.08 ELSE 0.10 END WHEN 0 THEN 0.10 ELSE CASE WHEN signal_quality = 2 THEN 0.72 ELSE 0.68 END END::DOUBLE AS soft_label_short FROM s1),
s3 AS (SELECT *, CASE bias_label WHEN 0 THEN soft_label_long WHEN 1 THEN soft_label_short ELSE 0.5 END AS soft_label FROM s2),
s4 AS (SELECT *, greatest(label_confidence * abs(soft_label - 0.5) * 2 * CASE WHEN signal_quality = 2 THEN 1.3 ELSE 1 END, 0.1) AS rw FROM s3),
soft AS (SELECT *, rw / (SELECT avg(rw) FROM s4) AS soft_sample_weight FROM s4)"""
SOFT_COLS = "soft_label soft_label_long soft_label_short label_confidence soft_sample_weight"


@query("l18_analytical_soft_labels", f"{SOFT_IN}, {SOFT_CTE} SELECT {K}, {', '.join(SOFT_COLS.split())} FROM soft", SOFT_COLS)
def analytical(spark, sf_dir):
    return Q.analytical(Q.threshold_fallback(soft_input(spark, sf_dir))).select(*KEY, *SOFT_COLS.split())


@query("l24_threshold_fallback", f"{SOFT_IN}, c AS (SELECT * FROM si2) SELECT {K}, ldt AS label_dynamic_threshold FROM c", "label_dynamic_threshold")
def threshold_fallback(spark, sf_dir):
    return Q.threshold_fallback(soft_input(spark, sf_dir)).select(*KEY, "label_dynamic_threshold")


@query("l19_monte_carlo")
def monte_carlo(spark, sf_dir):
    rows = Q.threshold_fallback(soft_input(spark, sf_dir))
    return Q.monte_carlo(rows, 10, scenarios=50).select(*KEY, "bias_label", "soft_label", "label_confidence", "soft_sample_weight")


BSOFT = """b1 AS (SELECT *, greatest(least(event_score, 1), 0) * 0.6 + greatest(least(1 - label_horizon_steps / mb::DOUBLE, 1), 0) * 0.4 AS st FROM outcome),
b2 AS (SELECT *, CASE WHEN is_event = 1 AND bias_label = 0 THEN 0.55 + least(st, 1) * 0.45 WHEN is_event = 1 AND bias_label = 1 THEN 0.45 - least(st, 1) * 0.45 ELSE 0.5 END::DOUBLE AS sl FROM b1),
bs AS (SELECT *, least(abs(sl - 0.5) * 2, 1) AS conf FROM b2)"""


@query("l20_bar_soft_labels", f"{L9}, {BSOFT} SELECT symbol, bar_ts, sl AS soft_label, conf AS label_confidence, 1 + conf AS soft_sample_weight FROM bs", "soft_label label_confidence soft_sample_weight")
def bar_soft_labels(spark, sf_dir):
    return Q.bar_soft_labels(outcome(spark, sf_dir)).select("symbol", "bar_ts", "soft_label", "label_confidence", "soft_sample_weight")


@query(
    "l28_merged_soft_labels",
    f"""{L9}, {BSOFT}, si2 AS (SELECT *, po AS path_outcome, label_horizon_steps AS lhs, 0 AS timeout_move_exceeded_band, atr_14 AS ldt FROM bs),
{SOFT_CTE.replace('label_horizon_steps / 10.0', '(CASE WHEN label_horizon_steps > 0 THEN 1 ELSE 0 END)')}
SELECT symbol, bar_ts, sl AS soft_label, greatest(label_confidence, conf) AS label_confidence, soft_sample_weight * (0.75 + 0.5 * conf) AS soft_sample_weight FROM soft""",
    "soft_label label_confidence soft_sample_weight",
)
def merged_soft_labels(spark, sf_dir):
    rows = outcome(spark, sf_dir).withColumns({"effective_horizon": F.col("label_horizon_steps"), "timeout_move_exceeded_band": F.lit(0), "label_dynamic_threshold": F.col("atr_14")})
    return Q.merged_soft_labels(rows).select("symbol", "bar_ts", "soft_label", "label_confidence", "soft_sample_weight")


MCW = """q1 AS (SELECT *, (SELECT greatest(quantile_cont(effective_horizon, 0.5), 1) FROM si2) AS mh FROM si2),
q2 AS (SELECT *, greatest(least(CASE WHEN bias_label = 2 THEN 0.5 ELSE greatest(ldt, 1e-12) / (greatest(ldt * 1.5, 1e-12) + greatest(ldt, 1e-12)) END * greatest(least(sqrt(1 / greatest(effective_horizon / mh, 0.1)), 1.6), 0.4)
  * (0.4 + 0.8::DOUBLE / (1 + exp(-greatest(bid_wall_strength, ask_wall_strength) / 3.0 * 3.0))) * CASE signal_quality WHEN 2 THEN 1.4 WHEN 1 THEN 1.0 ELSE 0.6 END, 3.5), 0.1) AS rw2 FROM q1),
mcw AS (SELECT *, greatest(least(rw2 / (SELECT avg(rw2) FROM q2), 3.5), 0.1) AS mc_sample_weight FROM q2)"""


@query("l21_f24_f25_structural_weights", f"{SOFT_IN}, {MCW} SELECT {K}, mc_sample_weight FROM mcw", "mc_sample_weight")
def structural_weights(spark, sf_dir):
    return Q.structural_weights(soft_input(spark, sf_dir)).select(*KEY, "mc_sample_weight")


@query(
    "l21_training_weights",
    f"""{SOFT_IN}, {MCW}, r AS (SELECT *, CASE WHEN signal_quality = 2 THEN 2.0 ELSE 1.0 END * greatest(mc_sample_weight, 0.05) * (0.2 + 0.8 * least(label_stability, 1)) AS rw3 FROM mcw)
SELECT {K}, rw3 / (SELECT avg(rw3) FROM r) AS sample_weight FROM r""",
    "sample_weight",
)
def training_weights(spark, sf_dir):
    rows = Q.structural_weights(soft_input(spark, sf_dir)).withColumn("soft_sample_weight", F.lit(1.0))
    return Q.training_weights(rows).select(*KEY, "sample_weight")


@query("f24_ruin_with_drift", f"{V.TICKS}, p AS (SELECT sequence, 1.5::DOUBLE * size AS a, 1.0::DOUBLE * size AS b, size / 2.0 AS s, greatest(least((sequence % 7 - 3) / 10.0, 0.3 * size / 2.0), -0.3 * size / 2.0) AS mu FROM ticks), e AS (SELECT *, 1 - exp(greatest(least(-2 * mu * (a + b) / (s * s), 500), -500)) AS den, 1 - exp(greatest(least(-2 * mu * b / (s * s), 500), -500)) AS num FROM p) SELECT sequence, greatest(least(CASE WHEN abs(den) < 1e-9 THEN b / (a + b) ELSE num / (den + 1e-15) END, 0.995), 0.005) AS p_tp FROM e", "p_tp")
def ruin_with_drift(spark, sf_dir):
    z = F.col("size").cast("double")
    p = Q.ruin_probability(z * 1.5, z, z / 2.0, (F.col("sequence") % 7 - 3) / 10.0)
    return V.ticks(spark, sf_dir).select("sequence", p.alias("p_tp"))


@query("l22_recency_weights", f"{V.TICKS}, a AS (SELECT sequence, exp(-ln(2.0) * floor((epoch_us((SELECT max(ts_event) FROM ticks)) - epoch_us(ts_event)) / 86400000000.0) / 7.0) AS w FROM ticks) SELECT sequence, w / (SELECT avg(w) FROM a) AS recency_weight FROM a", "recency_weight")
def recency_weights(spark, sf_dir):
    return Q.recency_weights(V.ticks(spark, sf_dir)).select("sequence", "recency_weight")


@query("l25_soft_label_check", f"{SOFT_IN}, {SOFT_CTE}, c AS (SELECT avg((soft_label > 0.45 AND soft_label < 0.55)::INT) AS near_half, avg(label_confidence) AS mean_confidence, corr(label_confidence, abs(soft_label - 0.5)) AS confidence_clarity, avg((soft_label > 0.5)::INT) AS long_share FROM soft) SELECT *, near_half < 0.3 AND mean_confidence > 0.5 AS valid FROM c", "near_half mean_confidence confidence_clarity long_share")
def soft_label_check(spark, sf_dir):
    return Q.soft_label_check(Q.analytical(Q.threshold_fallback(soft_input(spark, sf_dir))))


@query("l25_weight_check", f"{SOFT_IN}, {MCW}, c AS (SELECT avg(mc_sample_weight) AS mean_weight, stddev_pop(mc_sample_weight) AS std_weight, avg((mc_sample_weight < 0.3)::INT) AS low_share, avg(mc_sample_weight) FILTER (signal_quality = 2) AS mean_strong, avg(mc_sample_weight) FILTER (signal_quality = 1) AS mean_weak FROM mcw) SELECT *, mean_weight > 0.8 AND mean_weight < 1.2 AND low_share >= 0.05 AS valid FROM c", "mean_weight std_weight low_share mean_strong mean_weak")
def weight_check(spark, sf_dir):
    return Q.weight_check(Q.structural_weights(soft_input(spark, sf_dir)))
