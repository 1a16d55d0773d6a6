"""Queries over rules with state and event detection, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import machines as Z
from tapeloom.operators import bars as O
from tapeloom.operators import events as V2
from tapeloom.operators import stateful as S
from tapeloom.plans import views as V
from tapeloom.plans.bar_queries import TRADE_BARS_CTE
from tapeloom.plans.eval_queries import TRADES_CTE, trades
from tapeloom.plans.eval_queries import PRED as PRED_SQL
from tapeloom.plans.registry import query
from tapeloom.plans.tick_queries import TRADES, cvd_ticks, cvd_trades

KEY = ["symbol", "ts_event", "sequence"]
K = "symbol, ts_event, sequence"
BY = "PARTITION BY symbol ORDER BY ts_event, sequence"


def last(n: int) -> str:
    return f"({BY} ROWS {n - 1} PRECEDING)"


def day_bars(spark, sf_dir):
    return O.trade_bars(V.ticks(spark, sf_dir), "1 day")


BARS = f"{V.TICKS}, {TRADE_BARS_CTE.format(unit='day')}"
HIST = "list({c}) OVER (PARTITION BY symbol ORDER BY {o})"


def ewm_sql(column: str, alpha: str, order: str) -> str:
    return f"list_reduce(list({column}) OVER (PARTITION BY symbol ORDER BY {order}), lambda a, x: a + {alpha} * (x - a))"


@query("r1_ewma", f"{BARS} SELECT symbol, bar_ts, {ewm_sql('close', '(2.0::DOUBLE / 13)', 'bar_ts')} AS ewma FROM trade_bars", "ewma")
def ewma(spark, sf_dir):
    bars = day_bars(spark, sf_dir).select("symbol", "bar_ts", "close")
    return S.fold(bars, Z.Ewma("close", 2.0 / 13), order=["bar_ts"]).select("symbol", "bar_ts", "ewma")


@query(
    "r1_macd",
    f"""{BARS}, a AS (SELECT symbol, bar_ts, {ewm_sql('close', '(2.0::DOUBLE / 13)', 'bar_ts')} - {ewm_sql('close', '(2.0::DOUBLE / 27)', 'bar_ts')} AS m FROM trade_bars)
SELECT symbol, bar_ts, m - {ewm_sql('m', '0.2::DOUBLE', 'bar_ts')} AS macd_hist FROM a""",
    "macd_hist",
)
def macd(spark, sf_dir):
    bars = day_bars(spark, sf_dir).select("symbol", "bar_ts", "close")
    return S.fold(bars, Z.Macd(), order=["bar_ts"]).select("symbol", "bar_ts", "macd_hist")


@query(
    "r2_hawkes",
    f"""{V.TICKS}, n AS (SELECT *, row_number() OVER w AS n, epoch_us(ts_event) AS t, (action IN ('A', 'C'))::INT AS ev FROM ticks WINDOW w AS ({BY})),
i AS (SELECT a.symbol, a.ts_event, a.sequence, a.n, 0.1::DOUBLE + coalesce(sum(CASE WHEN b.n > 1 AND b.ev = 1 THEN 0.5 * exp(-0.00001::DOUBLE * (a.t - b.t) / 1e6) ELSE 0 END), 0) AS v FROM n a JOIN n b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY ALL),
c AS (SELECT *, CASE WHEN n > 1 THEN v END AS cv FROM i)
SELECT {K}, CASE WHEN n > 1 AND count(cv) OVER {last(20)} >= 5 THEN v / avg(cv) OVER {last(20)} ELSE v END AS hawkes_intensity FROM c""",
    "hawkes_intensity",
)
def hawkes(spark, sf_dir):
    rows = V.ticks(spark, sf_dir).select(*KEY, "action")
    return S.hawkes(rows, 20, 5, beta=0.00001).select(*KEY, "hawkes_intensity")


def recursive(source: str, first: str, then: str, columns: str) -> str:
    """Row after row by recursion: ``p`` is the row before, ``x`` the row itself."""
    return f"""rc AS (SELECT {first} FROM {source} x WHERE n = 1 UNION ALL SELECT {then} FROM rc p JOIN {source} x ON x.symbol = p.symbol AND x.n = p.n + 1), rs AS (SELECT {columns} FROM rc)"""


@query(
    "r3_kalman_level",
    f"""{BARS.replace('WITH ', 'WITH RECURSIVE ', 1)}, nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS n FROM trade_bars),
{recursive('nb', 'x.symbol, x.bar_ts, x.n, x.close AS v, 1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + 0.001::DOUBLE) AS pv',
 'x.symbol, x.bar_ts, x.n, p.v + (p.pv + 0.00001::DOUBLE) / (p.pv + 0.00001::DOUBLE + 0.001::DOUBLE) * (x.close - p.v), (1 - (p.pv + 0.00001::DOUBLE) / (p.pv + 0.00001::DOUBLE + 0.001::DOUBLE)) * (p.pv + 0.00001::DOUBLE)', '*')}
SELECT symbol, bar_ts, v AS kalman_trend, CASE WHEN v - lag(v) OVER (PARTITION BY symbol ORDER BY bar_ts) > 0 THEN 1 WHEN v - lag(v) OVER (PARTITION BY symbol ORDER BY bar_ts) < 0 THEN -1 ELSE 0 END::BIGINT AS kalman_direction FROM rs""",
    "kalman_trend",
)
def kalman_level(spark, sf_dir):
    bars = S.fold(day_bars(spark, sf_dir).select("symbol", "bar_ts", "close"), Z.KalmanLevel(), order=["bar_ts"])
    step = F.signum(F.col("kalman_trend") - F.lag("kalman_trend").over(O.bar_window()))
    return bars.withColumn("kalman_direction", F.coalesce(step, F.lit(0.0)).cast("int")).select("symbol", "bar_ts", "kalman_trend", "kalman_direction")




@query(
    "r3_kalman_slope",
    f"""WITH RECURSIVE {V.TICKS_CTE}, nt AS (SELECT *, row_number() OVER ({BY}) AS n FROM ticks), z AS (SELECT symbol, n, ts_event, sequence, price FROM nt),
z0 AS (SELECT symbol, 0::BIGINT AS n, NULL::TIMESTAMP AS ts_event, NULL::BIGINT AS sequence, price AS v, 0.0::DOUBLE AS sl, 1.0::DOUBLE AS aa, 0.0::DOUBLE AS ab, 1.0::DOUBLE AS bb, 0.0::DOUBLE AS top FROM z WHERE n = 1),
rc AS (SELECT * FROM z0 UNION ALL SELECT symbol, n, ts_event, sequence, v0 + ka * (price - v0), sl + kb * (price - v0), (1 - ka) * aa1, (1 - ka) * ab1, bb1 - kb * ab1, greatest(top, abs(sl + kb * (price - v0))) FROM
  (SELECT *, aa1 / (aa1 + 0.01::DOUBLE) AS ka, ab1 / (aa1 + 0.01::DOUBLE) AS kb FROM (SELECT x.symbol, x.n, x.ts_event, x.sequence, x.price, p.v + p.sl AS v0, p.sl, p.top, p.aa + 2 * p.ab + p.bb + 0.0001::DOUBLE AS aa1, p.ab + p.bb AS ab1, p.bb + 0.0001::DOUBLE AS bb1 FROM rc p JOIN z x ON x.symbol = p.symbol AND x.n = p.n + 1)))
SELECT symbol, ts_event, sequence, CASE WHEN sl / greatest(top, 1e-10) > 0.05 THEN 1 WHEN sl / greatest(top, 1e-10) < -0.05 THEN -1 ELSE 0 END::BIGINT AS trend_label, abs(sl / greatest(top, 1e-10)) AS trend_strength, v AS kalman_price FROM rc WHERE n > 0""",
    "trend_strength kalman_price",
)
def kalman_slope(spark, sf_dir):
    return S.fold(V.ticks(spark, sf_dir).select(*KEY, "price"), Z.KalmanSlope()).drop("price")


@query(
    "r4_fisher",
    f"""{TRADES.replace('WITH ', 'WITH RECURSIVE ', 1)}, pl AS (SELECT *, row_number() OVER w AS n, cvd - lag(cvd) OVER w AS cs, count(*) OVER {last(3)} AS c, max(price) OVER {last(3)} AS hi, min(price) OVER {last(3)} AS lo FROM tr WINDOW w AS ({BY})),
pp AS (SELECT symbol, ts_event, sequence, n, coalesce(cs, 0) AS cs, CASE WHEN c >= 3 THEN 2 * (price - lo) / CASE WHEN hi = lo THEN 0.0001 ELSE hi - lo END - 1 END AS place FROM pl),
rc AS (SELECT symbol, n, ts_event, sequence, 0.0::DOUBLE AS v, 0.0::DOUBLE AS f, NULL::DOUBLE AS m, 0 AS sig FROM pp WHERE n = 1 UNION ALL
 SELECT symbol, n, ts_event, sequence, coalesce(v1, v), coalesce(f1, f), CASE WHEN place IS NULL THEN m WHEN m IS NULL THEN f1 ELSE m1 END,
  CASE WHEN place IS NULL OR m IS NULL THEN 0 WHEN f <= m AND f1 > m1 AND f < -0.3 AND (cs >= 0 OR f1 - f >= 0.3) THEN 1 WHEN f > m AND f1 <= m1 AND f > 0.3 AND (cs <= 0 OR f - f1 >= 0.3) THEN -1 ELSE 0 END
 FROM (SELECT *, 0.2::DOUBLE * f1 + 0.8::DOUBLE * m AS m1 FROM (SELECT *, 0.5 * ln((1 + v1) / (1 - v1)) + 0.5 * f AS f1 FROM (SELECT x.symbol, x.n, x.ts_event, x.sequence, x.place, x.cs, p.v, p.f, p.m,
   CASE WHEN x.place IS NOT NULL THEN greatest(least(0.5 * (x.place + p.v), 0.999), -0.999) END AS v1 FROM rc p JOIN pp x ON x.symbol = p.symbol AND x.n = p.n + 1))))
SELECT {K}, sig::BIGINT AS fisher_signal FROM rc""",
)
def fisher(spark, sf_dir):
    return S.fisher(cvd_trades(spark, sf_dir).select(*KEY, "price", "cvd"), 3).select(*KEY, "fisher_signal")


@query(
    "r5_page_hinkley",
    f"""WITH RECURSIVE {V.TICKS_CTE}, nt AS (SELECT symbol, ts_event, sequence, row_number() OVER ({BY}) AS n, size / 101.0::DOUBLE AS e FROM ticks),
rc AS (SELECT symbol, n, ts_event, sequence, 1 AS c, e AS mean, -0.005::DOUBLE AS tot, least(0, -0.005::DOUBLE) AS low, 0.0::DOUBLE AS stat, false AS drift FROM nt WHERE n = 1 UNION ALL
 SELECT symbol, n, ts_event, sequence, CASE WHEN dr THEN 0 ELSE c1 END, CASE WHEN dr THEN 0 ELSE m1 END, CASE WHEN dr THEN 0 ELSE t1 END, CASE WHEN dr THEN 0 ELSE l1 END, t1 - l1, dr FROM (SELECT *, t1 - l1 > 0.8 AS dr FROM (SELECT *, least(low, t1) AS l1 FROM
  (SELECT *, tot + (e - m1 - 0.005::DOUBLE) AS t1 FROM (SELECT x.symbol, x.n, x.ts_event, x.sequence, x.e, p.c + 1 AS c1, p.mean + (x.e - p.mean) / (p.c + 1) AS m1, p.tot, p.low FROM rc p JOIN nt x ON x.symbol = p.symbol AND x.n = p.n + 1)))))
SELECT {K}, stat AS statistic, drift FROM rc""",
    "statistic",
)
def page_hinkley(spark, sf_dir):
    rows = V.ticks(spark, sf_dir).select(*KEY, (F.col("size") / 101.0).alias("error"))
    return S.fold(rows, Z.PageHinkley(limit=0.8)).select(*KEY, "statistic", "drift")


@query(
    "r6_hidden_volume",
    f"""{V.TICKS}, o AS (SELECT *, sequence % 5 AS oid, floor(price / 10) AS lvl FROM ticks), m AS (SELECT *, CASE WHEN action IN ('A', 'C') THEN action END AS kd FROM o),
l AS (SELECT *, last_value(CASE WHEN kd IS NOT NULL THEN {{'k': kd, 'p': lvl, 's': side, 't': ts_event}} END IGNORE NULLS) OVER (PARTITION BY symbol, oid ORDER BY ts_event, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM m),
f AS (SELECT *, coalesce(pv.k = 'A' AND epoch_us(ts_event) - epoch_us(pv.t) <= 864000000000, false) AND coalesce(kd <> 'A', true) AS fnd FROM l),
d AS (SELECT *, CASE WHEN kd = 'A' THEN lvl WHEN fnd THEN pv.p END AS px, CASE WHEN kd = 'A' THEN side WHEN fnd THEN pv.s END AS sd, CASE WHEN kd = 'A' THEN 1 WHEN fnd AND kd = 'C' THEN -1 ELSE 0 END AS dl FROM f),
c AS (SELECT *, sum(dl) OVER (PARTITION BY symbol, px, sd ORDER BY ts_event, sequence) AS ct FROM d WHERE px IS NOT NULL), s AS (SELECT * FROM c WHERE coalesce(kd <> 'C', true)),
h AS (SELECT *, max(ct) OVER {last(30)} AS top, count(*) OVER {last(30)} AS k FROM s)
SELECT o.symbol, o.ts_event, o.sequence, coalesce(CASE WHEN h.k >= 10 AND h.top > 2 THEN least(h.ct / h.top::DOUBLE, 1) ELSE 0 END, 0) AS hidden_volume_ratio FROM o LEFT JOIN h USING (symbol, sequence)""",
    "hidden_volume_ratio",
)
def hidden_volume(spark, sf_dir):
    rows = V.ticks(spark, sf_dir).select(*KEY, "action", "side", F.floor(F.col("price") / 10).alias("price"), (F.col("sequence") % 5).alias("order_id"))
    return S.hidden_volume(rows, 30, limit_ms=864_000_000.0).select(*KEY, "hidden_volume_ratio")


@query(
    "r7_w27_liquidity_trap",
    f"""WITH RECURSIVE {V.TICKS_CTE}, nt AS (SELECT symbol, ts_event, sequence, row_number() OVER ({BY}) AS n, price, (sequence % 21 - 10) / 10.0::DOUBLE AS obi FROM ticks),
rc AS (SELECT symbol, n, ts_event, sequence, price AS ref, obi AS po, NULL::DOUBLE AS sc FROM nt WHERE n = 1 UNION ALL
 SELECT x.symbol, x.n, x.ts_event, x.sequence, CASE WHEN abs(x.price - p.ref) >= 20 THEN x.price ELSE p.ref END, x.obi, CASE WHEN abs(x.price - p.ref) >= 20 THEN -sign(x.price - p.ref) * p.po END FROM rc p JOIN nt x ON x.symbol = p.symbol AND x.n = p.n + 1),
mv AS (SELECT symbol, sequence, avg(sc) OVER ({BY} ROWS 9 PRECEDING) AS m FROM rc WHERE sc IS NOT NULL)
SELECT rc.symbol, rc.ts_event, rc.sequence, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY rc.symbol ORDER BY rc.ts_event, rc.sequence), 0) AS liquidity_trap FROM rc LEFT JOIN mv USING (symbol, sequence)""",
    "liquidity_trap",
)
def liquidity_trap(spark, sf_dir):
    rows = V.ticks(spark, sf_dir).select(*KEY, "price", ((F.col("sequence") % 21 - 10) / 10.0).alias("obi"))
    return S.liquidity_trap(rows, 20.0, 10).select(*KEY, "liquidity_trap")


GATE_CTE = f"""gi AS (SELECT symbol, ts_event, sequence, size, ((sequence * 7) % 31 - 15) / 40.0::DOUBLE AS obi, (sequence % 8) / 10.0::DOUBLE AS bid_wall_strength, (sequence % 9) / 10.0::DOUBLE AS ask_wall_strength, (sequence % 50)::DOUBLE AS cvd, price AS micro_price, (sequence % 13)::DOUBLE AS liquidity_density FROM ticks)"""
GATE = f"{V.TICKS}, {GATE_CTE}"


def gate_input(spark, sf_dir):
    s = F.col("sequence")
    return V.ticks(spark, sf_dir).select(
        *KEY, "size", (((s * 7) % 31 - 15) / 40.0).alias("obi"), ((s % 8) / 10.0).alias("bid_wall_strength"), ((s % 9) / 10.0).alias("ask_wall_strength"), (s % 50).cast("double").alias("cvd"), F.col("price").alias("micro_price"), (s % 13).cast("double").alias("liquidity_density")
    )


def _z(c: str, dev: str, frame: str) -> str:
    return f"coalesce(abs({c} - avg({c}) OVER {frame}) / CASE WHEN {dev}({c}) OVER {frame} = 0 THEN 1e-9 ELSE {dev}({c}) OVER {frame} END, 0)"


BROAD = f"""bf AS (SELECT *, (size > avg(size) OVER {last(20)} * 1.1::DOUBLE)::INT AS cond_vol, (abs(obi) > 0.08::DOUBLE)::INT AS cond_obi, (greatest(bid_wall_strength, ask_wall_strength) > 0.7::DOUBLE)::INT AS cond_wall, size / avg(size) OVER {last(20)} AS vr,
  greatest({', '.join(_z(c, 'stddev_samp', last(20)) for c in V2.SHIFTS)}) AS sh FROM gi), bg AS (SELECT *, (sh > 0.75::DOUBLE)::INT AS cond_shift FROM bf)"""


@query("l14_broad_filter", f"{GATE}, {BROAD} SELECT {K}, cond_vol, cond_obi, cond_wall, cond_shift, greatest(cond_vol, cond_obi, cond_wall, cond_shift) AS event_flag FROM bg")
def broad_filter(spark, sf_dir):
    return V2.broad_filter(gate_input(spark, sf_dir), 20).select(*KEY, "cond_vol", "cond_obi", "cond_wall", "cond_shift", "event_flag")


@query(
    "r8_training_gate",
    f"""{GATE}, {BROAD}, sc AS (SELECT {K}, greatest(cond_vol, cond_obi, cond_wall, cond_shift) AS cand, row_number() OVER ({BY}) - 1 AS i, 0.3::DOUBLE * greatest(vr / 1.1::DOUBLE - 1, 0) + 0.3::DOUBLE * greatest(abs(obi) / 0.08::DOUBLE - 1, 0) + 0.2::DOUBLE * greatest(greatest(bid_wall_strength, ask_wall_strength) / 0.7::DOUBLE - 1, 0) + 0.2::DOUBLE * greatest(sh / 0.75::DOUBLE - 1, 0)
   + 0.5 * greatest(cond_vol + cond_obi + cond_wall + cond_shift - 1, 0) AS score FROM bg),
h AS (SELECT *, coalesce(list(CASE WHEN cand = 1 THEN score END) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS past0 FROM sc), h2 AS (SELECT *, list_sort(list_filter(past0, lambda x: x IS NOT NULL)) AS past FROM h),
q AS (SELECT *, len(past) AS c, len(past)::DOUBLE / greatest(i, 1) AS share FROM h2), k AS (SELECT *, least(greatest(least(0.25::DOUBLE, share) / greatest(share, 1e-9), 0), 1) AS keep FROM q),
a AS (SELECT *, (CASE WHEN keep >= 0.999 THEN 0 ELSE 1 - keep END) * (c - 1) AS pos FROM k),
t AS (SELECT *, CASE WHEN c < 20 THEN 0 ELSE greatest(past[floor(pos)::INT + 1] + (past[least(floor(pos)::INT + 2, c)] - past[floor(pos)::INT + 1]) * (pos - floor(pos)), 0) END AS thr FROM a)
SELECT {K}, score, CASE WHEN cand = 1 THEN thr END AS gate_threshold, cand = 1 AND score >= thr AS gate FROM t""",
    "score gate_threshold",
)
def training_gate(spark, sf_dir):
    return V2.training_gate(gate_input(spark, sf_dir), 20).select(*KEY, "score", "gate_threshold", "gate")


F20 = f"({BY} ROWS 20 PRECEDING)"


def _zp(c: str) -> str:
    return f"CASE WHEN count(*) OVER {F20} > 1 AND stddev_pop({c}) OVER {F20} > 1e-9 THEN abs({c} - avg({c}) OVER {F20}) / stddev_pop({c}) OVER {F20} ELSE 0 END"


@query(
    "r10_event_score",
    f"""{GATE}, e AS (SELECT *, size / greatest(avg(size) OVER {F20}, 1e-9) / 1.1::DOUBLE AS pv, abs(obi) / 0.08::DOUBLE AS po, greatest(bid_wall_strength, ask_wall_strength) / 0.7::DOUBLE AS pw, greatest({', '.join(_zp(c) for c in V2.SHIFTS)}) / 0.75::DOUBLE AS ps FROM gi),
f AS (SELECT *, (pv > 1)::INT + (po > 1)::INT + (pw > 1)::INT + (ps > 1)::INT AS triggers FROM e),
g AS (SELECT *, 0.3::DOUBLE * greatest(pv - 1, 0) + 0.3::DOUBLE * greatest(po - 1, 0) + 0.2::DOUBLE * greatest(pw - 1, 0) + 0.2::DOUBLE * greatest(ps - 1, 0) + 0.5 * greatest(triggers - 1, 0) AS event_score FROM f)
SELECT {K}, event_score, triggers, triggers > 0 AND event_score >= 1.0 AS passed FROM g""",
    "event_score",
)
def event_score(spark, sf_dir):
    rows = gate_input(spark, sf_dir).withColumn("wall", F.greatest("bid_wall_strength", "ask_wall_strength"))
    return V2.event_score(rows, 20, score_limit=1.0).select(*KEY, "event_score", "triggers", "passed")


def signal_bars(spark, sf_dir):
    bars = O.liquidity_columns(O.trade_bars(V.ticks(spark, sf_dir), "12 hours"))
    v = F.col("volume").cast("long")
    return bars.select(
        "symbol", "bar_ts", "close", (F.col("buy_volume") - F.col("sell_volume")).alias("cvd"), F.col("order_flow_imbalance").alias("obi"), (v % 7 / 5.0).alias("hawkes"), F.lit(0.0).alias("micro_atr"),
        F.signum("order_flow_imbalance").cast("int").alias("signal"), (0.5 + (v % 50) / 100.0).alias("confidence"), (v % 3 == 0).alias("trending"),
    )


@query("r9_range_filter")
def range_filter(spark, sf_dir):
    out = S.range_filter(signal_bars(spark, sf_dir), tuple(["bar_ts"]), needed=2, window=6)
    return out.select("symbol", "bar_ts", "action", "action_direction", "confirmations", "range_place", "reversal")


def range_signals(ticks):
    """Signals and evidence on ticks that meet every situation of the range filter; two rows of three have no regime."""
    s, z = F.col("sequence"), F.col("size")
    return ticks.select(
        *KEY, "price", F.when(s % 5 == 0, 0).when(F.col("side") == "A", 1).otherwise(-1).alias("signal"), (0.5 + (z % 50) / 100.0).alias("confidence"), F.when(s % 3 == 0, z % 2 == 0).alias("trending"), (z % 5 == 0).alias("near_bottom"), (z % 7 == 0).alias("near_top"),
        (z % 2 == 0).alias("in_middle"), ((z % 20) / 20.0).alias("range_place"), F.lit(10.0).alias("volatility"), (s % 4).cast("double").alias("reversal"), (s % 7 % 3 - 1).cast("int").alias("reversal_direction"), (s % 11 == 0).alias("broke_out"),
    )


_GATHERING = "why IN ('range_accumulating', 'trend_accumulating')"
RANGE_SQL = f"""WITH RECURSIVE {V.TICKS_CTE}, src AS (
  SELECT symbol, ts_event, sequence, row_number() OVER ({BY}) AS n, price, CASE WHEN sequence % 5 = 0 THEN 0 WHEN side = 'A' THEN 1 ELSE -1 END AS signal, 0.5 + (size % 50) / 100.0::DOUBLE AS confidence, CASE WHEN sequence % 3 = 0 THEN size % 2 = 0 END AS trending,
    CASE WHEN size % 5 = 0 THEN 1 WHEN size % 7 = 0 THEN -1 ELSE 0 END AS side, size % 2 = 0 AS mid, (size % 20) / 20.0::DOUBLE AS place, sequence % 4 AS rev, (sequence % 7 % 3 - 1)::INT AS turn, sequence % 11 = 0 AS broke FROM ticks),
rc AS (
  SELECT symbol, 0::BIGINT AS n, NULL::TIMESTAMP AS ts_event, NULL::BIGINT AS sequence, []::INT[] AS votes, 0 AS g, 0 AS lw, NULL::BIGINT AS ln, 0.0::DOUBLE AS lp, false AS lk, 'UNCERTAIN' AS mk, 'HOLD' AS action, 0 AS way, 0::BIGINT AS conf, '' AS why FROM (SELECT DISTINCT symbol FROM src)
  UNION ALL
  SELECT symbol, n, ts_event, sequence, CASE WHEN enter THEN [] ELSE v3 END, CASE WHEN enter THEN 0 ELSE g3 END, CASE WHEN enter THEN g3 ELSE lw END, CASE WHEN enter THEN n ELSE ln END, CASE WHEN enter THEN price ELSE lp END, enter OR lk2, mk,
    CASE WHEN enter THEN 'ENTER' WHEN why = 'microstructure_reversal' THEN 'CLOSE' ELSE 'HOLD' END, CASE WHEN enter THEN g3 ELSE 0 END, CASE WHEN enter THEN 0 ELSE conf END,
    CASE WHEN NOT enter THEN why WHEN mk = 'RANGING' THEN 'range_confirmed' WHEN goal = 1 THEN 'trend_confirmed_early' ELSE 'trend_confirmed' END
  FROM (SELECT *, {_GATHERING} AND g3 <> 0 AND conf >= goal AS enter FROM (
    SELECT *, CASE WHEN g3 <> 0 THEN len(list_filter(v3, lambda v: v = g3)) ELSE 0 END AS conf,
      CASE WHEN mk = 'RANGING' THEN 2 WHEN (CASE WHEN signal < 0 THEN place >= 0.85 ELSE place <= 1 - 0.85::DOUBLE END) AND confidence >= 0.78 AND rev >= 1 THEN 1 ELSE 2 END AS goal FROM (
    SELECT *, (CASE WHEN {_GATHERING} THEN list_append(v2, signal) WHEN why IN ('low_confidence', 'cooldown', 'range_midzone', 'range_conflict', 'trend_no_signal') THEN list_append(v2, 0) ELSE v2 END)[-6:] AS v3,
      CASE WHEN why IN ('microstructure_reversal', 'range_midzone', 'trend_reversal') THEN 0 WHEN {_GATHERING} AND signal <> 0 THEN signal ELSE g2 END AS g3 FROM (
    SELECT *, CASE WHEN done OR why IN ('microstructure_reversal', 'trend_reversal') THEN [] ELSE v1 END AS v2, CASE WHEN done THEN 0 ELSE g1 END AS g2, lk AND NOT done AS lk2 FROM (
    SELECT *, lk AND why NOT IN ('low_confidence', 'position_locked') AS done FROM (
    SELECT *, CASE WHEN confidence < 0.55 AND signal <> 0 THEN 'low_confidence' WHEN lk AND rev >= 2 THEN 'microstructure_reversal' WHEN lk AND since < 8 THEN 'position_locked' WHEN since < 4 THEN 'cooldown'
      WHEN mk = 'RANGING' AND mid AND side = 0 THEN 'range_midzone' WHEN mk = 'RANGING' AND side <> 0 AND signal NOT IN (0, side) THEN 'range_conflict' WHEN mk = 'RANGING' THEN 'range_accumulating'
      WHEN rev >= 2 AND g1 <> 0 AND turn = -g1 AND NOT lk THEN 'trend_reversal' WHEN signal = 0 THEN 'trend_no_signal' WHEN signal = lw AND abs(price - lp) < 20 THEN 'trend_same_zone' ELSE 'trend_accumulating' END AS why FROM (
    SELECT *, CASE WHEN moved THEN [] ELSE votes END AS v1, CASE WHEN moved THEN 0 ELSE g END AS g1, coalesce(n - ln, 1000000) AS since FROM (
    SELECT *, trending IS NULL AND mk = 'TRENDING' AND mk0 <> 'TRENDING' AS moved FROM (
    SELECT x.*, p.votes, p.g, p.lw, p.ln, p.lp, p.lk, p.mk AS mk0,
      CASE WHEN x.trending THEN 'TRENDING' WHEN NOT x.trending THEN 'RANGING' WHEN p.mk = 'RANGING' AND x.broke THEN 'TRENDING' WHEN p.mk = 'UNCERTAIN' THEN 'RANGING' ELSE p.mk END AS mk
    FROM rc p JOIN src x ON x.symbol = p.symbol AND x.n = p.n + 1)))))))))
)
SELECT symbol, ts_event, sequence, action, way::BIGINT AS action_direction, conf AS confirmations, mk AS market_state, why AS filter_reason FROM rc WHERE n > 0"""


@query("r9_market_state", RANGE_SQL)
def market_state(spark, sf_dir):
    """The range filter where breakouts decide on the market, each action with its reason."""
    machine = Z.RangeFilter(needed=2, window=6)
    return S.fold(range_signals(V.ticks(spark, sf_dir)), machine).select(*KEY, *machine.outputs)


TRADE_DAYS = f"{PRED_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, {TRADES_CTE}, nt AS (SELECT *, datediff('day', DATE '1970-01-01', entry_ts::DATE) AS day, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts, trade_seq) AS n FROM trades)"


@query(
    "r11_loss_guard",
    f"""{TRADE_DAYS}, rc AS (SELECT symbol, 0::BIGINT AS n, NULL::BIGINT AS trade_seq, -1::BIGINT AS day, 0.0::DOUBLE AS loss, 0 AS c, false AS bl, 1000.0::DOUBLE AS eq, 1000.0::DOUBLE AS pk, false AS acc FROM (SELECT DISTINCT symbol FROM nt) UNION ALL
 SELECT symbol, n, trade_seq, day, l1, c1, CASE WHEN acc1 THEN greatest(-l1, 0) / greatest(eq1, 1) >= 0.02::DOUBLE OR (greatest(pk, eq1) - eq1) / greatest(greatest(pk, eq1), 1) >= 0.5 OR c1 >= 2 ELSE b0 END, eq1, greatest(pk, eq1), acc1 FROM
  (SELECT *, CASE WHEN acc1 THEN eq + pnl ELSE eq END AS eq1, CASE WHEN acc1 THEN l0 + pnl ELSE l0 END AS l1, CASE WHEN acc1 THEN c0 + 1 ELSE c0 END AS c1 FROM (SELECT *, NOT b0 AS acc1 FROM
   (SELECT x.symbol, x.n, x.trade_seq, x.day, x.pnl, CASE WHEN x.day <> p.day THEN 0 ELSE p.loss END AS l0, CASE WHEN x.day <> p.day THEN 0 ELSE p.c END AS c0, CASE WHEN x.day <> p.day THEN false ELSE p.bl END AS b0, p.eq, p.pk FROM rc p JOIN nt x ON x.symbol = p.symbol AND x.n = p.n + 1))))
SELECT symbol, trade_seq, acc AS accepted, eq AS equity_after, bl AS blocked FROM rc WHERE n > 0""",
    "equity_after",
)
def loss_guard(spark, sf_dir):
    rows = trades(spark, sf_dir).withColumn("day", F.unix_date(F.to_date("entry_ts")))
    out = S.loss_guard(rows, order=["entry_ts", "trade_seq"], equity=1000.0, max_trades=2, max_drawdown=0.5)
    return out.select("symbol", "trade_seq", "accepted", "equity_after", "blocked")


@query(
    "r12_one_at_a_time",
    f"""{TRADE_DAYS}, iv AS (SELECT symbol, trade_seq, n, epoch_us(entry_ts) AS b, epoch_us(entry_ts) + (trade_seq % 5) * 86400000000 AS e FROM nt),
rc AS (SELECT symbol, n, trade_seq, true AS acc, e + 3600000000 AS fr FROM iv WHERE n = 1 UNION ALL SELECT x.symbol, x.n, x.trade_seq, x.b >= p.fr, CASE WHEN x.b >= p.fr THEN x.e + 3600000000 ELSE p.fr END FROM rc p JOIN iv x ON x.symbol = p.symbol AND x.n = p.n + 1)
SELECT symbol, trade_seq, acc AS accepted FROM rc""",
)
def one_at_a_time(spark, sf_dir):
    begin = F.unix_micros(F.col("entry_ts").cast("timestamp"))
    rows = trades(spark, sf_dir).withColumns({"start_at": begin, "end_at": begin + (F.col("trade_seq") % 5) * 86_400_000_000})
    return S.fold(rows, Z.OneAtATime(pause=3_600_000_000), order=["entry_ts", "trade_seq"]).select("symbol", "trade_seq", "accepted")


@query(
    "r13_online_volatility",
    f"""{V.TICKS}, r AS (SELECT *, (price - lag(price) OVER w) / greatest(abs(lag(price) OVER w), 1e-10) AS r FROM ticks WINDOW w AS ({BY})), k AS (SELECT *, r * r AS q FROM r WHERE r IS NOT NULL),
e AS (SELECT *, {ewm_sql('q', '(1 - 0.94::DOUBLE)', 'ts_event, sequence')} AS v, CASE WHEN count(r) OVER {last(30)} >= 10 THEN greatest(stddev_pop(r) OVER {last(30)}, 1e-10) END AS b FROM k)
SELECT t.symbol, t.ts_event, t.sequence, coalesce(sqrt(v), 0) AS garch_vol, CASE WHEN v IS NULL OR v <= 0 THEN 0 WHEN b IS NULL THEN 1 WHEN sqrt(v) / b < 0.8 THEN 0 WHEN sqrt(v) / b < 1.5 THEN 1 ELSE 2 END::BIGINT AS garch_regime FROM ticks t LEFT JOIN e USING (symbol, sequence)""",
    "garch_vol",
)
def online_volatility(spark, sf_dir):
    rows = V.ticks(spark, sf_dir).select(*KEY, "price")
    return S.volatility_regime(rows, n=30, least=10, online=True).select(*KEY, "garch_vol", "garch_regime")


@query(
    "w33_volatility_regime",
    f"""{V.TICKS}, r AS (SELECT *, coalesce((price - lag(price) OVER w) / greatest(abs(lag(price) OVER w), 1e-10), 0) AS r FROM ticks WINDOW w AS ({BY})), k AS (SELECT *, r * r AS q FROM r),
e AS (SELECT *, {ewm_sql('q', '(1 - 0.94::DOUBLE)', 'ts_event, sequence')} AS v, CASE WHEN count(r) OVER {last(30)} >= 10 THEN greatest(stddev_samp(r) OVER {last(30)}, 1e-10) END AS b FROM k)
SELECT {K}, sqrt(v) AS garch_vol, CASE WHEN b IS NULL THEN 1 WHEN sqrt(v) / b < 0.8 THEN 0 WHEN sqrt(v) / b < 1.5 THEN 1 ELSE 2 END::BIGINT AS garch_regime FROM e""",
    "garch_vol",
)
def volatility_regime(spark, sf_dir):
    return S.volatility_regime(V.ticks(spark, sf_dir).select(*KEY, "price"), n=30, least=10).select(*KEY, "garch_vol", "garch_regime")


def _ffd(threshold: float, d: float = 0.4) -> list[float]:
    w = [1.0]
    for k in range(1, 2000):
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < threshold:
            break
        w.append(nxt)
    return w


_W = _ffd(0.005)


@query(
    "w34_fractional_difference",
    f"{V.TICKS}, l AS (SELECT *, {', '.join(f'coalesce(lag(price, {i}) OVER w, 0) AS l{i}' for i in range(len(_W)))} FROM ticks WINDOW w AS ({BY})) SELECT {K}, {' + '.join(f'({w!r}::DOUBLE) * l{i}' for i, w in enumerate(_W))} AS price_frac FROM l",
    "price_frac",
)
def fractional_difference(spark, sf_dir):
    return S.fractional_difference(V.ticks(spark, sf_dir).select(*KEY, "price"), "price", threshold=0.005).select(*KEY, "price_frac")


EVB = f"""{BARS}, eb AS (SELECT symbol, bar_ts, (volume::BIGINT % 11)::DOUBLE AS hawkes_intensity, (volume::BIGINT % 7)::DOUBLE AS absorption_intensity, close - open AS kyle_lambda, buy_ratio AS cvd_direction_pct FROM trade_bars)"""


def event_bars(spark, sf_dir):
    v = F.col("volume").cast("long")
    return day_bars(spark, sf_dir).select("symbol", "bar_ts", (v % 11).cast("double").alias("hawkes_intensity"), (v % 7).cast("double").alias("absorption_intensity"), (F.col("close") - F.col("open")).alias("kyle_lambda"), F.col("buy_ratio").alias("cvd_direction_pct"))


P8 = "(PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"


def _pz(c: str) -> str:
    return f"CASE WHEN count({c}) OVER {P8} >= 3 THEN coalesce(({c} - avg({c}) OVER {P8}) / (stddev_samp({c}) OVER {P8} + 1e-9), 0) ELSE 0 END"


EVS = f"""ez AS (SELECT *, {_pz('hawkes_intensity')} AS hz, {_pz('absorption_intensity')} AS az, {_pz('kyle_lambda')} AS kz FROM eb),
es AS (SELECT *, greatest(least((hz - 1.0) / 2, 1), 0) * 0.3 + greatest(least((az - 1.0) / 2, 1), 0) * 0.3 + greatest(least((kz - 0.5) / 2, 1), 0) * 0.2 + greatest(least((cvd_direction_pct - 0.6::DOUBLE) / 0.4::DOUBLE, 1), 0) * 0.2 AS event_score FROM ez),
et AS (SELECT *, greatest(least(coalesce(CASE WHEN count(*) OVER {P8} >= 3 THEN quantile_cont(event_score, 0.8) OVER {P8} END, 0.05), 1.0), 0.05) AS event_threshold FROM es)"""


@query("w9_prior_zscore", f"{EVB}, {EVS} SELECT symbol, bar_ts, hz AS hawkes_intensity_prior_z, az AS absorption_intensity_prior_z FROM ez", "hawkes_intensity_prior_z absorption_intensity_prior_z")
def prior_zscore(spark, sf_dir):
    out = V2.prior_zscore(event_bars(spark, sf_dir), ["hawkes_intensity", "absorption_intensity"], 8, 3, order=["bar_ts"], check=False)
    return out.select("symbol", "bar_ts", "hawkes_intensity_prior_z", "absorption_intensity_prior_z")


@query("l15_w10_bar_events", f"{EVB}, {EVS} SELECT symbol, bar_ts, event_score, greatest(least(event_threshold, 0.95), 0.05) AS event_threshold, (event_score >= greatest(least(event_threshold, 0.95), 0.05))::BIGINT AS is_event FROM et", "event_score event_threshold")
def bar_events(spark, sf_dir):
    return V2.bar_events(event_bars(spark, sf_dir), floor=0.05, n=8, least=3).select("symbol", "bar_ts", "event_score", "event_threshold", "is_event")


@query("l16_rate_mask", f"{EVB}, {EVS} SELECT symbol, bar_ts, event_threshold, cvd_direction_pct > 0.5 AND event_score >= event_threshold AS kept FROM et", "event_threshold")
def rate_mask(spark, sf_dir):
    bars = V2.bar_events(event_bars(spark, sf_dir), floor=0.05, n=8, least=3).drop("event_threshold")
    out = V2.rate_mask(bars, "event_score", F.col("cvd_direction_pct") > 0.5, 0.20, 0.05, n=8, least=3, order=["bar_ts"], check=False)
    return out.select("symbol", "bar_ts", "event_threshold", "kept")
