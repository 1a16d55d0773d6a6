"""Queries over book snapshots and as-of joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import book as B
from tapeloom.functions.market import is_trade
from tapeloom.operators import asof as J
from tapeloom.operators import snapshots as S
from tapeloom.plans import views as V
from tapeloom.plans.bar_queries import CVD_CTE
from tapeloom.plans.registry import query

KEY = ["symbol", "ts_event", "sequence"]
K = "symbol, ts_event, sequence"
BY = "PARTITION BY symbol ORDER BY ts_event, sequence"
TICK = 0.008  # below the view's level distance, so that gaps occur

WB = "list_sum(list_transform(range(1, 11), lambda i: {a}[i] / i))"
TOP_CTE = f"""top AS (
  SELECT *, (bid_px[1] + ask_px[1]) / 2 AS mid_price, ask_px[1] - bid_px[1] AS spread,
   (ask_px[1] * bid_sz[1] + bid_px[1] * ask_sz[1]) / (bid_sz[1] + ask_sz[1]) AS microprice,
   list_sum(bid_sz) AS bid_depth, list_sum(ask_sz) AS ask_depth,
   (list_sum(bid_sz) - list_sum(ask_sz)) / (list_sum(bid_sz) + list_sum(ask_sz)) AS depth_imbalance,
   ({WB.format(a='bid_sz')} - {WB.format(a='ask_sz')}) / ({WB.format(a='bid_sz')} + {WB.format(a='ask_sz')}) AS order_book_imbalance FROM book)"""


@query(
    "f1_f5_top_of_book",
    f"""{V.BOOK}, {TOP_CTE} SELECT {K}, mid_price, spread, microprice, (bid_px[1] * bid_sz[1] + ask_px[1] * ask_sz[1]) / (bid_sz[1] + ask_sz[1]) AS microprice_own_side,
    bid_depth, ask_depth, depth_imbalance, order_book_imbalance, order_book_imbalance / spread AS liquidity_pressure FROM top""",
    "mid_price spread microprice microprice_own_side bid_depth ask_depth depth_imbalance order_book_imbalance liquidity_pressure",
    digits=7,
)
def top_of_book(spark, sf_dir):
    rows = S.top_of_book(V.book(spark, sf_dir)).withColumn("microprice_own_side", B.microprice(bid_weighted=True))
    return rows.select(*KEY, "mid_price", "spread", "microprice", "microprice_own_side", "bid_depth", "ask_depth", "depth_imbalance", "order_book_imbalance", "liquidity_pressure")


@query(
    "f6_level_features",
    f"""{V.BOOK} SELECT {K}, u.lv::BIGINT AS level, bid_sz[u.lv + 1] AS bid_size, ask_sz[u.lv + 1] AS ask_size,
    (bid_sz[u.lv + 1] - ask_sz[u.lv + 1]) / (bid_sz[u.lv + 1] + ask_sz[u.lv + 1]) AS level_imbalance,
    ((bid_px[1] + ask_px[1]) / 2 - bid_px[u.lv + 1]) / 0.01::DOUBLE AS bid_distance_ticks, (ask_px[u.lv + 1] - (bid_px[1] + ask_px[1]) / 2) / 0.01::DOUBLE AS ask_distance_ticks
    FROM book, (SELECT unnest(range(0, 10)) AS lv) u""",
    "bid_size ask_size level_imbalance bid_distance_ticks ask_distance_ticks",
)
def level_features(spark, sf_dir):
    rows = S.level_features(V.book(spark, sf_dir), 0.01)
    zipped = F.arrays_zip(F.col("bid_sz").alias("bid_size"), F.col("ask_sz").alias("ask_size"), "level_imbalance", "bid_distance_ticks", "ask_distance_ticks")
    return rows.select(*KEY, F.posexplode(zipped).alias("level", "lv")).select(*KEY, "level", "lv.*")


RMEAN = "greatest(avg((bid_depth + ask_depth) / 20) OVER ({BY} ROWS 199 PRECEDING), 1e-9)".replace("{BY}", BY)
SOFT = """list_extract(list_filter(list_transform(range(1, 10), lambda i: CASE WHEN abs({px}[i] - {px}[i + 1]) / 0.008::DOUBLE >= 2.0
   OR (abs({px}[i] - {px}[i + 1]) / 0.008::DOUBLE >= 1.0 AND greatest(0.0, 1 - least({sz}[i], {sz}[i + 1]) / m) >= 0.65
     AND abs({px}[i] - {px}[i + 1]) / 0.008::DOUBLE + 0.80 * greatest(0.0, 1 - least({sz}[i], {sz}[i + 1]) / m) + 0.60 * greatest(0.0, 1 - ({sz}[i] + {sz}[i + 1]) / 2 / m) >= 1.60)
   THEN abs({px}[i] - {px}[i + 1]) / 0.008::DOUBLE + 0.80 * greatest(0.0, 1 - least({sz}[i], {sz}[i + 1]) / m) + 0.60 * greatest(0.0, 1 - ({sz}[i] + {sz}[i + 1]) / 2 / m) END),
   lambda v: v IS NOT NULL), 1)"""


@query(
    "f9_f10_walls_and_gaps",
    f"""{V.BOOK}, {TOP_CTE}, w AS (SELECT *, {RMEAN} AS m FROM top),
l AS (SELECT *, list_filter(range(1, 11), lambda i: bid_sz[i] >= m * 1.5)[1] AS bi, list_filter(range(1, 11), lambda i: ask_sz[i] >= m * 1.5)[1] AS ai FROM w)
SELECT {K}, m AS mean_level_size, coalesce(bid_sz[bi] / m, 0) AS bid_wall_strength, coalesce(ask_sz[ai] / m, 0) AS ask_wall_strength,
 coalesce(least((mid_price - bid_px[bi]) / 0.008::DOUBLE, (ask_px[ai] - mid_price) / 0.008::DOUBLE), 0) AS distance_to_wall,
 greatest(coalesce({SOFT.format(px='bid_px', sz='bid_sz')}, 0), coalesce({SOFT.format(px='ask_px', sz='ask_sz')}, 0)) AS gap_size FROM l""",
    "mean_level_size bid_wall_strength ask_wall_strength distance_to_wall gap_size",
)
def walls_and_gaps(spark, sf_dir):
    rows = S.wall_features(V.book(spark, sf_dir), TICK, multiple=1.5)
    return rows.select(*KEY, "mean_level_size", "bid_wall_strength", "ask_wall_strength", "distance_to_wall", "gap_size")


GAPN = "list_sum(list_transform(range(1, 10), lambda i: (abs({a}px[i + 1] - {a}px[i]) > 0.008::DOUBLE)::INT + (CASE WHEN {a}sz[i] = 0 THEN 0.5 ELSE 0 END)))"
GAPE = "list_sum(list_transform(range(1, 10), lambda i: CASE WHEN abs({a}px[i + 1] - {a}px[i]) > 0.008::DOUBLE * 1.25 THEN 1.0 WHEN {a}sz[i] = 0 THEN 0.5 ELSE 0 END))"


@query(
    "f7_f8_w50_density_gap_scores",
    f"""{V.BOOK}, g AS (SELECT *, ({GAPN.format(a='bid_')} + {GAPN.format(a='ask_')} + (ask_px[1] - bid_px[1] > 0.016::DOUBLE)::INT) / 19.0 AS vec,
   ({GAPE.format(a='bid_')} + {GAPE.format(a='ask_')} + (ask_px[1] - bid_px[1] > 0.016::DOUBLE)::INT) / (18.0 + (ask_px[1] - bid_px[1] > 0.016::DOUBLE)::INT) AS snap,
   (list_sum(bid_sz[1:5]) + list_sum(ask_sz[1:5])) / greatest((ask_px[5] - ask_px[1]) / 0.008::DOUBLE + (bid_px[1] - bid_px[5]) / 0.008::DOUBLE, 1) AS liquidity_density FROM book)
SELECT {K}, liquidity_density, avg(vec) OVER w AS liquidity_gaps, CASE WHEN count(*) OVER w >= 3 THEN avg(snap) OVER w ELSE snap END AS gap_score
FROM g WINDOW w AS ({BY} ROWS 49 PRECEDING)""",
    "liquidity_density liquidity_gaps gap_score",
)
def density_gap_scores(spark, sf_dir):
    rows = V.book(spark, sf_dir).withColumns({"liquidity_density": B.density(TICK), "gap_now": B.gap_score(TICK, 1.25)})

    def means(df, w):
        recent = w.rowsBetween(-49, 0)
        return df.withColumn("gap_score", F.when(F.count("gap_now").over(recent) >= 3, F.avg("gap_now").over(recent)).otherwise(F.col("gap_now")))

    return S.windowed(S.gap_means(rows, TICK), means, before=50).select(*KEY, "liquidity_density", "liquidity_gaps", "gap_score")


@query(
    "f11_biggest_wall",
    f"""{V.BOOK} SELECT {K},
 CASE WHEN list_max(bid_sz) > list_avg(bid_sz) * 1.5 THEN round(abs((bid_px[1] + ask_px[1]) / 2 - bid_px[list_position(bid_sz, list_max(bid_sz))]), 4) ELSE 0 END AS dist_to_bid_wall,
 CASE WHEN list_max(ask_sz) > list_avg(ask_sz) * 1.5 THEN round(abs((bid_px[1] + ask_px[1]) / 2 - ask_px[list_position(ask_sz, list_max(ask_sz))]), 4) ELSE 0 END AS dist_to_ask_wall FROM book""",
    "dist_to_bid_wall dist_to_ask_wall",
    digits=3,
)
def biggest_wall(spark, sf_dir):
    rows = V.book(spark, sf_dir)
    return rows.select(
        *KEY,
        B.biggest_wall_distance("bid_px", "bid_sz", B.mid(), 1.5).alias("dist_to_bid_wall"),
        B.biggest_wall_distance("ask_px", "ask_sz", B.mid(), 1.5).alias("dist_to_ask_wall"),
    )


MLOFI_CTE = f"""lagged AS (SELECT *, coalesce(lag(bid_px) OVER w, bid_px) AS pbp, coalesce(lag(bid_sz) OVER w, bid_sz) AS pbs,
   coalesce(lag(ask_px) OVER w, ask_px) AS pap, coalesce(lag(ask_sz) OVER w, ask_sz) AS pas FROM top WINDOW w AS ({BY})),
ofi AS (SELECT *, list_transform(range(1, 11), lambda i: (CASE WHEN bid_px[i] > pbp[i] THEN bid_sz[i] WHEN bid_px[i] = pbp[i] THEN bid_sz[i] - pbs[i] ELSE -pbs[i] END)
   - (CASE WHEN ask_px[i] < pap[i] THEN ask_sz[i] WHEN ask_px[i] = pap[i] THEN ask_sz[i] - pas[i] ELSE -pas[i] END)) AS mlofi FROM lagged)"""


@query(
    "w1_mlofi",
    f"{V.BOOK}, {TOP_CTE}, {MLOFI_CTE} SELECT {K}, {', '.join(f'mlofi[{i + 1}] AS mlofi_{i:02d}' for i in range(10))}, list_sum(mlofi) AS mlofi_sum, mlofi[1] + mlofi[2] + mlofi[3] AS mlofi_top3 FROM ofi",
    " ".join(f"mlofi_{i:02d}" for i in range(10)) + " mlofi_sum mlofi_top3",
)
def mlofi(spark, sf_dir):
    rows = S.with_mlofi(V.book(spark, sf_dir))
    return rows.select(*KEY, *[F.get("mlofi", i).alias(f"mlofi_{i:02d}") for i in range(10)], "mlofi_sum", "mlofi_top3")


STATE_CTE = f"""st AS (SELECT symbol, ts_event AS mbo_state_ts, sum(CASE WHEN side = 'A' THEN size ELSE -size END)::DOUBLE AS mbo_signed_trade_size,
   sum(CASE WHEN side = 'A' THEN size ELSE 0 END)::DOUBLE AS mbo_buy_trade_size, sum(CASE WHEN side = 'B' THEN size ELSE 0 END)::DOUBLE AS mbo_sell_trade_size,
   count(*) AS mbo_trade_count, last(price ORDER BY sequence) AS mbo_last_trade_price FROM ticks WHERE action = 'T' AND price > 0 AND size >= 0 GROUP BY ALL),
state AS (SELECT *, sum(mbo_signed_trade_size) OVER w AS mbo_cvd, sum(mbo_buy_trade_size) OVER w AS mbo_cum_buy_volume, sum(mbo_sell_trade_size) OVER w AS mbo_cum_sell_volume,
   (sum(mbo_trade_count) OVER w)::BIGINT AS mbo_cum_trade_count FROM st WINDOW w AS (PARTITION BY symbol ORDER BY mbo_state_ts))"""
STATE_DOUBLES = "mbo_signed_trade_size mbo_buy_trade_size mbo_sell_trade_size mbo_last_trade_price mbo_cvd mbo_cum_buy_volume mbo_cum_sell_volume"


@query("a4_w2_flow_state", f"{V.TICKS}, {STATE_CTE} SELECT * FROM state", STATE_DOUBLES)
def flow_state(spark, sf_dir):
    return J.flow_state(V.ticks(spark, sf_dir))


ALIGNED_CTE = f"""{STATE_CTE}, aligned AS (SELECT b.*, s.mbo_state_ts, coalesce(s.mbo_signed_trade_size, 0) AS mbo_signed_trade_size, coalesce(s.mbo_buy_trade_size, 0) AS mbo_buy_trade_size,
   coalesce(s.mbo_sell_trade_size, 0) AS mbo_sell_trade_size, coalesce(s.mbo_trade_count, 0) AS mbo_trade_count, s.mbo_last_trade_price, coalesce(s.mbo_cvd, 0) AS mbo_cvd,
   coalesce(s.mbo_cum_buy_volume, 0) AS mbo_cum_buy_volume, coalesce(s.mbo_cum_sell_volume, 0) AS mbo_cum_sell_volume, coalesce(s.mbo_cum_trade_count, 0) AS mbo_cum_trade_count
   FROM {{src}} b ASOF LEFT JOIN state s ON b.symbol = s.symbol AND b.ts_event >= s.mbo_state_ts)"""


@query(
    "j1_asof_flow_to_book",
    f"{V.BOOK}, {ALIGNED_CTE.format(src='book')} SELECT {K}, mbo_state_ts, {', '.join(STATE_DOUBLES.split())}, mbo_trade_count, mbo_cum_trade_count FROM aligned",
    STATE_DOUBLES,
)
def asof_flow(spark, sf_dir):
    out = J.align_flow(V.book(spark, sf_dir), J.flow_state(V.ticks(spark, sf_dir)))
    return out.select(*KEY, "mbo_state_ts", *STATE_DOUBLES.split(), "mbo_trade_count", "mbo_cum_trade_count")


@query(
    "j2_asof_tolerance",
    f"""{V.BOOK}, t AS (SELECT * FROM ticks WHERE action = 'T'), m AS (SELECT t.symbol, t.ts_event, t.sequence, t.price, b.ts_event AS match_ts, b.bid_px[1] AS bid, b.bid_sz[1] AS bsz
  FROM t ASOF LEFT JOIN book b ON t.symbol = b.symbol AND t.ts_event >= b.ts_event)
SELECT {K}, price, CASE WHEN epoch_us(ts_event) - epoch_us(match_ts) <= 14400000000 THEN match_ts END AS match_ts,
  CASE WHEN epoch_us(ts_event) - epoch_us(match_ts) <= 14400000000 THEN bid ELSE 0 END AS best_bid, CASE WHEN epoch_us(ts_event) - epoch_us(match_ts) <= 14400000000 THEN bsz ELSE 0 END AS best_bid_size FROM m""",
    "price best_bid best_bid_size",
)
def asof_tolerance(spark, sf_dir):
    trades = V.ticks(spark, sf_dir).filter(is_trade()).select(*KEY, "price")
    best = V.book(spark, sf_dir).select(*KEY, B.level("bid_px", 0).alias("best_bid"), B.level("bid_sz", 0).alias("best_bid_size"))
    out = J.asof(trades, best, columns=["best_bid", "best_bid_size"], tolerance_ms=4 * 3600 * 1000)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("best_bid", "best_bid_size")})


AGE = "(epoch_us(ts_event) - epoch_us(mbo_state_ts)) / 1000.0"


@query(
    "j3_age_report",
    f"""{V.BOOK}, {ALIGNED_CTE.format(src='book')}, a AS (SELECT {AGE}::DOUBLE AS age FROM aligned),
s AS (SELECT count(*) AS rows, count(age) AS matched_rows, min(age) AS age_min, max(age) AS age_max, {', '.join(f'sum((coalesce(age, 0) > {s * 1000})::INT)::DOUBLE / count(*) AS pct_age_gt_{s}s' for s in (1, 5, 10, 30, 60))},
  quantile_cont(age, 0.5) AS age_median, quantile_cont(age, 0.9) AS age_p90, quantile_cont(age, 0.95) AS age_p95, quantile_cont(age, 0.99) AS age_p99 FROM a)
SELECT *, matched_rows::DOUBLE / rows AS match_rate, age_p95 > 30000 AS stale_warning, age_p95 > 120000 AS stale_critical, (matched_rows::DOUBLE / rows >= 0.95 AND age_p95 <= 30000) AS reliable FROM s""",
    "age_min age_max pct_age_gt_1s pct_age_gt_5s pct_age_gt_10s pct_age_gt_30s pct_age_gt_60s age_median age_p90 age_p95 age_p99 match_rate",
    digits=3,
)
def age_report(spark, sf_dir):
    return J.age_report(J.align_flow(V.book(spark, sf_dir), J.flow_state(V.ticks(spark, sf_dir))))


@query(
    "e30_flow_reliability",
    f"""{V.BOOK}, {ALIGNED_CTE.format(src='book')}, a AS (SELECT {AGE}::DOUBLE AS age FROM aligned),
s AS (SELECT count(age)::DOUBLE / count(*) AS match_rate, quantile_cont(age, 0.95) AS p95 FROM a)
SELECT (match_rate >= 0.95 AND p95 <= 30000) AS mbo_flow_features_reliable, NOT (match_rate >= 0.95 AND p95 <= 30000) AS mbo_flow_features_stale, true AS mbp_mlofi_features_reliable FROM s""",
)
def flow_reliability(spark, sf_dir):
    report = J.age_report(J.align_flow(V.book(spark, sf_dir), J.flow_state(V.ticks(spark, sf_dir))))
    return report.select(
        F.col("reliable").alias("mbo_flow_features_reliable"),
        (~F.col("reliable")).alias("mbo_flow_features_stale"),
        F.lit(True).alias("mbp_mlofi_features_reliable"),
    )


CLOCK = "clock AS (SELECT symbol, bar_ts AS ts_event FROM (SELECT DISTINCT symbol, date_trunc('hour', ts_event) AS bar_ts FROM ticks WHERE action = 'T'))"


def _clock(spark, sf_dir):
    from tapeloom.operators.bars import with_bar

    return with_bar(V.ticks(spark, sf_dir).filter(is_trade()), "1 hour").select("symbol", F.col("bar_ts").alias("ts_event")).distinct()


@query(
    "j4_align_rows_to_clock",
    f"""{V.TICKS}, {CLOCK}, m AS (SELECT t.symbol, t.ts_event, t.sequence, c.ts_event AS cts FROM ticks t ASOF LEFT JOIN clock c ON t.symbol = c.symbol AND t.ts_event >= c.ts_event)
SELECT symbol, ts_event, sequence, CASE WHEN epoch_us(ts_event) - epoch_us(cts) <= 7200000000 THEN cts END AS clock_ts FROM m""",
)
def align_rows(spark, sf_dir):
    return J.nearest_within(V.ticks(spark, sf_dir).select(*KEY), _clock(spark, sf_dir), 7_200_000)


@query(
    "j4_align_clock_to_rows",
    f"""{V.TICKS}, {CLOCK}, m AS (SELECT c.symbol, c.ts_event, t.ts_event AS rts, t.sequence FROM clock c ASOF LEFT JOIN ticks t ON c.symbol = t.symbol AND c.ts_event >= t.ts_event)
SELECT symbol, ts_event, CASE WHEN epoch_us(ts_event) - epoch_us(rts) <= 7200000000 THEN rts END AS match_ts, CASE WHEN epoch_us(ts_event) - epoch_us(rts) <= 7200000000 THEN sequence ELSE -1 END AS row_sequence FROM m""",
)
def align_clock(spark, sf_dir):
    rows = V.ticks(spark, sf_dir).select(*KEY, F.col("sequence").alias("row_sequence"))
    out = J.asof(_clock(spark, sf_dir), rows, columns=["row_sequence"], tolerance_ms=7_200_000)
    return out.withColumn("row_sequence", F.coalesce("row_sequence", F.lit(-1)))


@query(
    "j5_overlap_ratio",
    f"""{V.TICKS}, {CLOCK}, m AS (SELECT t.symbol, t.ts_event, c.ts_event AS cts FROM ticks t ASOF LEFT JOIN clock c ON t.symbol = c.symbol AND t.ts_event >= c.ts_event)
SELECT symbol, count(*) AS rows, sum((coalesce(epoch_us(ts_event) - epoch_us(cts) <= 3600000000, false))::INT)::BIGINT AS matched,
 sum((coalesce(epoch_us(ts_event) - epoch_us(cts) <= 3600000000, false))::INT)::DOUBLE / count(*) AS overlap FROM m GROUP BY symbol""",
    "overlap",
)
def overlap_ratio(spark, sf_dir):
    return J.overlap_ratio(V.ticks(spark, sf_dir), _clock(spark, sf_dir), 3_600_000)


@query(
    "j6_snapshot_position",
    f"""{V.BOOK}, p AS (SELECT *, row_number() OVER ({BY}) - 1 AS position FROM book), t AS (SELECT * FROM ticks WHERE action = 'T')
SELECT t.symbol, t.ts_event, t.sequence, coalesce(p.position, -1) AS position FROM t ASOF LEFT JOIN p ON t.symbol = p.symbol AND t.ts_event >= p.ts_event""",
)
def snapshot_position(spark, sf_dir):
    out = J.snapshot_position(V.ticks(spark, sf_dir).filter(is_trade()).select(*KEY), V.book(spark, sf_dir))
    return out.withColumn("position", F.coalesce("position", F.lit(-1)))


@query(
    "w4_w5_interval_flow",
    f"""{V.BOOK}, {ALIGNED_CTE.format(src='book')}
SELECT {K}, mbo_cvd - coalesce(lag(mbo_cvd) OVER w, 0) AS mbo_signed_trade_size_since_prev_mbp, mbo_cum_buy_volume - coalesce(lag(mbo_cum_buy_volume) OVER w, 0) AS mbo_buy_trade_size_since_prev_mbp,
 mbo_cum_sell_volume - coalesce(lag(mbo_cum_sell_volume) OVER w, 0) AS mbo_sell_trade_size_since_prev_mbp, mbo_cum_trade_count - coalesce(lag(mbo_cum_trade_count) OVER w, 0) AS mbo_trade_count_since_prev_mbp,
 greatest(coalesce((epoch_us(ts_event) - lag(epoch_us(ts_event)) OVER w) / 1e6, 0), 0) AS inter_event_time, coalesce((epoch_us(ts_event) - epoch_us(mbo_state_ts)) / 1e3, -1) AS mbo_state_age_ms,
 mbo_cvd - first_value(mbo_cvd) OVER ({BY} ROWS 20 PRECEDING) AS mbo_cvd_momentum_20 FROM aligned WINDOW w AS ({BY})""",
    "mbo_signed_trade_size_since_prev_mbp mbo_buy_trade_size_since_prev_mbp mbo_sell_trade_size_since_prev_mbp inter_event_time mbo_state_age_ms mbo_cvd_momentum_20",
    digits=3,
)
def interval_flow(spark, sf_dir):
    rows = S.interval_flow(J.align_flow(V.book(spark, sf_dir), J.flow_state(V.ticks(spark, sf_dir))))
    names = "mbo_signed_trade_size_since_prev_mbp mbo_buy_trade_size_since_prev_mbp mbo_sell_trade_size_since_prev_mbp mbo_trade_count_since_prev_mbp inter_event_time mbo_state_age_ms mbo_cvd_momentum_20"
    return rows.select(*KEY, *names.split())


def _frame(n: int) -> str:
    return f"({BY} ROWS {n - 1} PRECEDING)"


def _rolling_sql(n: int) -> str:
    least = min(max(2, n // 4), n)
    f = _frame(n)
    return f""" CASE WHEN count(*) OVER {f} >= {least} THEN avg(return_1) OVER {f} ELSE 0 END AS rolling_return_mean_{n},
 CASE WHEN count(*) OVER {f} >= {least} THEN stddev_pop(abs(price_change)) OVER {f} ELSE 0.01 END AS realized_vol_{n}, avg(spread) OVER {f} AS rolling_spread_mean_{n},
 CASE WHEN count(*) OVER {f} >= {least} THEN stddev_pop(spread) OVER {f} ELSE 0 END AS rolling_spread_std_{n}, avg(order_book_imbalance) OVER {f} AS rolling_obi_mean_{n},
 avg(depth_imbalance) OVER {f} AS rolling_depth_imbalance_mean_{n}, avg(mlofi_sum) OVER {f} AS rolling_mlofi_sum_mean_{n}"""


CHANGE_CTE = f"""ch AS (SELECT *, list_sum(mlofi) AS mlofi_sum, coalesce(mid_price - lag(mid_price) OVER ({BY}), 0) AS price_change, coalesce(mid_price / lag(mid_price) OVER ({BY}) - 1, 0) AS return_1 FROM ofi)"""
ROLL_NAMES = ["rolling_return_mean", "realized_vol", "rolling_spread_mean", "rolling_spread_std", "rolling_obi_mean", "rolling_depth_imbalance_mean", "rolling_mlofi_sum_mean"]
ROLL_COLS = [f"{n}_{k}" for k in (5, 20) for n in ROLL_NAMES]


@query(
    "w6_rolling_features",
    f"{V.BOOK}, {TOP_CTE}, {MLOFI_CTE}, {CHANGE_CTE} SELECT {K}, price_change, return_1, price_change / 0.01 AS tick_return_1, {_rolling_sql(5)}, {_rolling_sql(20)} FROM ch",
    "price_change return_1 tick_return_1 " + " ".join(ROLL_COLS),
)
def rolling_features(spark, sf_dir):
    rows = S.price_change(S.with_mlofi(S.top_of_book(V.book(spark, sf_dir))), 0.01)
    rows = rows.select(*KEY, "price_change", "return_1", "tick_return_1", "spread", "order_book_imbalance", "depth_imbalance", "mlofi_sum")  # no level arrays
    return S.rolling(rows, 0.01, (5, 20)).select(*KEY, "price_change", "return_1", "tick_return_1", *ROLL_COLS)


@query(
    "w7_past_stats",
    f"""{V.BOOK}, {TOP_CTE} SELECT {K}, avg(spread) OVER p AS spread_mean, stddev_samp(spread) OVER p AS spread_std, avg(depth_imbalance) OVER p AS depth_imbalance_mean, stddev_samp(depth_imbalance) OVER p AS depth_imbalance_std
FROM top WINDOW p AS ({BY} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)""",
    "spread_mean spread_std depth_imbalance_mean depth_imbalance_std",
)
def past_stats(spark, sf_dir):
    cols = ["spread", "depth_imbalance"]
    return S.past_stats(S.top_of_book(V.book(spark, sf_dir)), cols).select(*KEY, *[f"{c}_{s}" for c in cols for s in ("mean", "std")])


@query(
    "w8_change_triple",
    f"""{V.BOOK}, {TOP_CTE} SELECT {K}, coalesce(depth_imbalance - lag(depth_imbalance) OVER ({BY}), 0) AS depth_imbalance_diff,
 CASE WHEN stddev_samp(depth_imbalance) OVER f IS NULL THEN 0 ELSE (depth_imbalance - avg(depth_imbalance) OVER f) / (CASE WHEN stddev_samp(depth_imbalance) OVER f = 0 THEN 1e-9 ELSE stddev_samp(depth_imbalance) OVER f END) END AS depth_imbalance_zscore,
 avg(depth_imbalance) OVER f AS depth_imbalance_rmean FROM top WINDOW f AS {_frame(20)}""",
    "depth_imbalance_diff depth_imbalance_zscore depth_imbalance_rmean",
)
def change_triple(spark, sf_dir):
    rows = S.change_triple(S.top_of_book(V.book(spark, sf_dir)), ["depth_imbalance"])
    return rows.select(*KEY, "depth_imbalance_diff", "depth_imbalance_zscore", "depth_imbalance_rmean")


BOOKALL = f"""allbook AS (SELECT symbol, ts_event, sequence, action, list_transform(range(0, 10), lambda i: ((sequence * 7 + i * 13) % 50 + 1)::DOUBLE) AS bid_sz,
  list_transform(range(0, 10), lambda i: ((sequence * 11 + i * 17) % 50 + 1)::DOUBLE) AS ask_sz FROM ticks)"""


@query(
    "w28_spoofing",
    f"""{V.TICKS}, {BOOKALL}, a AS (SELECT *, list_sum(bid_sz[1:3]) AS tb, list_sum(ask_sz[1:3]) AS ta, (bid_sz[1] + ask_sz[1]) / 2 AS l0 FROM allbook),
b AS (SELECT *, coalesce(avg(l0) OVER ({BY} ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING), l0) AS usual,
  greatest(coalesce(lag(tb) OVER ({BY}), tb) - tb, coalesce(lag(ta) OVER ({BY}), ta) - ta, 0) AS drp FROM a),
c AS (SELECT *, (action = 'C' AND drp > usual * 1.5)::INT AS spoof FROM b)
SELECT {K}, least(sum(spoof) OVER f::DOUBLE / greatest(sum((action = 'T')::INT) OVER f, 1), 1) AS spoofing_ratio, avg(CASE WHEN spoof = 1 THEN drp / usual ELSE 0 END) OVER f AS spoofing_duration
FROM c WINDOW f AS {_frame(50)}""",
    "spoofing_ratio spoofing_duration",
)
def spoofing(spark, sf_dir):
    i = F.sequence(F.lit(0), F.lit(9))
    rows = V.ticks(spark, sf_dir).select(
        *KEY,
        "action",
        F.transform(i, lambda k: ((F.col("sequence") * 7 + k * 13) % 50 + 1).cast("double")).alias("bid_sz"),
        F.transform(i, lambda k: ((F.col("sequence") * 11 + k * 17) % 50 + 1).cast("double")).alias("ask_sz"),
    )
    return S.spoofing(rows).select(*KEY, "spoofing_ratio", "spoofing_duration")


@query(
    "f13_f14_clock_features",
    f"""{V.TICKS}, c AS (SELECT *, hour(ts_event) * 60 + minute(ts_event) AS mi FROM ticks)
SELECT {K}, hour(ts_event) AS hour, minute(ts_event) AS minute, second(ts_event) AS second, isodow(ts_event) - 1 AS day_of_week, mi AS minute_of_day, sin(2 * pi() * mi / 1440) AS hour_sin, cos(2 * pi() * mi / 1440) AS hour_cos,
 (mi >= 480 AND mi < 780)::BIGINT AS london_active, (mi >= 780 AND mi < 1260)::BIGINT AS ny_active, (mi >= 780 AND mi < 960)::BIGINT AS overlap_active FROM c""",
    "hour_sin hour_cos",
)
def clock_features(spark, sf_dir):
    names = "hour minute second day_of_week minute_of_day hour_sin hour_cos london_active ny_active overlap_active"
    return S.clock_features(V.ticks(spark, sf_dir)).select(*KEY, *names.split())


@query(
    "f13_f14_session_flags",
    f"""{V.TICKS}, h AS (SELECT *, hour(ts_event) AS h, minute(ts_event) AS m FROM ticks)
SELECT {K}, (h < 8)::BIGINT AS session_asia, (h >= 7 AND h < 16)::BIGINT AS session_london, (h >= 13 AND h < 22)::BIGINT AS session_ny, (h >= 13 AND h < 16)::BIGINT AS session_overlap, (h >= 22)::BIGINT AS session_off,
 CASE WHEN h >= 13 AND h < 16 THEN 3 WHEN h >= 13 AND h < 22 THEN 2 WHEN h >= 7 AND h < 16 THEN 1 WHEN h < 8 THEN 0 ELSE 4 END::BIGINT AS session_label, sin(2 * pi() * h / 24) AS hour_sin, cos(2 * pi() * h / 24) AS hour_cos, sin(2 * pi() * m / 60) AS minute_sin, cos(2 * pi() * m / 60) AS minute_cos FROM h""",
    "hour_sin hour_cos minute_sin minute_cos",
)
def session_flags(spark, sf_dir):
    names = "session_asia session_london session_ny session_overlap session_off session_label hour_sin hour_cos minute_sin minute_cos"
    return S.session_flags(V.ticks(spark, sf_dir)).select(*KEY, *names.split())


COMPAT = "cvd obi micro_price lob_depth_imbalance micro_atr volume_burst liquidity_density vnet cvd_momentum cvd_price_divergence trend_strength liquidity_sweep kyle_lambda hawkes_intensity liq_score"


@query(
    "f28_p25_compat_features",
    f"""{V.BOOK}, {ALIGNED_CTE.format(src='book')}, {TOP_CTE.replace('FROM book', 'FROM aligned')}, {MLOFI_CTE}, {CHANGE_CTE},
v AS (SELECT *, mbo_cvd - coalesce(lag(mbo_cvd) OVER w, 0) AS vn, mbo_cum_trade_count - coalesce(lag(mbo_cum_trade_count) OVER w, 0) AS tc,
  CASE WHEN count(*) OVER {_frame(50)} >= 12 THEN stddev_pop(abs(price_change)) OVER {_frame(50)} ELSE 0.01 END AS rv,
  CASE WHEN count(*) OVER {_frame(20)} >= 5 THEN stddev_pop(abs(price_change)) OVER {_frame(20)} ELSE 0.01 END AS rv20,
  CASE WHEN count(*) OVER {_frame(20)} >= 5 THEN avg(return_1) OVER {_frame(20)} ELSE 0 END AS rm20 FROM ch WINDOW w AS ({BY}))
SELECT {K}, mbo_cvd AS cvd, order_book_imbalance AS obi, microprice AS micro_price, depth_imbalance AS lob_depth_imbalance, rv AS micro_atr, tc::DOUBLE AS volume_burst,
 (bid_depth + ask_depth) / greatest(spread / 0.01, 1) AS liquidity_density, vn AS vnet, mbo_cvd - first_value(mbo_cvd) OVER ({BY} ROWS 20 PRECEDING) AS cvd_momentum,
 coalesce(mbo_cvd - lag(mbo_cvd) OVER ({BY}), 0) * sign(price_change) AS cvd_price_divergence, rm20 / greatest(rv20, 0.01) AS trend_strength,
 abs(mlofi[1] + mlofi[2] + mlofi[3]) / greatest(bid_depth + ask_depth, 1) AS liquidity_sweep, abs(price_change) / greatest(abs(vn), 1) AS kyle_lambda,
 (sum(tc) OVER {_frame(20)})::DOUBLE AS hawkes_intensity, 1.0 / greatest(spread, 0.01) AS liq_score, 0.0::DOUBLE AS fisher_signal, mbo_cvd AS raw__cvd FROM v""",
    COMPAT + " fisher_signal raw__cvd",
    digits=7,
)
def compat_features(spark, sf_dir):
    rows = J.align_flow(V.book(spark, sf_dir), J.flow_state(V.ticks(spark, sf_dir)))
    rows = S.interval_flow(S.price_change(S.with_mlofi(S.top_of_book(rows)), 0.01))
    rows = S.raw_twins(S.compat_features(S.rolling(rows, 0.01, (20, 50)), 0.01), ["cvd"])
    return rows.select(*KEY, *COMPAT.split(), "fisher_signal", "raw__cvd")


@query(
    "f19_f34_walk_fill",
    f"""{V.BOOK}, q AS (SELECT *, (sequence % 90 + 1)::DOUBLE AS qty FROM book),
l AS (SELECT symbol, ts_event, sequence, qty, u.i AS i, ask_px[u.i] AS px, ask_sz[u.i] AS sz, (bid_px[1] + ask_px[1]) / 2 AS mid,
  coalesce(list_sum(ask_sz[1:u.i - 1]), 0) AS before FROM q, (SELECT unnest(range(1, 11)) AS i) u),
f AS (SELECT symbol, ts_event, sequence, qty, mid, greatest(least(qty - before, sz), 0) AS used, px FROM l)
SELECT symbol, ts_event, sequence, qty, sum(used) AS filled, sum(used * px) / sum(used) AS vwap, (sum(used * px) / sum(used) - any_value(mid)) / 0.01 AS slippage_ticks,
  5.0 - 2 * ((sum(used * px) / sum(used) - any_value(mid)) / 0.01) - 2 * 0.5 * qty AS net_pnl_ticks FROM f GROUP BY symbol, ts_event, sequence, qty""",
    "qty filled vwap slippage_ticks net_pnl_ticks",
    digits=7,
)
def walk_fill(spark, sf_dir):
    rows = V.book(spark, sf_dir).withColumn("qty", (F.col("sequence") % 90 + 1).cast("double"))
    rows = rows.withColumns({"_fill": B.walk_fill("ask_px", "ask_sz", F.col("qty")), "_mid": B.mid()})
    rows = rows.withColumn("slippage_ticks", (F.col("_fill.vwap") - F.col("_mid")) / 0.01)
    # Profit of 5 ticks, less slippage and a commission of half a tick per lot, both ways.
    net = 5.0 - 2 * F.col("slippage_ticks") - 2 * 0.5 * F.col("qty")
    return rows.select(*KEY, "qty", F.col("_fill.filled").alias("filled"), F.col("_fill.vwap").alias("vwap"), "slippage_ticks", net.alias("net_pnl_ticks"))
