"""Queries over sources, sinks, regimes, tensors and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.market import is_trade
from tapeloom.operators import audit as A
from tapeloom.operators import bars as O
from tapeloom.operators import clean as C
from tapeloom.operators import learn as ML
from tapeloom.operators import policy as P
from tapeloom.operators import regimes as G
from tapeloom.operators import snapshots as S
from tapeloom.operators import stateful as SF
from tapeloom.operators import tensors as N
from tapeloom.operators import tickwin as W
from tapeloom.plans import eval_queries as E
from tapeloom.plans import views as V
from tapeloom.plans.bar_queries import CVD_CTE, TRADE_BARS_CTE
from tapeloom.plans.registry import ORACLES, query
from tapeloom.plans.tick_queries import cvd_ticks
from tapeloom.runtime import frozen, shared_path
from tapeloom.sources import tables as R

KEY = ["symbol", "ts_event", "sequence"]
K = "symbol, ts_event, sequence"
BY = "PARTITION BY symbol ORDER BY ts_event, sequence"
TICK_SQL = f"{V.TICKS} SELECT symbol, ts_event, sequence, action, price, size FROM ticks"


def plain_ticks(spark, sf_dir):
    return V.ticks(spark, sf_dir).select(*KEY, "action", "price", "size")


# ----------------------------------------------------------------------------------- sources
@query("s1_s2_read_existing_columns", "SELECT event_id, user_id, value FROM events", "value")
def read_existing(spark, sf_dir):
    return R.read_table(spark, f"{sf_dir}/events.parquet", ["event_id", "user_id", "value", "not_there"])


@query("s3_read_folder", TICK_SQL, "price")
def read_folder(spark, sf_dir):
    path = shared_path(spark, "folder")
    R.write_shards(plain_ticks(spark, sf_dir), path, 2000)
    return R.read_table(spark, path)


@query(
    "s4_load_feed",
    f"{V.BOOK}, f AS (SELECT symbol, sequence, price, NULL::DOUBLE AS best_bid, 'T' AS kind FROM ticks WHERE action = 'T' UNION ALL SELECT symbol, sequence, NULL, bid_px[1], 'B' FROM book) SELECT * FROM f",
    "price best_bid",
)
def load_feed(spark, sf_dir):
    trades, books = shared_path(spark, "trades"), shared_path(spark, "books")
    R.write_table(V.ticks(spark, sf_dir).filter(is_trade()).select("symbol", "sequence", "price", F.lit("T").alias("kind")), trades)
    R.write_table(V.book(spark, sf_dir).select("symbol", "sequence", F.get("bid_px", 0).alias("best_bid"), F.lit("B").alias("kind")), books)
    return R.load_feed(spark, [trades, books]).select("symbol", "sequence", "price", "best_bid", "kind")


@query("s5_shard_report", f"{V.TICKS} SELECT count(*) AS rows, min(ts_event) AS ts_min, max(ts_event) AS ts_max, true AS within_limit FROM ticks")
def shard_report(spark, sf_dir):
    path = shared_path(spark, "shards")
    R.write_shards(plain_ticks(spark, sf_dir), path, 1500)
    shards = R.shard_report(spark, path)
    return shards.agg(F.sum("rows").alias("rows"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"), (F.max("rows") <= 1500).alias("within_limit"))


@query("s6_date_partitions", f"{V.TICKS} SELECT ts_event::DATE::VARCHAR AS trade_date, count(*) AS rows, sum(size)::BIGINT AS size FROM ticks GROUP BY 1")
def date_partitions(spark, sf_dir):
    path = shared_path(spark, "dates")
    R.write_by_date(plain_ticks(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"))


@query("s7_csv_round_trip", TICK_SQL, "price")
def csv_round_trip(spark, sf_dir):
    path = shared_path(spark, "csv") + ".csv"
    R.write_table(plain_ticks(spark, sf_dir), path)
    return R.typed(R.read_table(spark, path)).withColumn("symbol", F.col("symbol").cast("long"))


@query("s8_s9_artifact", f"{E.PRED} SELECT symbol, ts_event, sequence, price, size, bias_label FROM pred", "price")
def artifact(spark, sf_dir):
    root, rows = shared_path(spark, "artifact"), E.predictions(spark, sf_dir)
    R.write_artifact(root, rows.select(*KEY, "price", "size"), rows.select(*KEY, "bias_label", "label_end_ts"), rows.select(*KEY), {"schema_version": "1"})
    return R.load_artifact(spark, root).select(*KEY, "price", "size", "bias_label")


@query("s9_manifest", f"{V.TICKS} SELECT count(*) AS rows, 5::BIGINT AS features, '1' AS schema_version FROM ticks")
def manifest(spark, sf_dir):
    root, rows = shared_path(spark, "artifact"), E.predictions(spark, sf_dir)
    out = R.write_artifact(root, rows.select(*KEY, "price", "size"), rows.select(*KEY, "bias_label"), rows.select(*KEY), {"schema_version": "1"})
    return out.select("rows", F.size("feature_columns").alias("features"), "schema_version")


@query("s10_feed_types", "SELECT 'ticks' AS feed, 'MBO' AS kind, '' AS missing, true AS passed UNION ALL SELECT 'events', 'UNKNOWN', 'ts_event,action,side,price,size', false")
def feed_types(spark, sf_dir):
    return R.schema_report({"ticks": V.ticks(spark, sf_dir), "events": V.events(spark, sf_dir)}, spark)


@query("s11_event_log", "SELECT ts, event_type, value AS latency_ms FROM events WHERE event_id % 10 <> 3", "latency_ms")
def event_log(spark, sf_dir):
    path = shared_path(spark, "log")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "event_type", F.col("value").alias("latency_ms")))
    V.events(spark, sf_dir).select(F.when(F.col("event_id") % 10 == 3, "{broken").otherwise(line).alias("value")).write.mode("overwrite").text(path)
    return R.read_event_log(spark, path).select("ts", "event_type", "latency_ms")


@query("s12_typed_csv_to_parquet", f"{V.TICKS} SELECT symbol, ts_event, sequence, action, CASE WHEN sequence % 9 <> 0 THEN price END AS price, size FROM ticks", "price")
def typed_csv(spark, sf_dir):
    source, target = shared_path(spark, "raw") + ".csv", shared_path(spark, "typed")
    rows = plain_ticks(spark, sf_dir).withColumn("price", F.when(F.col("sequence") % 9 == 0, "n/a").otherwise(F.col("price").cast("string")))
    R.write_table(rows, source)
    R.write_table(R.typed(R.read_table(spark, source)), target)
    return spark.read.parquet(target).withColumn("symbol", F.col("symbol").cast("long"))


@query("s13_report", f"{V.TICKS} SELECT action, count(*) AS rows FROM ticks GROUP BY action")
def report(spark, sf_dir):
    path = shared_path(spark, "report")
    R.write_report(A.top_counts(V.ticks(spark, sf_dir), "action", 10), path)
    return spark.read.json(path)


# ----------------------------------------------------------------------------------- context
SESS = "CASE WHEN hour(ts_event) < 8 THEN 'asia' WHEN hour(ts_event) < 16 THEN 'london' ELSE 'ny' END"


@query(
    "a21_session_liquidity",
    f"""{V.TICKS}, s AS (SELECT ts_event::DATE::VARCHAR AS trade_date, {SESS} AS session, count(*) AS rows, avg(size / 50.0) * avg(abs(price - 1050)) * (avg(abs((sequence % 21 - 10) / 10.0)) + 0.01) AS score FROM ticks GROUP BY 1, 2)
SELECT trade_date, session, rows, score, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, session) = 1 AS is_best FROM s WHERE rows >= 50""",
    "score",
)
def session_liquidity(spark, sf_dir):
    h, s = F.hour("ts_event"), F.col("sequence")
    rows = V.ticks(spark, sf_dir).withColumns(
        {"trade_date": F.to_date("ts_event"), "session": F.when(h < 8, "asia").when(h < 16, "london").otherwise("ny"), "volume_burst": F.col("size") / 50.0, "absorption_intensity": F.col("price") - 1050, "obi": (s % 21 - 10) / 10.0}
    )
    return O.session_liquidity(rows, keys=["trade_date"], least=50)


@query(
    "t14_replay_slice",
    f"""{V.TICKS}, m AS (SELECT *, abs(price - lag(price) OVER ({BY})) AS mv FROM ticks), a AS (SELECT *, CASE WHEN count(mv) OVER f >= 5 THEN avg(mv) OVER f ELSE 0 END AS micro_atr FROM m WINDOW f AS ({BY} ROWS 19 PRECEDING))
SELECT {K}, micro_atr FROM a WHERE ts_event BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""",
    "micro_atr",
)
def replay_slice(spark, sf_dir):
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = C.context_slice(V.ticks(spark, sf_dir), stamp("2024-01-10"), stamp("2024-01-20"), warmup=20, tail=0)
    return W.micro_atr(rows, 20).filter("in_range").select(*KEY, "micro_atr")


@query(
    "a10_partial_bars",
    f"""{V.TICKS} SELECT symbol, date_trunc('day', ts_event) AS bar_ts, first(price ORDER BY ts_event, sequence) AS open, last(price ORDER BY ts_event, sequence) AS close, max(price) AS high, min(price) AS low, avg(price) AS mean_price, sum(size)::BIGINT AS size FROM ticks GROUP BY ALL""",
    "open close high low mean_price",
)
def partial_bars(spark, sf_dir):
    return O.merge_partials(O.partial_bars(V.ticks(spark, sf_dir), "1 hour"), "1 day")


# ----------------------------------------------------------------------------------- regimes


def regime_rows(spark, sf_dir):
    rows = W.regime_features(cvd_ticks(spark, sf_dir), 5, 5)
    return rows.withColumns({"volatility": F.abs(F.col("price") - 1040) / 100, "imbalance": (F.col("sequence") % 11) / 10.0})


def _regime_sql() -> str:
    from tapeloom.plans.tick_queries import CVD, last

    feats = ["volatility", "activity", "volume_ratio", "cvd_impulse", "cvd_persistence", "trend_efficiency", "imbalance"]
    probs = [0.10, 0.25, 0.30, 0.45, 0.50, 0.75, 0.90]
    base = f"""{CVD}, s AS (SELECT *, least(size / greatest(coalesce(avg(size) OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 1), 1e-8), 5) AS volume_ratio, coalesce(abs(cvd - lag(cvd) OVER ({BY})), 0) AS stp,
  abs(lag(cvd, 1) OVER ({BY}) - lag(cvd, 6) OVER ({BY})) AS far, abs(price - lag(price) OVER ({BY})) AS mv, (epoch_us(ts_event) - lag(epoch_us(ts_event)) OVER ({BY})) / 1e6 AS gap, abs(price - lag(price, 5) OVER ({BY})) AS net FROM cvd_ticks),
q AS (SELECT *, quantile_cont(gap, 0.5) OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS base, CASE WHEN count(mv) OVER {last(5)} >= 2 THEN sum(mv) OVER {last(5)} END AS gross,
  coalesce(avg(stp) OVER ({BY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS cvd_impulse, coalesce(avg(far) OVER {last(5)}, 0) AS cvd_persistence FROM s),
ft AS (SELECT {K}, volume_ratio, cvd_impulse, cvd_persistence, CASE WHEN base IS NULL OR gap IS NULL THEN volume_ratio ELSE least(base / greatest(gap, 1e-6), 5) END AS activity, CASE WHEN net IS NULL OR gross IS NULL THEN 0 ELSE least(net / greatest(gross, 1e-8), 1) END AS trend_efficiency, abs(price - 1040) / 100 AS volatility, (sequence % 11) / 10.0::DOUBLE AS imbalance FROM q),
qs AS (SELECT {', '.join(f'quantile_cont({f}, {p}) AS {f}_{int(p * 100)}' for f in feats for p in probs)} FROM ft)"""

    def place(f: str, lo: int = 25, hi: int = 90) -> str:
        return f"greatest(least(({f} - {f}_{lo}) / greatest(CASE WHEN {f}_{hi} <= {f}_{lo} THEN 1e-6 ELSE {f}_{hi} - {f}_{lo} END, 1e-6), 1), 0)"

    scores = f"""sc AS (SELECT ft.*, 0.5 * {place('volatility')} + 0.2 * {place('activity')} + 0.15 * {place('volume_ratio')} + 0.1 * {place('cvd_impulse')} + 0.05 * {place('imbalance')} AS vs,
 0.55 * {place('trend_efficiency', 10, 75)} + 0.25 * {place('cvd_persistence')} + 0.1 * {place('activity')} + 0.1 * {place('imbalance')} AS ts, 0.55 * (1 - {place('activity')}) + 0.25 * (1 - {place('volume_ratio')}) + 0.2 * (1 - {place('cvd_impulse')}) AS ls FROM ft, qs)"""
    return f"{base}, {scores}"


REGIME_SQL = _regime_sql()


@query("f36_regime_scores", f"{REGIME_SQL} SELECT {K}, vs AS volatile_score, ts AS trend_score, ls AS low_liquidity_score FROM sc", "volatile_score trend_score low_liquidity_score")
def regime_scores(spark, sf_dir):
    rows = frozen(regime_rows(spark, sf_dir).select(*KEY, *G.FEATURES))
    fitted = G.fit(rows)
    return G.scores(rows, fitted.select(*[c for c in fitted.columns if c.startswith("_q_")])).select(*KEY, "volatile_score", "trend_score", "low_liquidity_score")


@query(
    "e22_rule_regimes",
    f"""{REGIME_SQL}, tp AS (SELECT quantile_cont(ts, 0.55) AS tt, quantile_cont(ls, 0.80) AS lt, quantile_cont(vs, 0.82) AS vt FROM sc),
fl AS (SELECT *, (vs >= vt AND (activity >= greatest(activity_50, 1e-6) OR volume_ratio >= greatest(volume_ratio_50, 1e-6) OR cvd_impulse >= greatest(cvd_impulse_45, 1e-6))) OR volatility >= greatest(volatility_90, 1e-6) AS vo,
  ts >= tt AND (trend_efficiency >= greatest(trend_efficiency_45, 0.25))::INT + (cvd_persistence >= greatest(cvd_persistence_45, 1e-6) * 0.95)::INT + (activity > greatest(activity_30, 1e-6))::INT + (volume_ratio > greatest(volume_ratio_30, 1e-6))::INT >= 2 AS tr,
  ls >= lt AND activity <= greatest(activity_50, 1e-6) AND volume_ratio <= greatest(volume_ratio_50, 1e-6) AND volatility <= greatest(volatility_75, 1e-6) AND cvd_impulse <= greatest(cvd_impulse_45, 1e-6) AS lo FROM sc, qs, tp),
rg AS (SELECT *, CASE WHEN lo THEN 3 WHEN tr THEN 0 WHEN vo THEN 2 ELSE 1 END AS regime, greatest(least(1 - greatest(ts, vs, ls), 1), 0) AS cs FROM fl),
pr AS (SELECT *, [ts * 0.55 + 0.001 + CASE WHEN regime = 0 THEN 0.45 ELSE 0 END, cs * 0.55 + 0.001 + CASE WHEN regime = 1 THEN 0.45 ELSE 0 END, vs * 0.55 + 0.001 + CASE WHEN regime = 2 THEN 0.45 ELSE 0 END, ls * 0.55 + 0.001 + CASE WHEN regime = 3 THEN 0.45 ELSE 0 END] AS p FROM rg)
SELECT {K}, regime::BIGINT AS regime, p[1] / list_sum(p) AS p_trending, p[2] / list_sum(p) AS p_ranging, p[3] / list_sum(p) AS p_volatile, p[4] / list_sum(p) AS p_quiet FROM pr""",
    "p_trending p_ranging p_volatile p_quiet",
)
def rule_regimes(spark, sf_dir):
    rows = frozen(regime_rows(spark, sf_dir).select(*KEY, *G.FEATURES))  # the fit reads the features twice, the prediction once more
    out = G.predict(rows, frozen(G.fit(rows)))
    return out.select(*KEY, "regime", *[F.get("regime_probs", i).alias(f"p_{n}") for i, n in enumerate(("trending", "ranging", "volatile", "quiet"))])


SHAPE_SQL = f"""{V.TICKS}, s AS (SELECT *, coalesce(price - lag(price) OVER ({BY}), 0) AS d FROM ticks), md AS (SELECT quantile_cont(size, 0.5) AS m FROM ticks),
q AS (SELECT *, count(*) OVER f AS n, coalesce(stddev_samp(d) OVER f, 0) AS sd, avg(abs(d)) OVER f AS l1, avg(size) OVER f AS vol FROM s WINDOW f AS ({BY} ROWS 14 PRECEDING)),
x AS (SELECT {K}, CASE WHEN n >= 3 THEN sd ELSE 0 END AS sd, CASE WHEN n >= 2 THEN l1 ELSE 0 END / greatest(CASE WHEN n >= 3 THEN sd ELSE 0 END, 1e-10) AS tr, vol / greatest(m, 1e-10) AS lq FROM q, md),
l AS (SELECT quantile_cont(sd, 0.70) FILTER (sd > 0) AS hs, (SELECT quantile_cont(tr, 0.5) FROM x WHERE tr > 0) AS ht, quantile_cont(lq, 0.10) AS ql FROM x)"""


@query("e23_shape_regimes", f"{SHAPE_SQL} SELECT {K}, CASE WHEN tr > ht AND sd <= hs THEN 0 WHEN sd > hs THEN 2 WHEN lq < ql THEN 3 ELSE 1 END::BIGINT AS regime FROM x, l")
def shape_regimes(spark, sf_dir):
    rows = W.shape_features(V.ticks(spark, sf_dir), 15)
    return G.predict_shape(rows, G.fit_shape(rows)).select(*KEY, "regime")


@query("e24_rolling_summary", f"{V.TICKS} SELECT {K}, avg(price) OVER f AS price_mean, stddev_pop(price) OVER f + 1e-8 AS price_std, min(price) OVER f AS price_min, max(price) OVER f AS price_max FROM ticks WINDOW f AS ({BY} ROWS 19 PRECEDING)", "price_mean price_std price_min price_max")
def rolling_summary(spark, sf_dir):
    return N.rolling_summary(V.ticks(spark, sf_dir), ["price"]).select(*KEY, "price_mean", "price_std", "price_min", "price_max")


# ----------------------------------------------------------------------------------- tensors
DAY = "1 day"
TENSOR_SQL = f"""{V.BOOK}, {TRADE_BARS_CTE.format(unit='day')}, pk AS (SELECT symbol, date_trunc('day', ts_event) AS bar_ts, first({{'b': bid_px[1], 'a': ask_px[1], 'bs': bid_sz, 'az': ask_sz}} ORDER BY abs((list_sum(bid_sz) - list_sum(ask_sz)) / (list_sum(bid_sz) + list_sum(ask_sz) + 1e-9)) DESC, ts_event, sequence) AS s FROM book GROUP BY 1, 2),
us AS (SELECT quantile_cont(size, 0.5) AS u FROM ticks WHERE size <> 0), fp AS (SELECT t.symbol, pk.bar_ts, side, least(round_even(CASE WHEN side = 'A' THEN abs((price - s.a) / (s.a - s.b)) ELSE abs((s.b - price) / (s.a - s.b)) END, 0), 9)::INT AS lv, size / u AS z
  FROM ticks t JOIN pk ON pk.symbol = t.symbol AND pk.bar_ts = date_trunc('day', t.ts_event), us WHERE action = 'T'),
fs AS (SELECT symbol, bar_ts, sum(z) FILTER (side = 'A') AS bt, sum(z) FILTER (side = 'B') AS st, sum(z) FILTER (side = 'A' AND lv = 0) AS b0, sum(z) FILTER (side = 'A' AND lv = 9) AS b9 FROM fp GROUP BY ALL)"""


@query("w46_trade_footprint", f"{TENSOR_SQL} SELECT symbol, bar_ts, coalesce(bt, 0) AS buy_total, coalesce(st, 0) AS sell_total, coalesce(b0, 0) AS buy_first, coalesce(b9, 0) AS buy_last FROM fs", "buy_total sell_total buy_first buy_last")
def trade_footprint(spark, sf_dir):
    out = N.footprint(V.ticks(spark, sf_dir), N.bar_snapshots(V.book(spark, sf_dir), DAY), DAY)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return out.select("symbol", "bar_ts", total("buy_footprint").alias("buy_total"), total("sell_footprint").alias("sell_total"), F.get("buy_footprint", 0).alias("buy_first"), F.get("buy_footprint", 9).alias("buy_last"))


def tensor_view(tensors):
    """Numbers that describe a tensor, for comparison."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return tensors.select("symbol", "bar_ts", "coverage", F.size("tensor").alias("steps"), total(F.flatten("tensor")).alias("total"), total(F.try_element_at("tensor", F.lit(-1))).alias("newest"))


@query(
    "w45_book_tensors",
    f"""{TENSOR_SQL}, v AS (SELECT b.symbol, b.bar_ts, pk.s IS NOT NULL AS have, list_sum(list_transform(pk.s.bs, lambda x: ln(1 + x))) + list_sum(list_transform(pk.s.az, lambda x: ln(1 + x))) + coalesce(bt, 0) + coalesce(st, 0) AS t
  FROM trade_bars b LEFT JOIN pk USING (symbol, bar_ts) LEFT JOIN fs USING (symbol, bar_ts))
SELECT symbol, bar_ts, sum(have::INT) OVER w / 5.0 AS coverage, 5::BIGINT AS steps, coalesce(sum(t) OVER w, 0) AS total, coalesce(t, 0) AS newest FROM v WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS 4 PRECEDING)""",
    "coverage total newest",
)
def book_tensors(spark, sf_dir):
    bars = O.trade_bars(V.ticks(spark, sf_dir), DAY)
    return tensor_view(N.book_tensors(bars, V.ticks(spark, sf_dir), V.book(spark, sf_dir), DAY, 5))


FLOW_SQL = f"""{V.TICKS}, {TRADE_BARS_CTE.format(unit='day')}, us AS (SELECT quantile_cont(size, 0.5) AS u FROM ticks), g AS (SELECT symbol, date_trunc('day', ts_event) AS bar_ts, sum(CASE WHEN side = 'A' THEN size ELSE 0 END)::DOUBLE AS b, sum(CASE WHEN side = 'B' THEN size ELSE 0 END)::DOUBLE AS s,
  sum(CASE WHEN side = 'A' AND action = 'T' THEN size ELSE 0 END)::DOUBLE AS bt, sum(CASE WHEN side = 'B' AND action = 'T' THEN size ELSE 0 END)::DOUBLE AS st FROM ticks GROUP BY ALL),
v AS (SELECT t.symbol, t.bar_ts, (b - s) / greatest(b + s, 1) AS c0, bt / u AS c1, st / u AS c2 FROM trade_bars t JOIN g USING (symbol, bar_ts), us)"""


@query("w51_flow_tensors", f"{FLOW_SQL} SELECT symbol, bar_ts, count(*) OVER w / 5.0 AS coverage, 5::BIGINT AS steps, sum(c0 + c1 + c2) OVER w AS total, c0 + c1 + c2 AS newest FROM v WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS 4 PRECEDING)", "coverage total newest")
def flow_tensors(spark, sf_dir):
    return tensor_view(N.flow_tensors(O.trade_bars(V.ticks(spark, sf_dir), DAY), V.ticks(spark, sf_dir), DAY, 5))


@query(
    "w52_normalised_tensors",
    f"""{FLOW_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS n FROM v), x AS (SELECT a.symbol, a.bar_ts, b.c0, b.c1, b.c2, a.n = b.n AS nw FROM n a JOIN n b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 4 AND a.n),
m AS (SELECT {', '.join(f'avg(c{i}) FILTER (abs(c{i}) > 1e-12) AS m{i}, stddev_pop(c{i}) FILTER (abs(c{i}) > 1e-12) AS d{i}' for i in range(3))} FROM x)
SELECT symbol, bar_ts, (c0 - m0) / d0 AS newest_0, (c1 - m1) / d1 AS newest_1, (c2 - m2) / d2 AS newest_2 FROM x, m WHERE nw""",
    "newest_0 newest_1 newest_2",
)
def normalised_tensors(spark, sf_dir):
    flows = N.flow_tensors(O.trade_bars(V.ticks(spark, sf_dir), DAY), V.ticks(spark, sf_dir), DAY, 5)
    out = N.normalise_channels(flows, 3)
    newest = F.try_element_at("tensor", F.lit(-1))
    return out.select("symbol", "bar_ts", *[F.get(newest, i).alias(f"newest_{i}") for i in range(3)])


@query(
    "w49_sequences",
    f"""{V.TICKS}, s AS (SELECT *, ts_event < TIMESTAMP '2024-01-20' AS tr, sequence % 10 <> 0 AS cv FROM ticks), g AS (SELECT *, count(*) OVER f AS n, min(tr::INT) OVER f = max(tr::INT) OVER f AS same, avg(cv::INT) OVER f AS c, sum(price) OVER f AS ps, sum(size) OVER f AS ss FROM s WINDOW f AS ({BY} ROWS 5 PRECEDING))
SELECT {K}, ps AS price_total, ss::DOUBLE AS size_total FROM g WHERE n = 6 AND same AND cv AND c >= 0.8::DOUBLE""",
    "price_total size_total",
)
def sequences(spark, sf_dir):
    rows = V.ticks(spark, sf_dir).withColumns({"part": F.when(F.col("ts_event") < F.lit("2024-01-20").cast("timestamp_ntz"), "train").otherwise("test"), "covered": F.col("sequence") % 10 != 0})
    out = N.sequences(rows, ["price", "size"], 6, "covered", "part")
    total = lambda i: F.aggregate("sequence_features", F.lit(0.0), lambda a, x: a + F.get(x, i))
    return out.select(*KEY, total(0).alias("price_total"), total(1).alias("size_total"))


@query("w53_past_windows", f"{V.TICKS}, g AS (SELECT *, count(*) OVER f AS n, sum(price) OVER f AS ps FROM ticks WINDOW f AS ({BY} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT {K}, ps AS price_total FROM g WHERE n = 8 AND size > 80", "price_total")
def past_windows(spark, sf_dir):
    out = N.past_windows(V.ticks(spark, sf_dir).withColumn("event", F.col("size") > 80), ["price"], 8, "event")
    return out.select(*KEY, F.aggregate("window", F.lit(0.0), lambda a, x: a + F.get(x, 0)).alias("price_total"))


@query(
    "w54_book_scan_features",
    f"""SELECT a.symbol, a.ts_event, a.sequence, a.bid_wall_strength, a.ask_wall_strength, a.distance_to_wall, a.gap_size, d.liquidity_density FROM ({ORACLES['f9_f10_walls_and_gaps']}) a
JOIN ({ORACLES['f7_f8_w50_density_gap_scores']}) d USING (sequence)""",
    "bid_wall_strength ask_wall_strength distance_to_wall gap_size liquidity_density",
)
def book_scan(spark, sf_dir):
    from tapeloom.functions import book as B

    rows = S.wall_features(V.book(spark, sf_dir), 0.008, multiple=1.5).withColumn("liquidity_density", B.density(0.008))
    return rows.select(*KEY, "bid_wall_strength", "ask_wall_strength", "distance_to_wall", "gap_size", "liquidity_density")


# ------------------------------------------------------------------------------------ signals
@query("f35_signal_steps")
def signal_steps(spark, sf_dir):
    rows = E.policy_rows(spark, sf_dir)
    decided = P.decide(rows, P.side_stats(rows, 1.4), P.regime_priors(rows), 1.4)
    wanted = F.when(F.col("bias") == 0, 1).when(F.col("bias") == 1, -1).otherwise(0)
    inputs = decided.select(
        "symbol", "ts_event", "sequence", F.col("price").alias("close"), wanted.alias("signal"), F.greatest("prob_long", "prob_short").alias("confidence"), (F.col("regime") % 2 == 0).alias("trending"),
        F.col("size").cast("double").alias("cvd"), F.col("liquidity_sweep").alias("obi"), F.col("event_score").alias("hawkes"), F.lit(0.0).alias("micro_atr"), "reason",
    )
    from tapeloom.functions.machines import RangeFilter

    ready = SF.range_evidence(inputs, order=["ts_event", "sequence"]).withColumn("price", F.col("close"))
    out = SF.fold(ready, RangeFilter(needed=2, window=6))
    final = F.when(F.col("action") == "ENTER", F.col("action_direction")).otherwise(0)
    blocked = F.when(F.col("signal") == 0, F.col("reason")).when(final == 0, "range_filter").otherwise("passed")
    return out.select("symbol", "sequence", "signal", final.alias("final_signal"), blocked.alias("outcome"))


# ------------------------------------------------------------------------------------- models
def model_split(spark, sf_dir):
    from tapeloom.operators import splits as T

    return T.purged_walk_forward(E.split_input(spark, sf_dir), n_folds=2, test=0.2).withColumns({"size": F.col("size").cast("double")})


@query("m1_out_of_fold")
def out_of_fold(spark, sf_dir):
    return ML.out_of_fold(model_split(spark, sf_dir), ["price", "size"])


@query("m3_fill_uncovered")
def fill_uncovered(spark, sf_dir):
    return ML.fill_uncovered(E.split_input(spark, sf_dir).select("symbol", "sequence"), ML.out_of_fold(model_split(spark, sf_dir), ["price", "size"]))


@query("m2_align_classes", f"{E.PRED} SELECT sequence, prob_short / (prob_short + prob_long) AS p0, 0.0::DOUBLE AS p1, prob_long / (prob_short + prob_long) AS p2 FROM pred", "p0 p1 p2")
def align_classes(spark, sf_dir):
    rows = E.predictions(spark, sf_dir).withColumn("p", ML.align_classes(F.array("prob_short", "prob_long"), [0, 2], 3))
    return rows.select("sequence", *[F.get("p", i).alias(f"p{i}") for i in range(3)])


@query("m4_isotonic_calibration")
def isotonic(spark, sf_dir):
    return ML.isotonic(E.predictions(spark, sf_dir))[0].select(*KEY, "prob_long", "prob_calibrated")


@query(
    "m5_temperature",
    f"""{E.PRED}, g AS (SELECT round(0.5 + 0.05 * i, 2)::DOUBLE AS t FROM (SELECT unnest(range(0, 51)) AS i)), s AS (SELECT t, bias_label = 0 AS y, 1 / (1 + exp(-(ln(prob_long) - ln(1 - prob_long)) / t)) AS p FROM pred, g WHERE bias_label < 2),
l AS (SELECT t, avg(-ln(greatest(CASE WHEN y THEN p ELSE 1 - p END, 1e-15))) AS nll, count(*) AS n FROM s GROUP BY t) SELECT arg_min(t, (nll, t)) AS temperature, max(nll) FILTER (t = 1.0) AS raw_nll, min(nll) AS calibrated_nll, max(n) AS rows FROM l""",
    "temperature raw_nll calibrated_nll",
)
def temperature(spark, sf_dir):
    return ML.temperature(E.predictions(spark, sf_dir))


@query("m6_m7_mixture_regimes")
def mixture(spark, sf_dir):
    rows = regime_rows(spark, sf_dir).select(*KEY, "volatility", "volume_ratio", "cvd_impulse", "imbalance", "activity", "trend_efficiency")
    out = ML.mixture_regimes(rows, ["volatility", "volume_ratio", "cvd_impulse", "imbalance", "activity", "trend_efficiency"], max_iter=10)
    return out.select(*KEY, "cluster", "regime")


@query("e26_model_sanity")
def model_sanity(spark, sf_dir):
    return ML.sanity(model_split(spark, sf_dir), {"price": ["price"], "price_size": ["price", "size"]})


# ------------------------------------------------------------------------------------ dataset
def labelled_rows(spark, sf_dir):
    from tapeloom.operators.labels import BarrierRule
    from tapeloom.plans import dataset

    return dataset.labelled(V.ticks(spark, sf_dir), V.book(spark, sf_dir), BarrierRule(horizon=12, tick=0.01), (20, 50))


DATASET_COLS = "cvd obi micro_atr trend_strength kyle_lambda"


@query(
    "dataset_rows",
    f"""SELECT a.symbol, a.ts_event, a.sequence, {', '.join('a.' + c for c in DATASET_COLS.split())}, a.micro_atr > 0 AS has_volatility FROM ({ORACLES['f28_p25_compat_features']}) a""",
    DATASET_COLS,
    digits=7,
)
def dataset_rows(spark, sf_dir):
    rows = labelled_rows(spark, sf_dir)
    return rows.select(*KEY, *DATASET_COLS.split(), (F.col("micro_atr") > 0).alias("has_volatility"))


@query("dataset_leakage", f"{V.BOOK} SELECT count(*) AS rows, 0::BIGINT AS invalid_label_horizons, 0::BIGINT AS feature_after_start_rows, 0::BIGINT AS forbidden_features, true AS passed FROM book")
def dataset_leakage(spark, sf_dir):
    from tapeloom.operators import splits as T
    from tapeloom.plans import dataset

    rows = labelled_rows(spark, sf_dir).withColumn("feature_ts", F.coalesce("mbo_state_ts", "ts_event"))
    return T.leakage_report(rows, dataset.feature_names(rows)).drop("max_label_end_ts")


def _prepared(spark, sf_dir, **options):
    """Run the preparation; the folder it wrote to, and its error if it refused."""
    from tapeloom.operators.labels import BarrierRule
    from tapeloom.plans import dataset

    root = shared_path(spark, "prepared")
    try:
        dataset.prepare(V.ticks(spark, sf_dir), V.book(spark, sf_dir), BarrierRule(horizon=12, tick=0.01), root, frames=(20, 50), **options)
    except RuntimeError as refused:
        return root, str(refused)
    return root, None


VALID_SQL = f"(SELECT count(*) FROM ({V.TICKS} SELECT * FROM ticks)) AS tick_rows, r.rows AS book_rows, r.rows AS feature_rows, r.matched_rows, r.matched_rows::DOUBLE / r.rows AS match_rate"
VALID_COLS = "tick_rows book_rows feature_rows matched_rows match_rate critical warnings passed".split()


@query("s9_data_validation", f"SELECT {VALID_SQL}, '' AS critical, '' AS warnings, true AS passed FROM ({ORACLES['j3_age_report']}) r", "match_rate")
def data_validation(spark, sf_dir):
    root, _ = _prepared(spark, sf_dir, dry_run=True)
    return spark.read.json(f"{root}/data_validation").select(*VALID_COLS)


@query(
    "s9_prepared_rows",
    f"SELECT a.symbol, a.ts_event, a.sequence, a.cvd, a.obi, a.cvd AS raw__cvd, 1.0::DOUBLE AS soft_sample_weight FROM ({ORACLES['f28_p25_compat_features']}) a",
    "cvd obi raw__cvd soft_sample_weight",
    digits=7,
)
def prepared_rows(spark, sf_dir):
    root, _ = _prepared(spark, sf_dir)
    return R.load_artifact(spark, root).select(*KEY, "cvd", "obi", "raw__cvd", "soft_sample_weight")


@query("s9_refused", f"SELECT {VALID_SQL}, 'max_rows_exceeded' AS critical, '' AS warnings, false AS passed, 'data validation failed: max_rows_exceeded' AS error FROM ({ORACLES['j3_age_report']}) r", "match_rate")
def refused(spark, sf_dir):
    root, error = _prepared(spark, sf_dir, max_rows=10)
    return spark.read.json(f"{root}/data_validation").select(*VALID_COLS, F.lit(error).alias("error"))


@query("s9_symbols_before_filters", f"{V.BOOK} SELECT 'ticks' AS feed, symbol, count(*) AS rows FROM ticks GROUP BY 2 UNION ALL SELECT 'book', symbol, count(*) FROM book GROUP BY 2")
def symbols_before_filters(spark, sf_dir):
    root, _ = _prepared(spark, sf_dir, symbol=-1, dry_run=True)
    return spark.read.json(f"{root}/symbols_before_filters").select("feed", "symbol", "rows")
