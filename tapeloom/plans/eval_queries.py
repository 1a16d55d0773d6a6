"""Queries over splits, scores, feature statistics, policy and monitoring, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import trading as X
from tapeloom.operators import bars as O
from tapeloom.operators import evaluate as E
from tapeloom.operators import monitor as M
from tapeloom.operators import policy as P
from tapeloom.operators import splits as T
from tapeloom.operators.ordered import windowed
from tapeloom.operators.tickwin import micro_atr
from tapeloom.plans import views as V
from tapeloom.plans.bar_queries import ATR, CVD_CTE, TRADE_BARS_CTE
from tapeloom.plans.registry import query

KEY = ["symbol", "ts_event", "sequence"]
K = "symbol, ts_event, sequence"
BY = "PARTITION BY symbol ORDER BY ts_event, sequence"


def predictions(spark, sf_dir):
    """Each tick labelled by the next price of its symbol, with a made-up probability."""

    def ahead(df, w):
        return df.withColumns({"_p": F.lead("price").over(w), "_t": F.lead("ts_event").over(w)})

    rows = windowed(V.ticks(spark, sf_dir), ahead, after=1)
    label = F.when(F.col("_p") > F.col("price"), 0).when(F.col("_p") < F.col("price"), 1).otherwise(2)
    long = ((F.col("sequence") * 37) % 100 + 0.5) / 100
    return rows.withColumns(
        {
            "bias_label": label,
            "label_end_ts": F.coalesce("_t", "ts_event"),
            "label_horizon_steps": F.col("_t").isNotNull().cast("int"),
            "train_event_flag": (F.col("size") > 50).cast("int"),
            "prob_long": long,
            "prob_short": 1 - long,
            "realized_return": F.coalesce(F.col("_p") - F.col("price"), F.lit(0.0)),
        }
    ).drop("_p", "_t")


PRED_CTE = f"""pred AS (SELECT * EXCLUDE (nx, nts), CASE WHEN nx > price THEN 0 WHEN nx < price THEN 1 ELSE 2 END AS bias_label, coalesce(nts, ts_event) AS label_end_ts, (nts IS NOT NULL)::INT AS label_horizon_steps,
  (size > 50)::INT AS train_event_flag, ((sequence * 37) % 100 + 0.5::DOUBLE) / 100 AS prob_long, 1 - ((sequence * 37) % 100 + 0.5::DOUBLE) / 100 AS prob_short, coalesce(nx - price, 0) AS realized_return
  FROM (SELECT *, lead(price) OVER w AS nx, lead(ts_event) OVER w AS nts FROM ticks WINDOW w AS ({BY})))"""
PRED = f"{V.TICKS}, {PRED_CTE}"
ORDERED = f"{PRED}, o AS (SELECT *, row_number() OVER (ORDER BY ts_event, sequence) - 1 AS pos FROM pred), n AS (SELECT count(*)::DOUBLE AS n FROM pred)"


def split_input(spark, sf_dir):
    return predictions(spark, sf_dir).select(*KEY, "label_end_ts", "bias_label", "label_horizon_steps", "price", "size")


# ------------------------------------------------------------------------------------ splits
def roles_sql(folds: str, embargo: int = 0, min_train: int = 100, min_test: int = 1) -> str:
    return f"""{folds}, fs AS (SELECT f.*, o.ts_event AS t0 FROM f JOIN o ON o.pos = f.s),
r AS (SELECT k, {', '.join('o.' + c for c in ('symbol', 'ts_event', 'sequence', 'label_end_ts', 'bias_label', 'price', 'size', 'pos'))},
  CASE WHEN pos >= s AND pos < e THEN 'test' WHEN ts_event < t0 AND label_end_ts < t0 AND pos < s - {embargo} THEN 'train' END AS role FROM o, fs),
g AS (SELECT k, row_number() OVER (ORDER BY k) AS fold FROM (SELECT k FROM r GROUP BY k HAVING sum((role = 'train')::INT) >= {min_train} AND sum((role = 'test')::INT) >= {min_test})),
roles AS (SELECT g.fold, r.* EXCLUDE (k) FROM r JOIN g USING (k) WHERE role IS NOT NULL)"""


T1_FOLDS = "f AS (SELECT k, a + k * z AS s, least(a + (k + 1) * z, n) AS e FROM (SELECT n, greatest(floor(n * 0.5), 100) AS a, greatest(floor(n * 0.1), 20) AS z FROM n), (SELECT unnest(range(0, 5)) AS k) WHERE a + k * z < n AND least(a + (k + 1) * z, n) - (a + k * z) >= 20)"
T1 = f"{ORDERED}, {roles_sql(T1_FOLDS, 50)}"


def purged(spark, sf_dir):
    return T.purged_walk_forward(split_input(spark, sf_dir), embargo_rows=50)


@query("t1_j12_purged_walk_forward", f"{T1} SELECT fold, symbol, sequence, pos, role FROM roles")
def purged_walk_forward(spark, sf_dir):
    return purged(spark, sf_dir).select("fold", "symbol", "sequence", "pos", "role")


T2_FOLDS = """b AS (SELECT n, least(greatest(floor(n * 0.2), 200), greatest(floor(n * 0.1) + 50, n - floor(n * 0.1))) AS a, greatest(1, floor(n * 0.1)) AS z FROM n),
kk AS (SELECT *, greatest(6, ceil((n - a) / z)) AS c FROM b), f AS (SELECT k, a + k * floor((n - a) / c) + least(k, (n - a) % c) AS s, a + (k + 1) * floor((n - a) / c) + least(k + 1, (n - a) % c) AS e FROM kk, unnest(range(0, c::BIGINT)) t(k))"""


@query("t2_t3_expanding_walk_forward", f"{ORDERED}, {roles_sql(T2_FOLDS, 0, 50, 10)} SELECT fold, symbol, sequence, role FROM roles")
def expanding(spark, sf_dir):
    return T.expanding_walk_forward(split_input(spark, sf_dir)).select("fold", "symbol", "sequence", "role")


@query(
    "t4_combinatorial",
    f"""{ORDERED}, og AS (SELECT o.*, least(floor(pos / floor(n / 6)), 5)::BIGINT AS grp FROM o, n), st AS (SELECT grp, min(ts_event) AS t0 FROM og GROUP BY grp),
c AS (SELECT row_number() OVER (ORDER BY a.grp, b.grp) - 1 AS fold, a.grp AS ga, b.grp AS gb, least(a.t0, b.t0) AS t0 FROM st a JOIN st b ON a.grp < b.grp),
r AS (SELECT fold, symbol, sequence, CASE WHEN grp IN (ga, gb) THEN 'test' WHEN label_end_ts < c.t0 THEN 'train' END AS role FROM og, c),
ok AS (SELECT fold FROM r GROUP BY fold HAVING sum((role = 'train')::INT) >= 30 AND sum((role = 'test')::INT) >= 5)
SELECT fold, symbol, sequence, role FROM r JOIN ok USING (fold) WHERE role IS NOT NULL""",
)
def combinatorial(spark, sf_dir):
    return T.combinatorial(split_input(spark, sf_dir)).select("fold", "symbol", "sequence", "role")


@query(
    "t5_walk_forward_windows",
    f"""{ORDERED}, b AS (SELECT n, greatest(floor(n * 0.5), 100) AS a, greatest(floor(n * 0.1), 1) AS z FROM n), f AS (SELECT k + 1 AS fold, a + k * z AS s, least(a + (k + 1) * z, n) AS e FROM b, unnest(range(0, 4)) t(k) WHERE a + k * z < n AND least(a + (k + 1) * z, n) - (a + k * z) > 10)
SELECT fold, 'chronological_expanding' AS mode, (SELECT ts_event FROM o WHERE pos = 0) AS train_start, p.ts_event AS train_end, q.ts_event AS test_start, x.ts_event + INTERVAL 1 MICROSECOND AS test_end, s::BIGINT AS train_rows, (e - s)::BIGINT AS test_rows
FROM f JOIN o p ON p.pos = s - 1 JOIN o q ON q.pos = s JOIN o x ON x.pos = e - 1""",
)
def walk_forward_windows(spark, sf_dir):
    return T.walk_forward_windows(split_input(spark, sf_dir), 4, 0.5, 0.1, 100)


@query(
    "t6_split_plan",
    f"""{PRED}, h AS (SELECT *, (sequence % 30) AS hs FROM pred), q AS (SELECT coalesce(ceil(quantile_cont(hs, 0.95)), 0) AS hr FROM h WHERE bias_label < 2), n AS (SELECT count(*) AS n FROM pred),
z AS (SELECT n, hr, greatest(0, n - least(greatest(floor(n * 0.2), 200), greatest(greatest(1, floor(n * 0.1)) + 50, n - greatest(1, floor(n * 0.1))))) AS tail FROM n, q)
SELECT n AS rows, CASE WHEN n < 300 THEN 0 ELSE greatest(ceil(n * 0.0005), hr) END::BIGINT AS embargo_rows, CASE WHEN n < 300 THEN 0 ELSE greatest(ceil(n * 0.0005), hr) END::DOUBLE / greatest(n, 1) AS embargo_share,
 CASE WHEN n < 300 THEN 1 WHEN tail > 0 THEN greatest(3, least(6, greatest(1, floor(tail / CASE WHEN n >= 3000 THEN 500 ELSE 350 END)))) ELSE 1 END::BIGINT AS folds, n < 300 AS tiny_fallback FROM z""",
    "embargo_share",
)
def split_plan(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("label_horizon_steps", F.col("sequence") % 30)
    return T.split_plan(rows, embargo=0.0005)


@query(
    "t7_inner_split",
    f"""{T1}, tr AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY fold) AS c FROM roles WHERE role = 'train'),
v AS (SELECT *, least(greatest(50, floor(c * 0.15)), c - 50) AS vn FROM tr WHERE c >= 100), w AS (SELECT *, i >= c - vn AS isv FROM v WHERE vn >= 50),
s AS (SELECT *, min(CASE WHEN isv THEN ts_event END) OVER (PARTITION BY fold) AS t0 FROM w)
SELECT fold, symbol, sequence, CASE WHEN isv THEN 'validation' ELSE 'train' END AS role FROM s WHERE isv OR label_end_ts < t0""",
)
def inner_split(spark, sf_dir):
    return T.inner_split(purged(spark, sf_dir)).select("fold", "symbol", "sequence", "role")


@query(
    "t8_fold_report",
    f"""{T1}, x AS (SELECT fold, sum((role = 'train')::INT)::BIGINT AS train_rows, sum((role = 'test')::INT)::BIGINT AS test_rows, max(ts_event) FILTER (role = 'train') AS train_end_ts, max(label_end_ts) FILTER (role = 'train') AS train_max_label_end_ts,
  min(ts_event) FILTER (role = 'test') AS test_start_ts, max(ts_event) FILTER (role = 'test') AS test_end_ts FROM roles GROUP BY fold) SELECT *, train_end_ts < test_start_ts AS chronological, train_max_label_end_ts < test_start_ts AS labels_before_test FROM x""",
)
def fold_report(spark, sf_dir):
    return T.fold_report(purged(spark, sf_dir))


@query(
    "t9_label_violations",
    f"{PRED}, x AS (SELECT count(*) AS rows, sum((label_end_ts < ts_event)::INT)::BIGINT AS invalid_label_horizons, sum((label_end_ts >= TIMESTAMP '2024-01-25')::INT)::BIGINT AS leaking_rows, max(label_end_ts) AS max_label_end_ts FROM pred) SELECT *, invalid_label_horizons = 0 AND leaking_rows = 0 AS passed FROM x",
)
def label_violations(spark, sf_dir):
    return T.label_violations(predictions(spark, sf_dir), F.lit("2024-01-25").cast("timestamp_ntz"))


@query(
    "t10_leakage_report",
    f"{PRED} SELECT count(*) AS rows, sum((label_end_ts < ts_event)::INT)::BIGINT AS invalid_label_horizons, max(label_end_ts) AS max_label_end_ts, 0::BIGINT AS feature_after_start_rows, 1::BIGINT AS forbidden_features, false AS passed FROM pred",
)
def leakage_report(spark, sf_dir):
    return T.leakage_report(predictions(spark, sf_dir).withColumn("feature_ts", F.col("ts_event")), ["raw__price", "raw__forward_return"])


@query("f29_schema_check", f"{PRED} SELECT count(*) AS rows, 'bias_label' AS missing_columns, 'raw__forward_return,raw__future_size' AS forbidden_features, false AS passed FROM pred")
def schema_check(spark, sf_dir):
    return T.schema_check(predictions(spark, sf_dir).drop("bias_label"), ["raw__price", "raw__forward_return", "raw__future_size"])


@query("e35_feature_schema", f"{PRED} SELECT count(*) AS rows, '' AS missing_columns, '' AS forbidden_features, true AS passed FROM pred")
def feature_schema(spark, sf_dir):
    return T.schema_check(predictions(spark, sf_dir), ["price", "size", "prob_long"])


@query("t11_out_of_sample", f"{PRED} SELECT min(ts_event) AS first_ts, 'post_split_window_only' AS reason, true AS allowed FROM pred WHERE ts_event >= TIMESTAMP '2024-01-20'")
def out_of_sample(spark, sf_dir):
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    rows = predictions(spark, sf_dir).filter(F.col("ts_event") >= cut).withColumn("dataset_slice", F.lit("train"))
    return T.out_of_sample(rows, cut, same_dataset=True)


@query("t12_growing_split", f"{ORDERED}, f AS (SELECT i, floor(n / 5) * i AS s, least(floor(n / 5) * (i + 1), n) AS e FROM n, unnest(range(1, 5)) t(i) WHERE floor(n / 5) * i >= floor(n * 0.3)) SELECT i AS fold, symbol, sequence, CASE WHEN pos < s THEN 'train' ELSE 'test' END AS role FROM o, f WHERE pos < e")
def growing_split(spark, sf_dir):
    return T.growing_split(split_input(spark, sf_dir)).select("fold", "symbol", "sequence", "role")


COSTS = """cfg AS (SELECT event_id AS id, (event_id % 3)::DOUBLE - 1 AS round_trip_cost_pips, (event_id % 2)::DOUBLE AS commission_per_side, (event_id % 4) / 2.0::DOUBLE AS min_spread_ticks, (event_id % 5) / 4.0::DOUBLE AS min_slippage_ticks,
  event_id % 2 AS latency_rows, event_id % 7 AS max_size, (event_id % 6) / 100.0::DOUBLE AS tick_size, 10.0::DOUBLE AS tick_value FROM events)"""


@query(
    "t13_cost_check",
    f"""WITH {COSTS}, c AS (SELECT id, concat_ws(',', CASE WHEN tick_size <= 0 THEN 'tick_size_must_be_positive' END, CASE WHEN tick_value <= 0 THEN 'tick_value_must_be_positive' END, CASE WHEN round_trip_cost_pips < 0 OR commission_per_side < 0 OR min_spread_ticks < 0 OR min_slippage_ticks < 0 THEN 'negative_cost_parameter' END, CASE WHEN max_size <= 0 THEN 'max_size_must_be_positive' END) AS errors,
 concat_ws(',', CASE WHEN round_trip_cost_pips <= 0 THEN 'round_trip_cost_pips_is_zero' END, CASE WHEN commission_per_side <= 0 THEN 'commission_per_side_is_zero' END, CASE WHEN min_spread_ticks < 1 THEN 'min_spread_ticks_below_one' END, CASE WHEN min_slippage_ticks < 0.5 THEN 'min_slippage_ticks_below_half_tick' END, CASE WHEN latency_rows <= 0 THEN 'latency_rows_zero_or_negative' END) AS warnings FROM cfg)
SELECT *, errors = '' AS passed FROM c""",
)
def cost_check(spark, sf_dir):
    i = F.col("event_id")
    cfg = V.events(spark, sf_dir).select(
        i.alias("id"), ((i % 3) - 1).cast("double").alias("round_trip_cost_pips"), (i % 2).cast("double").alias("commission_per_side"), ((i % 4) / 2.0).alias("min_spread_ticks"), ((i % 5) / 4.0).alias("min_slippage_ticks"),
        (i % 2).alias("latency_rows"), (i % 7).alias("max_size"), ((i % 6) / 100.0).alias("tick_size"), F.lit(10.0).alias("tick_value"),
    )
    return T.cost_check(cfg).select("id", "errors", "warnings", "passed")


@query("t15_chronological_split", f"{ORDERED} SELECT symbol, sequence, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'holdout' END AS role FROM o, n")
def chronological_split(spark, sf_dir):
    return T.chronological_split(split_input(spark, sf_dir), 0.8).select("symbol", "sequence", "role")


@query("o3_tail_share", f"{ORDERED} SELECT symbol, sequence FROM o, n WHERE pos >= n - floor(n * 0.6)")
def tail_share(spark, sf_dir):
    return T.tail_share(split_input(spark, sf_dir)).select("symbol", "sequence")


# ------------------------------------------------------------------------------------ labels
@query(
    "a15_label_distribution",
    f"""{PRED}, x AS (SELECT strftime(ts_event, '%Y-%m') AS month, * FROM pred), g AS (SELECT month, count(*) AS rows, sum((bias_label = 0)::INT)::BIGINT AS long, sum((bias_label = 1)::INT)::BIGINT AS short, sum((bias_label = 2)::INT)::BIGINT AS neutral, sum(train_event_flag)::BIGINT AS event_rows
  FROM x GROUP BY GROUPING SETS ((), (month))) SELECT *, (long + short)::DOUBLE / rows AS directional_share, CASE WHEN least(long, short) > 0 THEN greatest(long, short)::DOUBLE / least(long, short) END AS long_short_imbalance, '' AS warnings FROM g""",
    "directional_share long_short_imbalance",
)
def label_distribution(spark, sf_dir):
    return E.label_distribution(predictions(spark, sf_dir))


QUAL = "ql AS (SELECT *, (sequence % 5) AS path_outcome, (sequence % 4) AS neutral_reason, (sequence % 20) AS hs, (sequence % 5 IN (2, 3))::INT AS adverse_path_flag FROM pred)"


@query(
    "a16_label_quality",
    f"""{PRED}, {QUAL} SELECT strftime(ts_event, '%Y-%m') AS month, count(*) AS rows, {', '.join(f'sum((path_outcome = {v})::INT)::BIGINT AS {n}' for v, n in enumerate(('long_tp_first', 'short_tp_first', 'long_sl_first', 'short_sl_first', 'timeout')))},
 {', '.join(f'sum((neutral_reason = {v})::INT)::BIGINT AS reason_{n}' for v, n in enumerate(('none', 'timeout', 'long_sl', 'short_sl')))}, avg((hs > 1)::INT) FILTER (bias_label < 2) AS directional_overlap_rate, sum((bias_label < 2)::INT)::BIGINT AS directional_rows,
 avg((bias_label = 0)::INT) FILTER (bias_label < 2) AS long_share, avg(adverse_path_flag) AS adverse_path_share, quantile_cont(hs, 0.5) AS horizon_median, quantile_cont(hs, 0.95) AS horizon_p95 FROM ql GROUP BY 1""",
    "directional_overlap_rate long_share adverse_path_share horizon_median horizon_p95",
)
def label_quality(spark, sf_dir):
    s = F.col("sequence")
    rows = predictions(spark, sf_dir).withColumns({"path_outcome": s % 5, "neutral_reason": s % 4, "label_horizon_steps": s % 20, "adverse_path_flag": (s % 5).isin(2, 3).cast("int")})
    return E.label_quality(rows)


SLICES = """sl AS (SELECT 'all_rows' AS slice, * FROM pred UNION ALL SELECT 'directional_all', * FROM pred WHERE bias_label < 2 UNION ALL SELECT 'neutral', * FROM pred WHERE bias_label = 2 UNION ALL SELECT 'event_binary', * FROM pred WHERE bias_label < 2 AND train_event_flag = 1)"""


@query(
    "a31_slice_stats",
    f"""{PRED}, {SLICES} SELECT slice, count(*) AS rows, sum((bias_label = 0)::INT)::BIGINT AS long, sum((bias_label = 1)::INT)::BIGINT AS short, sum((bias_label = 2)::INT)::BIGINT AS neutral, count(*)::DOUBLE / (SELECT count(*) FROM pred) AS row_share,
 quantile_cont(label_horizon_steps, 0.5) AS label_horizon_steps_p50, quantile_cont(label_horizon_steps, 0.95) AS label_horizon_steps_p95, quantile_cont(realized_return, 0.5) AS realized_return_p50, quantile_cont(realized_return, 0.95) AS realized_return_p95 FROM sl GROUP BY slice""",
    "row_share label_horizon_steps_p50 label_horizon_steps_p95 realized_return_p50 realized_return_p95",
)
def slice_stats(spark, sf_dir):
    return E.slice_stats(predictions(spark, sf_dir))


@query(
    "a11_a30_labelled_bars",
    f"""{PRED}, b AS (SELECT symbol, date_trunc('day', ts_event) AS bar_ts, first(price ORDER BY ts_event, sequence) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts_event, sequence) AS close, sum(size)::DOUBLE AS volume, count(*) AS tick_count,
  sum((bias_label = 0)::INT)::BIGINT AS bias_0, sum((bias_label = 1)::INT)::BIGINT AS bias_1, sum((bias_label = 2)::INT)::BIGINT AS bias_2, max(sequence % 3) AS quality, {', '.join(f'sum((size % 4 = {v})::INT) AS r{v}' for v in range(4))} FROM pred GROUP BY ALL)
SELECT symbol, bar_ts, open, high, low, close, volume, tick_count, bias_0, bias_1, bias_2, quality, CASE WHEN greatest(bias_0, bias_1)::DOUBLE / tick_count >= 0.35::DOUBLE THEN CASE WHEN bias_0 >= bias_1 THEN 0 ELSE 1 END ELSE 2 END::BIGINT AS bias_label,
 (list_position([r0, r1, r2, r3], greatest(r0, r1, r2, r3)) - 1)::BIGINT AS regime FROM b""",
    "open high low close volume",
)
def labelled_bars(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumns({"regime": F.col("size") % 4, "signal_quality": F.col("sequence") % 3})
    return E.labelled_bars(rows, "1 day")


REP = """rk AS (SELECT symbol, date_trunc('day', ts_event) AS bar_ts, prob_long, prob_short, greatest(prob_long, prob_short) + 0.35::DOUBLE * abs(prob_long - prob_short) AS signal_strength, greatest(prob_long, prob_short) AS confidence, ts_event, sequence FROM pred),
rep AS (SELECT symbol, bar_ts, prob_long, prob_short, signal_strength, confidence FROM (SELECT *, row_number() OVER (PARTITION BY symbol, bar_ts ORDER BY signal_strength DESC, confidence DESC, ts_event, sequence) AS k FROM rk) WHERE k = 1)"""


@query("a12_representative_rows", f"{PRED}, {REP} SELECT * FROM rep", "prob_long prob_short signal_strength confidence")
def representative_rows(spark, sf_dir):
    return E.representative_rows(predictions(spark, sf_dir), "1 day", ["prob_long", "prob_short"])


PBARS = f"""{PRED}, {CVD_CTE}, {REP}, pb AS (SELECT p.symbol, date_trunc('day', p.ts_event) AS bar_ts, first(p.price ORDER BY p.ts_event, p.sequence) AS open, max(p.price) AS high, min(p.price) AS low, last(p.price ORDER BY p.ts_event, p.sequence) AS close, sum(p.size)::DOUBLE AS volume, count(*) AS event_count,
  last(c.cvd ORDER BY p.ts_event, p.sequence) AS cvd, last(c.cvd ORDER BY p.ts_event, p.sequence) - first(c.cvd ORDER BY p.ts_event, p.sequence) AS cvd_delta, avg(prob_long) AS prob_long_mean, avg(prob_short) AS prob_short_mean FROM pred p JOIN cvd_ticks c USING (sequence) GROUP BY 1, 2),
md AS (SELECT symbol, bar_ts, arg_min(regime, (-n, regime)) AS regime FROM (SELECT symbol, date_trunc('day', ts_event) AS bar_ts, size % 4 AS regime, count(*) AS n FROM pred GROUP BY ALL) GROUP BY ALL),
pbars AS (SELECT pb.*, md.regime, rep.prob_long, rep.prob_short, rep.confidence, CASE WHEN rep.prob_long >= rep.prob_short THEN 0 ELSE 1 END AS direction FROM pb JOIN rep USING (symbol, bar_ts) JOIN md USING (symbol, bar_ts))
"""


def pbars(spark, sf_dir):
    from tapeloom.plans.tick_queries import cvd_ticks

    rows = predictions(spark, sf_dir).withColumn("regime", F.col("size") % 4)
    cvd = cvd_ticks(spark, sf_dir).select("symbol", "sequence", "cvd")
    return E.prediction_bars(rows.join(cvd, ["symbol", "sequence"]), "1 day")


@query(
    "a13_prediction_bars",
    f"{PBARS} SELECT *, coalesce((direction <> lag(direction) OVER (PARTITION BY symbol ORDER BY bar_ts))::INT, 1)::BIGINT AS changed FROM pbars",
    "open high low close volume cvd cvd_delta prob_long_mean prob_short_mean prob_long prob_short confidence",
)
def prediction_bars(spark, sf_dir):
    return pbars(spark, sf_dir)


@query(
    "e16_hit_rates",
    f"""{PBARS}, m AS (SELECT *, lead(close, 4) OVER (PARTITION BY symbol ORDER BY bar_ts) - close AS mv FROM pbars) SELECT count(*) AS total, sum((direction = 0)::INT)::BIGINT AS n_long, sum((direction = 1)::INT)::BIGINT AS n_short,
 100.0 * sum((direction = 0 AND mv > 0)::INT) / sum((direction = 0 AND mv IS NOT NULL)::INT) AS long_hit_rate, 100.0 * sum((direction = 1 AND mv < 0)::INT) / sum((direction = 1 AND mv IS NOT NULL)::INT) AS short_hit_rate FROM m""",
    "long_hit_rate short_hit_rate",
)
def hit_rates(spark, sf_dir):
    return E.hit_rates(pbars(spark, sf_dir), 4)


@query(
    "e34_return_distribution",
    f"""{PBARS}, m AS (SELECT *, lead(close, 4) OVER (PARTITION BY symbol ORDER BY bar_ts) / close - 1 AS r FROM pbars) SELECT direction, CASE WHEN direction = 0 THEN r > 0 ELSE r < 0 END AS correct, count(*) AS rows, avg(r) AS mean_return, quantile_cont(r, 0.5) AS median_return FROM m WHERE r IS NOT NULL GROUP BY ALL""",
    "mean_return median_return",
)
def return_distribution(spark, sf_dir):
    return E.return_distribution(pbars(spark, sf_dir), 4)


# ------------------------------------------------------------------------------ predictions
BIN = "(" + " + ".join(f"(prob_long >= {i * 0.1!r}::DOUBLE)::INT" for i in range(1, 10)) + ")"


@query("e2_calibration_error", f"{PRED}, c AS (SELECT {BIN} AS b, count(*) AS n, avg(prob_long) AS conf, avg((bias_label = 0)::INT) AS acc FROM pred WHERE bias_label < 2 GROUP BY 1) SELECT sum(n)::BIGINT AS rows, sum(abs(conf - acc) * n) / sum(n) AS ece FROM c", "ece")
def calibration_error(spark, sf_dir):
    return E.calibration_error(predictions(spark, sf_dir))


@query(
    "e3_probability_scores",
    f"""{PRED}, c AS (SELECT (bias_label = 0)::INT::DOUBLE AS y, greatest(least(prob_long, 1 - 1e-6), 1e-6) AS p, greatest(least(0.25 + prob_long / 2, 1 - 1e-6), 1e-6) AS q FROM pred WHERE bias_label < 2)
SELECT count(*) AS rows, avg((p - y) ** 2) AS raw_brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS raw_nll, avg((q - y) ** 2) AS calibrated_brier, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS calibrated_nll FROM c""",
    "raw_brier raw_nll calibrated_brier calibrated_nll",
)
def probability_scores(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("cal", 0.25 + F.col("prob_long") / 2)
    return E.probability_scores(rows, {"raw": "prob_long", "calibrated": "cal"})


GUESS = "gs AS (SELECT *, CASE WHEN prob_long >= 0.6::DOUBLE THEN 0 WHEN prob_long <= 0.4::DOUBLE THEN 1 ELSE 2 END AS guess FROM pred)"
CLASS = """ct AS (SELECT l AS label, sum((bias_label = v AND guess = v)::INT)::DOUBLE AS tp, sum((guess = v)::INT) AS pr, sum((bias_label = v)::INT)::BIGINT AS support FROM gs, (VALUES (0, 'LONG'), (1, 'SHORT')) t(v, l) GROUP BY l),
cp AS (SELECT label, coalesce(tp / nullif(pr, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support FROM ct), cf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM cp)"""


def guessed(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("guess", F.when(F.col("prob_long") >= 0.6, 0).when(F.col("prob_long") <= 0.4, 1).otherwise(2))


@query("e33_class_table", f"{PRED}, {GUESS}, {CLASS} SELECT label, support, precision, recall, f1 FROM cf", "precision recall f1")
def class_table(spark, sf_dir):
    return E.class_table(guessed(spark, sf_dir), "bias_label", "guess")


@query("e4_macro_scores", f"{PRED}, {GUESS}, {CLASS} SELECT avg(precision) AS directional_precision_macro, avg(recall) AS directional_recall_macro, avg(f1) AS directional_f1_macro FROM cf", "directional_precision_macro directional_recall_macro directional_f1_macro")
def macro_scores(spark, sf_dir):
    return E.macro_scores(guessed(spark, sf_dir), "bias_label", "guess")


RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query("e5_auc", f"{PRED}, r AS (SELECT bias_label, {RANK.format(c='size')} AS rk FROM pred WHERE bias_label < 2), s AS (SELECT sum(rk) FILTER (bias_label = 0) AS sp, sum((bias_label = 0)::INT)::DOUBLE AS p, sum((bias_label = 1)::INT)::DOUBLE AS q FROM r) SELECT (p + q)::BIGINT AS rows, (sp - p * (p + 1) / 2) / (p * q) AS auc FROM s", "auc")
def auc(spark, sf_dir):
    return E.auc(predictions(spark, sf_dir).filter("bias_label < 2"), "size", F.col("bias_label") == 0)


@query("e6_spearman", f"{PRED}, r AS (SELECT {RANK.format(c='size')} AS a, {RANK.format(c='realized_return')} AS b FROM pred) SELECT count(*) AS rows, corr(a, b) AS rho FROM r", "rho")
def spearman(spark, sf_dir):
    return E.spearman(predictions(spark, sf_dir), "size", "realized_return")


def _prank(part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY value) + (count(*) OVER (PARTITION BY {part}, value) - 1) / 2.0)"


FOLDM = f"""lf AS (SELECT fold, role, bias_label, u.f AS feature, u.v AS value FROM roles, unnest([{{'f': 'price', 'v': price}}, {{'f': 'size', 'v': size::DOUBLE}}]) x(u) WHERE bias_label < 2),
rk AS (SELECT *, {_prank('fold, feature, role')} AS r FROM lf), a AS (SELECT fold, feature, role, count(*) AS n, (sum(r) FILTER (bias_label = 0) - sum((bias_label = 0)::INT)::DOUBLE * (sum((bias_label = 0)::INT) + 1) / 2) / (sum((bias_label = 0)::INT)::DOUBLE * sum((bias_label = 1)::INT)) AS auc,
  corr(r, CASE WHEN bias_label = 0 THEN 1 ELSE -1 END) AS ic FROM rk GROUP BY ALL),
fm AS (SELECT t.fold, t.feature, t.auc AS auc_long, t.n AS test_rows, r.auc AS train_auc_long, r.n AS train_rows, t.ic, greatest(t.auc, 1 - t.auc) AS auc_edge, CASE WHEN r.auc >= 0.5 THEN t.auc ELSE 1 - t.auc END AS train_signed_auc, CASE WHEN t.auc >= 0.5 THEN 'long' ELSE 'short' END AS signal_side
  FROM a t JOIN a r ON t.fold = r.fold AND t.feature = r.feature AND t.role = 'test' AND r.role = 'train')"""


@query("e7_feature_fold_metrics", f"{T1}, {FOLDM} SELECT * FROM fm", "auc_long train_auc_long ic auc_edge train_signed_auc")
def feature_fold_metrics(spark, sf_dir):
    return E.feature_fold_metrics(purged(spark, sf_dir), ["price", "size"])


FSUM = "fsum AS (SELECT feature, count(*) AS valid_folds, avg(train_signed_auc) AS train_signed_auc_mean, min(train_signed_auc) AS train_signed_auc_min, avg(auc_edge) AS auc_edge_mean, avg(abs(ic)) AS abs_ic_mean, greatest(sum((signal_side = 'long')::INT), sum((signal_side = 'short')::INT))::DOUBLE / count(*) AS side_stability FROM fm GROUP BY feature)"


@query("e7_feature_summary", f"{T1}, {FOLDM}, {FSUM} SELECT * FROM fsum", "train_signed_auc_mean train_signed_auc_min auc_edge_mean abs_ic_mean side_stability")
def feature_summary(spark, sf_dir):
    return E.feature_summary(E.feature_fold_metrics(purged(spark, sf_dir), ["price", "size"]))


@query(
    "e28_risk_flags",
    f"""{T1}, {FOLDM}, {FSUM}, {SLICES}, ss AS (SELECT slice, count(*) AS rows, count(*)::DOUBLE / (SELECT count(*) FROM pred) AS sh FROM sl GROUP BY slice), b AS (SELECT max(auc_edge_mean) AS a, max(train_signed_auc_mean) AS t, min(side_stability) AS st FROM fsum)
SELECT 'small_training_pool' AS flag FROM ss WHERE slice = 'event_binary' AND rows < 10000 UNION ALL SELECT 'directional_share_high' FROM ss WHERE slice = 'directional_all' AND sh > 0.25 UNION ALL SELECT 'no_stable_auc_edge' FROM b WHERE a < 0.53
UNION ALL SELECT 'no_train_signed_auc' FROM b WHERE t < 0.53 UNION ALL SELECT 'direction_does_not_transfer' FROM b WHERE a >= 0.56 AND t < 0.53 UNION ALL SELECT 'signal_side_flips' FROM b WHERE st < 0.67""",
)
def risk_flags(spark, sf_dir):
    return E.risk_flags(E.slice_stats(predictions(spark, sf_dir)), E.feature_summary(E.feature_fold_metrics(purged(spark, sf_dir), ["price", "size"])))


FEATURES = ["price", "size", "prob_long", "hourly"]


def feature_rows(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("hourly", F.hour("ts_event").cast("double"))


FEAT_CTE = f"ft AS (SELECT *, hour(ts_event)::DOUBLE AS hourly FROM pred), fr AS (SELECT {', '.join(RANK.format(c=c) + f' AS r_{c}' for c in FEATURES)} FROM ft)"
PAIRS = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': (SELECT abs(corr(r_{a}, r_{b})) FROM fr)}}" for a in FEATURES for b in FEATURES)


@query("e8_spearman_matrix", f"{PRED}, {FEAT_CTE} SELECT u.a, u.b, u.r AS rho FROM (SELECT unnest([{PAIRS}]) AS u)", "rho")
def spearman_matrix(spark, sf_dir):
    return E.spearman_matrix(feature_rows(spark, sf_dir), FEATURES)


def _closeness(columns: list[str]) -> str:
    """Rank correlations of the columns with each other as a table m(a, b, r), from rows ``ft``."""
    ranks = ", ".join(RANK.format(c=c) + f" AS r_{c}" for c in columns)
    cells = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': (SELECT coalesce(abs(corr(r_{a}, r_{b})), 0) FROM fr)}}" for a in columns for b in columns)
    return f"fr AS (SELECT {ranks} FROM ft), m AS (SELECT u.a, u.b, u.r FROM (SELECT unnest([{cells}]) AS u))"


TWINS = ["price", "price_twin", "size", "prob_long"]
REDUNDANCY_SQL = f"""{PRED.replace("WITH ", "WITH RECURSIVE ", 1)}, ft AS (SELECT *, price * 2 AS price_twin FROM pred), {_closeness([*TWINS, "realized_return"])},
near AS (SELECT a, list(b) FILTER (a <> b AND r > 0.85) AS close, max(r) FILTER (b = 'realized_return') AS rel FROM m WHERE a <> 'realized_return' GROUP BY a),
ranked AS (SELECT a, coalesce(close, []) AS close, row_number() OVER (ORDER BY rel DESC, list_position({TWINS}, a)) AS n FROM near),
walk AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS kept UNION ALL SELECT r.n, CASE WHEN list_has_any(w.kept, r.close) THEN w.kept ELSE list_append(w.kept, r.a) END FROM walk w JOIN ranked r ON r.n = w.n + 1),
done AS (SELECT kept FROM walk ORDER BY n DESC LIMIT 1)
SELECT unnest(range(len(kept)))::BIGINT AS rank, unnest(kept) AS feature FROM done"""
MRMR_SQL = f"""{PRED}, ft AS (SELECT *, hour(ts_event)::DOUBLE AS hourly FROM pred), {_closeness([*FEATURES, "realized_return"])},
rel AS (SELECT a AS f, r, list_position({FEATURES}, a) AS o FROM m WHERE b = 'realized_return' AND a <> b),
p1 AS (SELECT f FROM rel ORDER BY r DESC, o LIMIT 1),
p2 AS (SELECT rel.f FROM rel JOIN m ON m.a = rel.f JOIN p1 ON m.b = p1.f WHERE rel.f <> p1.f ORDER BY rel.r - m.r DESC, o LIMIT 1),
p3 AS (SELECT rel.f FROM rel JOIN m ON m.a = rel.f WHERE m.b IN (FROM p1 UNION ALL FROM p2) AND rel.f NOT IN (FROM p1 UNION ALL FROM p2) GROUP BY rel.f, rel.r, o ORDER BY rel.r - avg(m.r) DESC, o LIMIT 1)
SELECT 0::BIGINT AS rank, f AS feature FROM p1 UNION ALL SELECT 1, f FROM p2 UNION ALL SELECT 2, f FROM p3"""


@query("e8_redundancy_filter", REDUNDANCY_SQL)
def redundancy_filter(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).withColumn("price_twin", F.col("price") * 2)
    kept = E.redundancy_filter(rows, TWINS, "realized_return")
    return spark.createDataFrame(list(enumerate(kept)), "rank long, feature string")


@query("e9_mrmr", MRMR_SQL)
def mrmr(spark, sf_dir):
    picked = E.mrmr(feature_rows(spark, sf_dir), FEATURES, "realized_return", 3)
    return spark.createDataFrame(list(enumerate(picked)), "rank long, feature string")


def _mi(c: str) -> str:
    return f"""SELECT '{c}' AS feature, sum(n::DOUBLE / t * ln(n::DOUBLE * t / (nb::DOUBLE * nl))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY bias_label) AS nl, sum(n) OVER () AS t FROM
  (SELECT least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS b, bias_label, count(*) AS n FROM ft, (SELECT min({c}) AS lo, max({c}) AS hi FROM ft) GROUP BY 1, 2))"""


@query(
    "e10_feature_verdicts",
    f"""{PRED}, {FEAT_CTE}, lr AS (SELECT {RANK.format(c='bias_label')} AS y, {', '.join(RANK.format(c=c) + f' AS r_{c}' for c in FEATURES)} FROM ft), mi AS ({' UNION ALL '.join(_mi(c) for c in FEATURES)}),
st AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, stddev_samp({c}) AS std, avg((abs({c}) < 1e-12)::INT) AS zero_share, (SELECT corr(r_{c}, y) FROM lr) AS rho FROM ft" for c in FEATURES)})
SELECT feature, CASE WHEN std <= 1e-12 THEN 'DEAD' WHEN mi >= 0.10 THEN 'STRONG' WHEN mi >= 0.01 OR abs(rho) >= 0.06 THEN 'WEAK' ELSE 'NOISE' END AS verdict, mi, rho, std, zero_share FROM st JOIN mi USING (feature)""",
    "mi rho std zero_share",
)
def feature_verdicts(spark, sf_dir):
    return E.feature_verdicts(feature_rows(spark, sf_dir), FEATURES, "bias_label")


LONGF = "lg AS (SELECT strftime(ts_event, '%Y-%m-%d') AS month, ts_event < TIMESTAMP '2024-01-15' AS tr, u.f AS feature, u.v AS value FROM ft, unnest([{'f': 'size', 'v': size::DOUBLE}, {'f': 'hourly', 'v': hourly}, {'f': 'none', 'v': 0.0::DOUBLE}]) x(u))"


@query(
    "e11_monthly_drift",
    f"""{PRED}, ft AS (SELECT *, hour(ts_event)::DOUBLE AS hourly FROM pred), {LONGF}, rf AS (SELECT feature, avg(value) AS rm, CASE WHEN stddev_pop(value) > 1e-8 THEN stddev_pop(value) ELSE 1 END AS rs FROM lg WHERE tr GROUP BY feature),
ob AS (SELECT month, feature, avg((value <> 0)::INT) AS non_zero_rate, avg((value IS NULL)::INT) AS missing_rate, avg(value) AS om, stddev_pop(value) AS os FROM lg GROUP BY ALL)
SELECT month, feature, non_zero_rate, missing_rate, abs(om - rm) / rs + abs(os - rs) / rs AS shift_score, sum((non_zero_rate < 0.01)::INT) OVER (PARTITION BY feature ORDER BY month ROWS 2 PRECEDING) >= 3 AS dead FROM ob JOIN rf USING (feature)""",
    "non_zero_rate missing_rate shift_score",
)
def monthly_drift(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).withColumn("none", F.lit(0.0))
    return E.monthly_drift(rows, ["size", "hourly", "none"], F.lit("2024-01-15").cast("timestamp_ntz"), bucket="yyyy-MM-dd")


SCALER_CTE = f"""ft AS (SELECT *, hour(ts_event)::DOUBLE AS hourly, 0.0::DOUBLE AS flat, (sequence % 100 = 0)::INT::DOUBLE AS rare FROM pred), sp AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM ft" for c in ('price', 'size', 'flat', 'rare'))}),
cr AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, avg((abs(({c} - median) / greatest(iqr, 1e-3)) >= 9.5)::INT) AS clip_rate FROM ft, sp WHERE sp.feature = '{c}'" for c in ('price', 'size', 'flat', 'rare'))}),
sc AS (SELECT sp.*, clip_rate, CASE WHEN iqr >= 1e-3 AND NOT (clip_rate > 0.001 AND max - min > 1e-8) THEN 'robust' WHEN max - min > 1e-8 THEN 'minmax' ELSE 'zero' END AS kind FROM sp JOIN cr USING (feature))"""


def scaler(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumns({"flat": F.lit(0.0), "rare": (F.col("sequence") % 100 == 0).cast("double"), "size": F.col("size").cast("double")})
    return rows, E.fit_scaler(rows, ["price", "size", "flat", "rare"], clip_rate=0.001)


@query("e1_fit_scaler", f"{PRED}, {SCALER_CTE} SELECT * FROM sc", "median iqr min max clip_rate")
def fit_scaler(spark, sf_dir):
    return scaler(spark, sf_dir)[1]


@query("e29_scaler_baseline", f"{PRED}, {SCALER_CTE} SELECT feature, CASE kind WHEN 'robust' THEN median WHEN 'minmax' THEN (min + max) / 2 ELSE 0 END AS mean, CASE kind WHEN 'robust' THEN iqr WHEN 'minmax' THEN greatest((max - min) / 2, 1e-8) ELSE 1 END AS std FROM sc", "mean std")
def scaler_baseline(spark, sf_dir):
    return E.scaler_baseline(scaler(spark, sf_dir)[1])


def _scaled(c: str) -> str:
    return f"(SELECT CASE kind WHEN 'robust' THEN greatest(least(({c} - median) / greatest(iqr, 1e-3), 10), -10) WHEN 'minmax' THEN greatest(least(({c} - min) / greatest(max - min, 1e-8) * 2 - 1, 10), -10) ELSE 0 END FROM sc WHERE feature = '{c}') AS {c}"


@query("f27_apply_scaler", f"{PRED}, {SCALER_CTE} SELECT symbol, sequence, {', '.join(_scaled(c) for c in ('price', 'size', 'flat', 'rare'))} FROM ft", "price size flat rare")
def apply_scaler(spark, sf_dir):
    rows, params = scaler(spark, sf_dir)
    return E.apply_scaler(rows, params, ["price", "size", "flat", "rare"]).select("symbol", "sequence", "price", "size", "flat", "rare")


@query(
    "e17_hourly_report",
    f"""{PRED}, {GUESS}, d AS (SELECT hour(ts_event) AS hour_utc, bias_label AS t, CASE WHEN guess = 2 THEN 0 ELSE guess END AS g FROM gs WHERE bias_label < 2),
c AS (SELECT hour_utc, count(*) AS rows, avg((t = g)::INT) AS accuracy, avg((t = 0)::INT) AS long_rate_true, avg((g = 0)::INT) AS long_rate_pred, 2.0 * sum((t = 0 AND g = 0)::INT) / (sum((t = 0)::INT) + sum((g = 0)::INT)) AS f0, 2.0 * sum((t = 1 AND g = 1)::INT) / (sum((t = 1)::INT) + sum((g = 1)::INT)) AS f1 FROM d GROUP BY 1)
SELECT hour_utc, rows, accuracy, (f0 + f1) / 2 AS macro_f1, long_rate_true, long_rate_pred FROM c""",
    "accuracy macro_f1 long_rate_true long_rate_pred",
)
def hourly_report(spark, sf_dir):
    rows = guessed(spark, sf_dir).filter("bias_label < 2").withColumn("guess", F.when(F.col("guess") == 2, 0).otherwise(F.col("guess")))
    return E.hourly_report(rows, "bias_label", "guess")


@query(
    "e25_threshold_sweep",
    f"""{PRED}, th AS (SELECT round(0.30 + 0.01 * i, 2)::DOUBLE AS threshold FROM (SELECT unnest(range(0, 41)) AS i)), d AS (SELECT threshold, bias_label = 0 AS t, prob_long >= threshold AS g FROM pred, th WHERE bias_label < 2),
s AS (SELECT threshold, (coalesce(2.0 * sum((t AND g)::INT) / nullif(sum(t::INT) + sum(g::INT), 0), 0) + coalesce(2.0 * sum((NOT t AND NOT g)::INT) / nullif(sum((NOT t)::INT) + sum((NOT g)::INT), 0), 0)) / 2 AS macro_f1, avg((t = g)::INT) AS accuracy FROM d GROUP BY threshold)
SELECT *, threshold = (SELECT arg_max(threshold, (macro_f1, -threshold)) FROM s) AS best FROM s""",
    "threshold macro_f1 accuracy",
)
def threshold_sweep(spark, sf_dir):
    return E.threshold_sweep(predictions(spark, sf_dir))


TRIALS = "tl AS (SELECT symbol AS trial, avg(size) AS tr, avg(price) AS te FROM ticks GROUP BY symbol)"


@query("e19_overfit_probability", f"{V.TICKS}, {TRIALS}, b AS (SELECT arg_max(te, (tr, -trial)) AS best, count(*) AS n FROM tl), r AS (SELECT n, sum(CASE WHEN te < best THEN 1 WHEN te = best THEN 0.5 ELSE 0 END) + 0.5 AS rk FROM tl, b GROUP BY n) SELECT n AS trials, CASE WHEN n < 3 THEN 0.5 WHEN rk / (n + 1) < 0.5 THEN 1 ELSE 0 END::DOUBLE AS pbo FROM r", "pbo")
def overfit_probability(spark, sf_dir):
    trials = V.ticks(spark, sf_dir).groupBy(F.col("symbol").alias("trial")).agg(F.avg("size").alias("tr"), F.avg("price").alias("te"))
    return E.overfit_probability(trials, "tr", "te")


# ------------------------------------------------------------------------------------ trades
TRADES_CTE = f"trades AS (SELECT symbol, sequence AS trade_seq, ts_event AS entry_ts, label_end_ts AS exit_ts, CASE WHEN bias_label = 0 THEN 1 ELSE -1 END * realized_return * CASE WHEN sequence % 3 = 0 THEN -1 ELSE 1 END AS pnl FROM pred WHERE bias_label < 2)"


def trades(spark, sf_dir):
    sign = F.when(F.col("bias_label") == 0, 1).otherwise(-1) * F.when(F.col("sequence") % 3 == 0, -1).otherwise(1)
    return predictions(spark, sf_dir).filter("bias_label < 2").select("symbol", F.col("sequence").alias("trade_seq"), F.col("ts_event").alias("entry_ts"), F.col("label_end_ts").alias("exit_ts"), (sign * F.col("realized_return")).alias("pnl"))


@query(
    "a24_equity_metrics",
    f"""{PRED}, {TRADES_CTE}, e AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY entry_ts, trade_seq) AS equity FROM trades), k AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY entry_ts, trade_seq) AS peak FROM e)
SELECT symbol, max(peak - equity) AS max_drawdown, max((peak - equity) / greatest(peak, 1e-8)) AS max_drawdown_share, CASE WHEN count(*) >= 2 AND stddev_pop(pnl) > 1e-12 THEN avg(pnl) / stddev_pop(pnl) * sqrt(count(*)) ELSE 0 END AS trade_sharpe FROM k GROUP BY symbol""",
    "max_drawdown max_drawdown_share trade_sharpe",
)
def equity_metrics(spark, sf_dir):
    return E.equity_metrics(trades(spark, sf_dir), 10_000.0)


TSUM = "count(*) AS trades, avg((pnl > 0)::INT) AS win_rate, sum(pnl) AS total_pnl, avg(pnl) AS expectancy, CASE WHEN sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) > 1e-9 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) ELSE 0 END AS profit_factor"


@query("a25_trade_summary", f"{PRED}, {TRADES_CTE} SELECT symbol, {TSUM} FROM trades GROUP BY symbol", "win_rate total_pnl expectancy profit_factor")
def trade_summary(spark, sf_dir):
    return E.trade_summary(trades(spark, sf_dir), ["symbol"])


@query(
    "a26_fold_metrics",
    f"""{PRED}, {TRADES_CTE}, f AS (SELECT *, date_trunc('week', entry_ts) AS fold FROM trades), t AS (SELECT fold, {TSUM} FROM f GROUP BY fold),
e AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY fold ORDER BY entry_ts, trade_seq) AS equity FROM f), k AS (SELECT *, max(equity) OVER (PARTITION BY fold ORDER BY entry_ts, trade_seq) AS peak FROM e), d AS (SELECT fold, max((peak - equity) / peak) AS mdd FROM k GROUP BY fold)
SELECT count(*) AS n_folds, avg(win_rate) AS mean_win_rate, avg(profit_factor) AS mean_profit_factor, avg(expectancy) AS mean_expectancy, max(mdd) AS max_drawdown_share, sum(trades)::BIGINT AS total_trades, sum(total_pnl) AS total_pnl FROM t JOIN d USING (fold)""",
    "mean_win_rate mean_profit_factor mean_expectancy max_drawdown_share total_pnl",
)
def fold_metrics(spark, sf_dir):
    rows = trades(spark, sf_dir).withColumn("fold", F.date_trunc("week", "entry_ts"))
    both = E.trade_summary(rows, ["fold"]).join(E.equity_metrics(rows, 10_000.0, ["fold"]), "fold")
    return E.fold_metrics(both)


GATES = f"""m AS (SELECT count(*) AS trades, CASE WHEN sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) > 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) END AS profit_factor, avg(pnl) AS expectancy FROM trades)"""


@query(
    "e15_release_gates",
    f"""{PRED}, {TRADES_CTE}, {GATES}, g AS (SELECT unnest([{{'metric': 'n_folds', 'value': NULL::DOUBLE, 'rule': 'min', 'limit': 3.0::DOUBLE}}, {{'metric': 'trades', 'value': trades::DOUBLE, 'rule': 'min', 'limit': 30.0}}, {{'metric': 'directional_f1', 'value': NULL, 'rule': 'min', 'limit': 0.35}}, {{'metric': 'directional_precision', 'value': NULL, 'rule': 'min', 'limit': 0.35}},
 {{'metric': 'directional_recall', 'value': NULL, 'rule': 'min', 'limit': 0.25}}, {{'metric': 'profit_factor', 'value': profit_factor, 'rule': 'min', 'limit': 1.05}}, {{'metric': 'expectancy', 'value': expectancy, 'rule': 'min', 'limit': 0.0}}, {{'metric': 'ece', 'value': NULL, 'rule': 'max', 'limit': 0.12}}, {{'metric': 'max_drawdown_share', 'value': NULL, 'rule': 'max', 'limit': 0.05}}]) AS u FROM m),
h AS (SELECT u.metric, u.value, u.rule, u."limit" FROM g)
SELECT *, CASE WHEN value IS NULL THEN metric IN ('n_folds', 'ece') WHEN rule = 'min' THEN value >= "limit" ELSE value <= "limit" END AS passed,
 CASE WHEN value IS NULL THEN CASE WHEN metric IN ('n_folds', 'ece') THEN 'optional_metric_missing' ELSE 'required_metric_missing' END WHEN CASE WHEN rule = 'min' THEN value >= "limit" ELSE value <= "limit" END THEN 'ok' ELSE 'beyond ' || rule END AS reason FROM h""",
    'value "limit"',
)
def release_gates(spark, sf_dir):
    return M.release_gates(E.trade_summary(trades(spark, sf_dir)), optional=("n_folds", "ece"))


DAYBARS = TRADE_BARS_CTE.format(unit="day") + f", ab AS (SELECT * EXCLUDE (pc, tr) FROM {ATR.format(src='trade_bars')})"


def day_bars(spark, sf_dir):
    return O.with_atr(O.trade_bars(V.ticks(spark, sf_dir), "1 day"))


@query(
    "a27_percentile_tables",
    f"{V.TICKS}, {DAYBARS}, x AS (SELECT dayname(bar_ts) AS d, atr_14 FROM ab) SELECT d AS weekday, {', '.join(f'quantile_cont(atr_14, {p / 100}) AS p{p}' for p in (10, 25, 50, 75, 90))} FROM x GROUP BY d",
    "p10 p25 p50 p75 p90",
)
def percentile_tables(spark, sf_dir):
    return E.percentile_table(day_bars(spark, sf_dir).withColumn("weekday", F.date_format("bar_ts", "EEEE")), "atr_14", ["weekday"])


@query(
    "a27_forward_returns",
    f"""{V.TICKS}, {DAYBARS}, x AS (SELECT h AS horizon, lead(close, h) OVER (PARTITION BY symbol, h ORDER BY bar_ts) / close - 1 AS r FROM ab, (VALUES (1), (3), (6)) t(h)) SELECT horizon, {', '.join(f'quantile_cont(r, {p / 100}) AS p{p}' for p in (10, 25, 50, 75, 90))} FROM x WHERE r IS NOT NULL GROUP BY horizon""",
    "p10 p25 p50 p75 p90",
)
def forward_returns(spark, sf_dir):
    return E.percentile_table(E.forward_returns(day_bars(spark, sf_dir), [1, 3, 6]), "forward_return", ["horizon"])


@query(
    "e18_weekly_stability",
    f"""{V.TICKS}, {DAYBARS}, n AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY symbol, wk) AS nb FROM (SELECT *, date_trunc('week', bar_ts) AS wk FROM ab) WINDOW w AS (PARTITION BY symbol, wk ORDER BY bar_ts)),
d AS (SELECT *, greatest(atr_14, 0.01::DOUBLE) AS a FROM n WHERE n + 2 <= nb), c AS (SELECT d.symbol, d.wk, d.n, f.n AS fn, CASE WHEN f.high >= d.close + d.a * 1.5 THEN 0 WHEN f.low <= d.close - d.a THEN 2 WHEN f.low <= d.close - d.a * 1.5 THEN 1 WHEN f.high >= d.close + d.a THEN 2 END AS k FROM d JOIN n f ON d.symbol = f.symbol AND d.wk = f.wk AND f.n > d.n AND f.n <= d.n + 2),
l AS (SELECT symbol, wk, n, coalesce(arg_min(k, CASE WHEN k IS NOT NULL THEN fn END), 2) AS lab FROM c GROUP BY ALL) SELECT strftime(wk, '%Y-%m-%d') AS week, count(*) AS rows, avg((lab = 0)::INT) AS long_share, avg((lab = 1)::INT) AS short_share, avg((lab = 2)::INT) AS neutral_share FROM l GROUP BY 1""",
    "long_share short_share neutral_share",
)
def weekly_stability(spark, sf_dir):
    from tapeloom.operators.labels import simulate_touch

    bars = day_bars(spark, sf_dir).withColumns({"week": F.date_format(F.date_trunc("week", "bar_ts"), "yyyy-MM-dd"), "_plain": F.col("symbol")})
    bars = bars.withColumn("symbol", F.struct("_plain", "week"))  # weeks do not look into the next one
    rows = simulate_touch(bars, 2, 1.5, 1.0, 0.01)
    share = lambda v: F.avg((F.col("bias_label") == v).cast("double"))
    return rows.groupBy("week").agg(F.count(F.lit(1)).alias("rows"), share(0).alias("long_share"), share(1).alias("short_share"), share(2).alias("neutral_share"))


HL = " UNION ALL ".join(f"SELECT '{f}' AS feature, h AS lag, {f} AS now, lag({f}, h) OVER (PARTITION BY symbol, h ORDER BY bar_ts) AS thn FROM ab, (SELECT unnest(range(1, 6)) AS h)" for f in ("atr_14", "volume"))


@query(
    "w44_half_life",
    f"""{V.TICKS}, {DAYBARS}, x AS ({HL}), y AS (SELECT * FROM x WHERE thn IS NOT NULL),
r AS (SELECT feature, lag, rank() OVER (PARTITION BY feature, lag ORDER BY now) + (count(*) OVER (PARTITION BY feature, lag, now) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature, lag ORDER BY thn) + (count(*) OVER (PARTITION BY feature, lag, thn) - 1) / 2.0 AS b FROM y),
c AS (SELECT feature, lag, corr(a, b) AS rho FROM r GROUP BY ALL) SELECT feature, coalesce(min(lag) FILTER (abs(rho) <= 0.5), 6) AS half_life FROM c GROUP BY feature""",
)
def half_life(spark, sf_dir):
    return E.half_life(day_bars(spark, sf_dir), ["atr_14", "volume"], 5)


# ------------------------------------------------------------------------------------ policy
STRUCT_CTE = """sr AS (SELECT *, (sequence % 10) / 10.0::DOUBLE AS trend_strength, (sequence % 7) / 7.0::DOUBLE AS correction_depth, (sequence % 23) / 50.0::DOUBLE AS liquidity_sweep, (sequence % 4) / 10.0::DOUBLE AS kalman_trend_strength, (sequence % 3)::DOUBLE AS event_score, (sequence % 11) / 10.0::DOUBLE AS price_position FROM pred),
sb AS (SELECT *, CASE WHEN abs(liquidity_sweep) >= 0.35 THEN 'liquidity_sweep' WHEN trend_strength >= 0.55 AND correction_depth <= 0.20 AND kalman_trend_strength >= 0.20 THEN 'impulse_extension' WHEN trend_strength >= 0.35 AND correction_depth >= 0.60 THEN 'deep_pullback'
  WHEN trend_strength >= 0.30 AND correction_depth >= 0.25 THEN 'trend_pullback' WHEN kalman_trend_strength >= 0.20 AND event_score >= 1.0 THEN 'trend_confirmation' WHEN price_position BETWEEN 0.20 AND 0.80 THEN 'mid_range_probe' ELSE 'transition' END AS structure,
  (size % 4)::INT AS regime, abs(realized_return) / 10.0 AS move, (sequence % 5 <> 0)::INT AS covered, [(size % 4 + 1)::DOUBLE, (size % 3 + 0.5)::DOUBLE, (size % 5)::DOUBLE, 1.0::DOUBLE] AS rp0 FROM sr)"""


def policy_rows(spark, sf_dir):
    s, z = F.col("sequence"), F.col("size")
    rows = predictions(spark, sf_dir).withColumns(
        {
            "trend_strength": (s % 10) / 10.0, "correction_depth": (s % 7) / 7.0, "liquidity_sweep": (s % 23) / 50.0, "kalman_trend_strength": (s % 4) / 10.0, "event_score": (s % 3).cast("double"), "price_position": (s % 11) / 10.0,
            "regime": (z % 4).cast("int"), "move": F.abs("realized_return") / 10.0, "covered": (s % 5 != 0).cast("int"),
            "regime_probs": F.array((z % 4 + 1).cast("double"), (z % 3 + 0.5).cast("double"), (z % 5).cast("double"), F.lit(1.0)),
            "uncertainty": (s % 9) / 10.0, "runtime_penalty": F.when(s % 13 == 0, 0.4).otherwise(1.0),
        }
    )
    return rows.withColumn("structure", X.structure_bucket())


@query("f15_structure_bucket", f"{PRED}, {STRUCT_CTE} SELECT symbol, sequence, structure FROM sb")
def structure_bucket(spark, sf_dir):
    return policy_rows(spark, sf_dir).select("symbol", "sequence", "structure")


POLICY_CTE = """ps AS (SELECT structure, regime, bias_label, move, covered, 'LONG' AS side, 0 AS won, prob_long AS p FROM sb UNION ALL SELECT structure, regime, bias_label, move, covered, 'SHORT', 1, prob_short FROM sb),
pg AS (SELECT side, structure, regime, count(*) AS support, sum((bias_label = won)::INT)::BIGINT AS win_support, sum((bias_label = 1 - won)::INT)::BIGINT AS loss_support, avg(covered) AS coverage_ratio,
  greatest(coalesce(sum(move * p) FILTER (bias_label = won) / nullif(sum(p) FILTER (bias_label = won), 0), 0), 1.4) AS avg_win, greatest(coalesce(sum(move * p) FILTER (bias_label = 1 - won) / nullif(sum(p) FILTER (bias_label = 1 - won), 0), 0), 1.4) AS avg_loss, sum((bias_label = won)::INT * p) / sum(p) AS realized_prior
  FROM ps GROUP BY GROUPING SETS ((side), (side, structure), (side, structure, regime))),
pol AS (SELECT *, greatest(least((avg_loss + 1.4) / greatest(avg_win + avg_loss + 1.4, 1e-8), 1), 0) AS threshold FROM pg)"""


@query("a23_side_stats", f"{PRED}, {STRUCT_CTE}, {POLICY_CTE} SELECT side, structure, coalesce(regime, -1) AS regime, support, win_support, loss_support, coverage_ratio, avg_win, avg_loss, realized_prior, threshold FROM pol", "coverage_ratio avg_win avg_loss realized_prior threshold")
def side_stats(spark, sf_dir):
    return P.side_stats(policy_rows(spark, sf_dir), 1.4).withColumn("regime", F.coalesce("regime", F.lit(-1)))


NORM = "list_transform({a}, lambda x: x / list_sum({a}))"


@query(
    "f22_decisions",
    f"""{PRED}, {STRUCT_CTE}, {POLICY_CTE}, pr0 AS (SELECT [avg(rp0[1]), avg(rp0[2]), avg(rp0[3]), avg(rp0[4])] AS pr FROM sb), pr AS (SELECT {NORM.format(a='pr')} AS pr FROM pr0),
gr AS (SELECT st.structure, sd.side, r.regime, CASE WHEN f.support >= 40 THEN f.avg_win WHEN b.support >= 40 THEN b.avg_win ELSE g.avg_win END AS w, CASE WHEN f.support >= 40 THEN f.avg_loss WHEN b.support >= 40 THEN b.avg_loss ELSE g.avg_loss END AS l, CASE WHEN f.support >= 40 THEN f.threshold WHEN b.support >= 40 THEN b.threshold ELSE g.threshold END AS t
  FROM (SELECT DISTINCT structure FROM sb) st, (VALUES ('LONG'), ('SHORT')) sd(side), (VALUES (0), (1), (2), (3)) r(regime) JOIN pol g ON g.side = sd.side AND g.structure IS NULL LEFT JOIN pol b ON b.side = sd.side AND b.structure = st.structure AND b.regime IS NULL LEFT JOIN pol f ON f.side = sd.side AND f.structure = st.structure AND f.regime = r.regime),
ga AS (SELECT structure, side, list(w ORDER BY regime) AS w, list(l ORDER BY regime) AS l, list(t ORDER BY regime) AS t FROM gr GROUP BY ALL),
x1 AS (SELECT sb.*, {NORM.format(a='rp0')} AS rp FROM sb), x2 AS (SELECT *, -list_sum(list_transform(rp, lambda x: x * ln(greatest(x, 1e-12)))) / ln(4.0) AS en FROM x1),
x3 AS (SELECT x2.*, greatest(least((en - 0.70) / 0.25, 1), 0) AS bl, pr.pr AS pr FROM x2, pr), x4 AS (SELECT *, list_transform(range(1, 5), lambda i: (1 - bl) * rp[i] + bl * pr[i]) AS mx0 FROM x3), x5 AS (SELECT *, {NORM.format(a='mx0')} AS mx FROM x4),
x6 AS (SELECT x5.*, list_sum(list_transform(range(1, 5), lambda i: mx[i] * a.w[i])) AS lw, list_sum(list_transform(range(1, 5), lambda i: mx[i] * a.l[i])) AS ll, list_sum(list_transform(range(1, 5), lambda i: mx[i] * a.t[i])) AS lt,
  list_sum(list_transform(range(1, 5), lambda i: mx[i] * b.w[i])) AS sw, list_sum(list_transform(range(1, 5), lambda i: mx[i] * b.l[i])) AS sl, list_sum(list_transform(range(1, 5), lambda i: mx[i] * b.t[i])) AS sth FROM x5 JOIN ga a ON a.structure = x5.structure AND a.side = 'LONG' JOIN ga b ON b.structure = x5.structure AND b.side = 'SHORT'),
x7 AS (SELECT *, prob_long * lw - (1 - prob_long) * ll - 1.4 AS ev_long, prob_short * sw - (1 - prob_short) * sl - 1.4 AS ev_short, CASE WHEN sequence % 13 = 0 THEN 0.4 ELSE 1.0 END AS rt FROM x6),
x8 AS (SELECT *, rt >= 0.5 AND prob_long >= lt AND ev_long > 0 AS okl, rt >= 0.5 AND prob_short >= sth AND ev_short > 0 AS oks FROM x7)
SELECT symbol, sequence, en AS regime_entropy, ev_long, ev_short, lt AS long_threshold, sth AS short_threshold, CASE WHEN okl AND (NOT oks OR ev_long >= ev_short) THEN 0 WHEN oks THEN 1 ELSE 2 END::BIGINT AS bias,
 CASE WHEN okl AND (NOT oks OR ev_long >= ev_short) THEN 'cost_aware_ev_long' WHEN oks THEN 'cost_aware_ev_short' WHEN rt < 0.5 THEN 'runtime_penalty_too_low' WHEN prob_long < lt AND prob_short < sth THEN 'probability_below_threshold' WHEN ev_long <= 0 AND ev_short <= 0 THEN 'expected_value_non_positive' ELSE 'mixed_policy_constraints' END AS reason,
 greatest(least((1 - (sequence % 9) / 10.0) * (1 - en) * greatest(rt, 0.25), 1), 0) AS sizing_penalty FROM x8""",
    "regime_entropy ev_long ev_short long_threshold short_threshold sizing_penalty",
)
def decisions(spark, sf_dir):
    rows = policy_rows(spark, sf_dir)
    out = P.decide(rows, P.side_stats(rows, 1.4), P.regime_priors(rows), 1.4)
    return out.select("symbol", "sequence", "regime_entropy", "ev_long", "ev_short", "long_threshold", "short_threshold", "bias", "reason", "sizing_penalty")


THR = f"ma AS (SELECT *, CASE WHEN count(mv) OVER f >= 5 THEN avg(mv) OVER f ELSE 0 END AS micro_atr FROM (SELECT *, abs(price - lag(price) OVER ({BY})) AS mv FROM ticks) WINDOW f AS ({BY} ROWS 19 PRECEDING))"


@query(
    "e20_trade_paths",
    f"""{V.TICKS}, {THR}, d AS (SELECT *, row_number() OVER ({BY}) AS n, sequence % 3 AS direction, greatest(5.0::DOUBLE, 0.5 * micro_atr) AS stp, CASE WHEN sequence % 3 = 0 THEN 1 ELSE -1 END AS sg FROM ma),
e AS (SELECT a.*, b.price AS ep FROM d a JOIN d b ON a.symbol = b.symbol AND b.n = a.n + 1 WHERE a.direction < 2), p AS (SELECT e.symbol, e.n, f.n AS fn, f.price AS fp, (f.price - e.ep) * e.sg AS gain FROM e JOIN d f ON e.symbol = f.symbol AND f.n > e.n + 1 AND f.n <= e.n + 9),
h AS (SELECT e.symbol, e.n, min(CASE WHEN gain >= stp * 1.5 OR gain <= -stp THEN fn END) AS hn, max(fn) AS zn, max(gain) AS mfe, min(gain) AS mae FROM e JOIN p USING (symbol, n) GROUP BY ALL),
x AS (SELECT e.symbol, e.ts_event, e.sequence, e.ep, e.n, e.sg, e.stp, coalesce(hn, zn) AS xn, hn, mfe, mae FROM e JOIN h USING (symbol, n)),
y AS (SELECT x.*, d.ts_event AS exit_ts, (d.price - ep) * x.sg AS g FROM x JOIN d ON d.symbol = x.symbol AND d.n = xn)
SELECT symbol, ts_event, sequence, ep AS entry_price, CASE WHEN hn IS NULL THEN 'horizon' WHEN g >= stp * 1.5 THEN 'tp' ELSE 'sl' END AS exit_reason, exit_ts, xn - n - 1 AS hold_steps, CASE WHEN hn IS NULL THEN g WHEN g >= stp * 1.5 THEN stp * 1.5 ELSE -stp END / 5.0 AS raw_pnl_ticks,
 CASE WHEN hn IS NULL THEN g WHEN g >= stp * 1.5 THEN stp * 1.5 ELSE -stp END / 5.0 - 0.8::DOUBLE AS pnl_ticks, mfe / 5.0 AS mfe_ticks, mae / 5.0 AS mae_ticks FROM y""",
    "entry_price raw_pnl_ticks pnl_ticks mfe_ticks mae_ticks",
    digits=8,
)
def trade_paths(spark, sf_dir):
    rows = micro_atr(V.ticks(spark, sf_dir), 20).withColumn("direction", F.col("sequence") % 3)
    out = P.trade_paths(rows, 8, 5.0, latency=1, cost_ticks=0.8)
    return out.select(*KEY, "entry_price", "exit_reason", "exit_ts", "hold_steps", "raw_pnl_ticks", "pnl_ticks", "mfe_ticks", "mae_ticks")


# -------------------------------------------------------------------------------- monitoring
LOG_CTE = """lg AS (SELECT event_id, ts, ['prediction_emitted', 'prediction_blocked', 'order_filled', 'order_rejected', 'regime_fallback_used', 'data_gap_detected', 'shadow_outcome_realized'][event_id % 7 + 1] AS event_type, value AS latency_ms, (event_id % 10) / 10.0::DOUBLE AS confidence,
  event_id % 4 <> 0 AS event_gate_passed, (event_id % 50 = 0)::INT AS missing_features, (event_id % 20) / 20.0::DOUBLE AS prob_long, event_id % 3 AS true_bias, event_id % 5 <> 0 AS correct, user_id % 5 AS model FROM events)"""


def event_log(spark, sf_dir):
    i = F.col("event_id")
    kinds = ["prediction_emitted", "prediction_blocked", "order_filled", "order_rejected", "regime_fallback_used", "data_gap_detected", "shadow_outcome_realized"]
    return V.events(spark, sf_dir).select(
        i.alias("event_id"), "ts", F.get(F.array(*[F.lit(k) for k in kinds]), (i % 7).cast("int")).alias("event_type"), F.col("value").alias("latency_ms"), ((i % 10) / 10.0).alias("confidence"),
        (i % 4 != 0).alias("event_gate_passed"), (i % 50 == 0).cast("int").alias("missing_features"), ((i % 20) / 20.0).alias("prob_long"), (i % 3).alias("true_bias"), (i % 5 != 0).alias("correct"), (F.col("user_id") % 5).alias("model"),
        F.create_map(F.lit("value"), F.col("value"), F.lit("index"), (i % 100).cast("double")).alias("stat_features"),
    )


MON = """mon AS (SELECT model, count(*) AS events, sum((event_type IN ('prediction_emitted', 'prediction_blocked'))::INT)::BIGINT AS predictions, sum((event_type = 'prediction_emitted')::INT)::BIGINT AS prediction_emitted, sum((event_type = 'prediction_blocked')::INT)::BIGINT AS blocked, sum((event_type = 'order_filled')::INT)::BIGINT AS fills,
 sum((event_type = 'order_rejected')::INT)::BIGINT AS rejects, sum((event_type = 'data_gap_detected')::INT)::BIGINT AS data_gap_events, avg(missing_features) FILTER (event_type LIKE 'prediction%') AS missing_ratio_events,
 avg(confidence) FILTER (event_type = 'prediction_emitted') AS confidence_mean, avg(event_gate_passed::INT) FILTER (event_type LIKE 'prediction%') AS event_gate_rate, avg((event_type = 'regime_fallback_used')::INT) AS fallback_frequency,
 avg((prob_long - (true_bias = 0)::INT) ** 2) FILTER (event_type = 'shadow_outcome_realized' AND true_bias < 2) AS brier_score, avg(correct::INT) FILTER (event_type = 'shadow_outcome_realized') AS win_rate,
 quantile_cont(latency_ms, 0.5) FILTER (event_type LIKE 'prediction%') AS latency_p50, quantile_cont(latency_ms, 0.95) FILTER (event_type LIKE 'prediction%') AS latency_p95, quantile_cont(latency_ms, 0.99) FILTER (event_type LIKE 'prediction%') AS latency_p99 FROM lg GROUP BY model),
mon2 AS (SELECT *, fills::DOUBLE / greatest(fills + rejects, 1) AS fill_ratio, rejects::DOUBLE / greatest(fills + rejects, 1) AS reject_ratio, blocked::DOUBLE / greatest(predictions, 1) AS blocked_frequency, abs(confidence_mean - 0.3) AS confidence_mean_delta, abs(event_gate_rate - 0.5) AS event_gate_rate_delta, brier_score - 0.1 AS brier_score_delta, 0.95 - win_rate AS win_rate_drop FROM mon)"""
BASELINE = {"confidence_mean": 0.3, "event_gate_rate": 0.5, "brier_score": 0.1, "win_rate": 0.95}


@query(
    "e13_monitoring_summary",
    f"WITH {LOG_CTE}, {MON} SELECT * FROM mon2",
    "missing_ratio_events confidence_mean event_gate_rate fallback_frequency brier_score win_rate latency_p50 latency_p95 latency_p99 fill_ratio reject_ratio blocked_frequency confidence_mean_delta event_gate_rate_delta brier_score_delta win_rate_drop",
)
def monitoring_summary(spark, sf_dir):
    return M.summarise(event_log(spark, sf_dir), ["model"], BASELINE)


@query(
    "e14_alerts",
    f"WITH {LOG_CTE}, {MON}, c AS (SELECT model, unnest([{', '.join(f'''{{'a': '{a}', 'm': '{m}', 'v': {m}::DOUBLE, 'l': {v}::DOUBLE}}''' for a, m, v in M.ALERT_RULES)}]) AS u FROM mon2) SELECT model, u.a AS alert, u.m AS metric, u.v AS value, u.l AS \"limit\" FROM c WHERE u.v > u.l",
    'value "limit"',
)
def alert_rows(spark, sf_dir):
    return M.alerts(M.summarise(event_log(spark, sf_dir), ["model"], BASELINE), ["model"])


@query(
    "e12_feature_drift",
    """WITH f AS (SELECT 'value' AS feature, value AS v FROM events UNION ALL SELECT 'index', (event_id % 100)::DOUBLE FROM events), n AS (SELECT feature, count(v) AS count, avg(v) AS observed_mean, stddev_pop(v) AS observed_std, CASE feature WHEN 'value' THEN 45.0 ELSE 0.0 END AS m, CASE feature WHEN 'value' THEN 50.0 ELSE 1.0 END AS s FROM f GROUP BY feature),
p AS (SELECT feature, count, observed_mean, observed_std, abs(observed_mean - m) / s + abs(observed_std - s) / s AS shift_score FROM n) SELECT *, CASE WHEN shift_score > 0.35 THEN 'critical' WHEN shift_score > 0.25 THEN 'warning' ELSE 'ok' END AS level FROM p""",
    "observed_mean observed_std shift_score",
)
def feature_drift(spark, sf_dir):
    baseline = spark.createDataFrame([("value", 45.0, 50.0)], "feature string, mean double, std double")
    return M.feature_drift(event_log(spark, sf_dir), baseline)


@query(
    "e21_plausibility",
    f"""{PRED}, r AS (SELECT 'price' AS feature, avg((NOT price BETWEEN 1000 AND 1200)::INT) AS outside_share, min(price) AS low, max(price) AS high, stddev_samp(price) AS std, 0.05 AS lim FROM pred UNION ALL SELECT 'size', avg((NOT size BETWEEN 1 AND 50)::INT), min(size), max(size), stddev_samp(size), 0.1 FROM pred
 UNION ALL SELECT 'prob_long', avg((NOT prob_long BETWEEN 0 AND 1)::INT), min(prob_long), max(prob_long), stddev_samp(prob_long), 0.0 FROM pred) SELECT feature, outside_share, low, high, std, outside_share <= lim AND std > 1e-12 AS plausible FROM r""",
    "outside_share low high std",
)
def plausibility(spark, sf_dir):
    return M.plausibility(predictions(spark, sf_dir), [("price", 1000.0, 1200.0, 0.05), ("size", 1.0, 50.0, 0.1), ("prob_long", 0.0, 1.0, 0.0)])


CHECKS = f"""{V.TICKS}, {DAYBARS}, b AS (SELECT *, volume > 90 AS ev FROM ab), c AS (SELECT 'duplicate_bars' AS "check", 0.0::DOUBLE AS value, true AS passed UNION ALL SELECT 'event_rate', avg(ev::INT), avg(ev::INT) BETWEEN 0.05 AND 0.60 FROM b UNION ALL SELECT 'empty_columns_prices', 0.0, true UNION ALL SELECT 'empty_columns_book', 2.0, false)"""


def bar_checks(spark, sf_dir):
    bars = day_bars(spark, sf_dir).withColumns({"is_event": (F.col("volume") > 90).cast("int"), "spread_bar": F.lit(0.0), "depth_bar": F.lit(None).cast("double")})
    return M.artifact_check(bars, {"prices": ["open", "close", "atr_14"], "book": ["spread_bar", "depth_bar"]})


@query("e27_artifact_check", f"{CHECKS} SELECT * FROM c", "value")
def artifact_check(spark, sf_dir):
    return bar_checks(spark, sf_dir)


@query("e32_readiness", f"""{CHECKS} SELECT count(*) AS checks, sum((NOT passed)::INT)::BIGINT AS failed, string_agg("check", ',' ORDER BY "check") FILTER (NOT passed) AS failed_checks, bool_and(passed) AS passed FROM c""")
def readiness(spark, sf_dir):
    return M.readiness(bar_checks(spark, sf_dir))


@query(
    "e31_column_health",
    f"""{PRED} SELECT 'absorption' AS feature, stddev_pop(least(size / 5.0, 10)) AS std, 'stuck at cap' AS reason FROM pred UNION ALL SELECT 'kyle', stddev_pop(size / 100000.0), 'raw scale' FROM pred UNION ALL SELECT 'price', stddev_pop(price), 'ok' FROM pred UNION ALL SELECT 'lost', NULL, 'no finite values'""",
    "std",
)
def column_health(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumns({"absorption": F.least(F.col("size") / 5.0, F.lit(10.0)), "kyle": F.col("size") / 100000.0, "lost": F.lit(None).cast("double")})
    return M.column_health(rows, {"absorption": "capped", "kyle": "signed", "price": "plain", "lost": "plain"})


# ------------------------------------------------------------------------- column formulas
@query("f16_f17_setup_liquidity", f"{PRED}, s AS (SELECT *, (sequence % 5) / 10.0::DOUBLE AS a, (sequence % 3) / 10.0::DOUBLE AS p, (sequence % 7 - 3) / 10.0::DOUBLE AS o, (sequence % 4)::DOUBLE AS bw, (sequence % 6)::DOUBLE AS aw FROM pred), t AS (SELECT *, (a > 0.2)::INT + (p > 0.15)::INT + (abs(o) > 0.2)::INT AS n FROM s) SELECT symbol, sequence, CASE WHEN n = 1 AND a > 0.2 THEN 0 WHEN n = 1 AND p > 0.15 THEN 1 WHEN n = 1 AND abs(o) > 0.2 THEN 2 ELSE 3 END::BIGINT AS setup, least(ln(1 + size::DOUBLE) * (1 + abs(o)) * (1 + greatest(bw, aw)) + 0.25 * price / 100 + 0.1 * a, 100) AS liq_score FROM t", "liq_score")
def setup_liquidity(spark, sf_dir):
    s = F.col("sequence")
    rows = predictions(spark, sf_dir).withColumns({"absorption_intensity": (s % 5) / 10.0, "spoofing_ratio": (s % 3) / 10.0, "obi": (s % 7 - 3) / 10.0, "bid_wall_strength": (s % 4).cast("double"), "ask_wall_strength": (s % 6).cast("double"), "volume": F.col("size"), "liquidity_density": F.col("price") / 100, "gap_size": (s % 5) / 10.0})
    return rows.select("symbol", "sequence", X.setup_label().alias("setup"), X.liquidity_score().alias("liq_score"))


@query("f18_f20_fill_and_cost", f"{V.TICKS} SELECT sequence, greatest(least((size::DOUBLE / (greatest(sequence % 50, 0) + 40.0) + 0.25 * (sequence % 3) / 2.0) * exp(-0.08 * (sequence % 6)), 1), 0) AS fill_probability, greatest((sequence % 4)::DOUBLE, 2 * ((sequence % 3) / 2.0 + 0.5 * (sequence % 2) + 0.75 / 6.25)) AS cost FROM ticks", "fill_probability cost")
def fill_and_cost(spark, sf_dir):
    s = F.col("sequence")
    fill = X.fill_probability((s % 50).cast("double"), F.col("size").cast("double"), F.lit(40.0), s % 6, (s % 3) / 2.0)
    cost = X.round_trip_cost((s % 4).cast("double"), F.lit(0.75), F.lit(6.25), (s % 2).cast("double"), (s % 3) / 2.0)
    return V.ticks(spark, sf_dir).select("sequence", fill.alias("fill_probability"), cost.alias("cost"))


@query(
    "f21_f33_position_sizes",
    f"""{V.TICKS}, i AS (SELECT sequence, (sequence % 100) / 100.0::DOUBLE AS p, (size % 9 + 1)::DOUBLE AS w, (size % 5 + 1)::DOUBLE AS l, (sequence % 4) / 10.0::DOUBLE AS u FROM ticks), k AS (SELECT *, p - (1 - p) / (w / l) AS f FROM i),
z AS (SELECT *, CASE WHEN p > 0 AND f > 0 THEN least(greatest(round_even(f * 0.25 * p * 40, 0), 1), 40) ELSE 1 END::BIGINT AS kelly, least(greatest(round_even(greatest(f, 0) * 0.25 * (1 - u) * 40, 0), 0), 40)::BIGINT AS fk FROM k)
SELECT sequence, kelly, fk AS fractional_kelly, CASE WHEN p >= 0.8 THEN 40 WHEN p >= 0.7 THEN 39 WHEN p >= 0.6 THEN 20 ELSE 1 END::BIGINT AS by_confidence, CASE WHEN fk > 0 THEN least(greatest(round_even(fk * 0.5, 0), 1), 40) WHEN p >= 0.8 THEN 40 WHEN p >= 0.7 THEN 39 WHEN p >= 0.6 THEN 20 ELSE 1 END::BIGINT AS position FROM z""",
)
def position_sizes(spark, sf_dir):
    s, z = F.col("sequence"), F.col("size")
    p, win, loss, u, one = (s % 100) / 100.0, (z % 9 + 1).cast("double"), (z % 5 + 1).cast("double"), (s % 4) / 10.0, F.lit(1.0)
    fk = X.fractional_kelly_size(p, win, loss, uncertainty=u, coverage=one, entropy=F.lit(0.0), runtime=one, max_size=40)
    rows = V.ticks(spark, sf_dir).select("sequence", X.kelly_size(p, p, win, loss, max_size=40).alias("kelly"), fk.alias("fractional_kelly"), X.confidence_size(p, 1, 40).alias("by_confidence"), p.alias("_p"))
    return rows.withColumn("position", X.position_size(F.lit(True), F.col("fractional_kelly"), F.lit(0.5), F.col("_p"), 1, 40)).drop("_p")


@query("f23_regime_entropy", f"{PRED}, {STRUCT_CTE}, n AS (SELECT sequence, {NORM.format(a='rp0')} AS p FROM sb) SELECT sequence, p[1] AS p_first, -list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))) / ln(4.0) AS entropy FROM n", "p_first entropy")
def regime_entropy(spark, sf_dir):
    rows = policy_rows(spark, sf_dir).withColumn("_n", X.normalised(F.col("regime_probs")))
    return rows.select("sequence", F.get("_n", 0).alias("p_first"), X.entropy(F.col("_n")).alias("entropy"))


@query("f26_feature_hash", """WITH t AS (SELECT event_id, user_id FROM events) SELECT event_id AS sequence, sha256('{"order_id":' || event_id || ',"symbol":' || user_id || '}') AS feature_hash FROM t""")
def feature_hash(spark, sf_dir):
    return V.ticks(spark, sf_dir).select("sequence", X.feature_hash(["symbol", "order_id"]).alias("feature_hash"))


@query("f32_economic_floor", f"{V.TICKS} SELECT sequence, greatest((size % 10) * 1.5, (size % 10) * 1.0 + 2.5)::DOUBLE AS floor_ticks FROM ticks", "floor_ticks")
def economic_floor(spark, sf_dir):
    from tapeloom.operators.labels import economic_floor

    return V.ticks(spark, sf_dir).select("sequence", economic_floor((F.col("size") % 10).cast("double"), 1.5, 1.0, 2.5).alias("floor_ticks"))


SIGNAL_CTE = """gi AS (SELECT *, ['trending', 'ranging', 'volatile'][size % 3 + 1] AS regime, (sequence % 100) / 100.0::DOUBLE AS event_score, size % 11 <> 0 AS has_model FROM pred),
gt AS (SELECT *, CASE regime WHEN 'volatile' THEN 0.75 ELSE 0.60 END::DOUBLE AS et, CASE regime WHEN 'volatile' THEN 0.65 ELSE 0.60 END::DOUBLE AS pt FROM gi),
gd AS (SELECT *, prob_long >= pt AND prob_long > prob_short AS up, prob_short >= pt AND prob_short > prob_long AS dn FROM gt),
sg AS (SELECT *, CASE WHEN event_score >= et AND has_model AND up THEN 0 WHEN event_score >= et AND has_model AND dn THEN 1 ELSE 2 END AS signal, CASE WHEN event_score >= et AND has_model THEN greatest(prob_long, prob_short) ELSE 0 END AS confidence,
  CASE WHEN event_score < et THEN 'event_gate' WHEN NOT has_model THEN 'no_model' WHEN NOT (up OR dn) THEN 'below_confidence_threshold' END AS blocked FROM gd)"""


def signals(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumns({"regime": F.get(F.array(*[F.lit(r) for r in ("trending", "ranging", "volatile")]), (F.col("size") % 3).cast("int")), "event_score": (F.col("sequence") % 100) / 100.0, "has_model": F.col("size") % 11 != 0})
    signal, confidence, blocked = X.gated_signal()
    return rows.withColumns({"signal": signal, "confidence": confidence, "blocked": blocked})


@query("f37_gated_signals", f"{PRED}, {SIGNAL_CTE} SELECT symbol, sequence, signal::BIGINT AS signal, confidence, blocked FROM sg", "confidence")
def gated_signals(spark, sf_dir):
    return signals(spark, sf_dir).select("symbol", "sequence", "signal", "confidence", "blocked")


@query("f37_signal_shares", f"{PRED}, {SIGNAL_CTE} SELECT regime, count(*) AS rows, avg((signal = 0)::INT) AS long_share, avg((signal = 1)::INT) AS short_share, avg((signal = 2)::INT) AS neutral_share FROM sg GROUP BY regime", "long_share short_share neutral_share")
def signal_shares(spark, sf_dir):
    share = lambda v: F.avg((F.col("signal") == v).cast("double"))
    return signals(spark, sf_dir).groupBy("regime").agg(F.count(F.lit(1)).alias("rows"), share(0).alias("long_share"), share(1).alias("short_share"), share(2).alias("neutral_share"))


@query(
    "f12_target_levels",
    f"""{V.TICKS}, i AS (SELECT sequence, price, CASE WHEN sequence % 3 <> 0 THEN price + size END AS ag, CASE WHEN sequence % 4 <> 0 THEN price - size END AS bg, CASE WHEN sequence % 5 <> 0 THEN price - size / 2.0 END AS bw, CASE WHEN sequence % 7 <> 0 THEN price + size / 3.0 END AS aw, (size % 6)::DOUBLE AS st, (size % 80)::DOUBLE AS de FROM ticks),
t AS (SELECT sequence, greatest(CASE WHEN ag - price > 0 THEN (ag - price) * greatest(0.5, 1 - de * 0.01) ELSE 15 END, 7.5) AS long_tp, greatest(least(CASE WHEN price - bw > 0 THEN (price - bw) * greatest(0.3, 1 - st * 0.1) ELSE 7.5 END, 20), 5) AS long_sl,
  greatest(CASE WHEN price - bg > 0 THEN (price - bg) * greatest(0.5, 1 - de * 0.01) ELSE 15 END, 7.5) AS short_tp, greatest(least(CASE WHEN aw - price > 0 THEN (aw - price) * greatest(0.3, 1 - st * 0.1) ELSE 7.5 END, 20), 5) AS short_sl FROM i)
SELECT *, long_tp / long_sl AS long_rr, short_tp / short_sl AS short_rr FROM t""",
    "long_tp long_sl short_tp short_sl long_rr short_rr",
)
def target_levels(spark, sf_dir):
    s, z, p = F.col("sequence"), F.col("size"), F.col("price")
    rows = V.ticks(spark, sf_dir).withColumns(
        {
            "ask_gap_px": F.when(s % 3 != 0, p + z), "bid_gap_px": F.when(s % 4 != 0, p - z), "bid_wall_px": F.when(s % 5 != 0, p - z / 2.0), "ask_wall_px": F.when(s % 7 != 0, p + z / 3.0),
            "bid_wall_strength": (z % 6).cast("double"), "ask_wall_strength": (z % 6).cast("double"), "bid_density": (z % 80).cast("double"), "ask_density": (z % 80).cast("double"),
        }
    )
    return rows.select("sequence", *[c.alias(n) for n, c in X.target_levels(p, 1.0).items()])
