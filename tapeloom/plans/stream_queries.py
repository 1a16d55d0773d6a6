"""Streaming queries, drained over the given events, with SQL that allows for the watermark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import machines as Z
from tapeloom.operators import monitor as M
from tapeloom.plans import views as V
from tapeloom.plans.eval_queries import BASELINE, LOG_CTE, MON
from tapeloom.plans.registry import ORACLES, query
from tapeloom.plans.state_queries import RANGE_SQL, range_signals
from tapeloom.streaming import flows as S

KEY = ["symbol", "ts_event", "sequence"]
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"
SOURCE = "events.parquet"


def events_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/{SOURCE}").schema
    return S.read_parquet_stream(spark, sf_dir, schema, SOURCE)


def ticks_stream(spark, sf_dir):
    """Ticks with TIMESTAMP times, as watermarks need."""
    return V.ticks_of(events_stream(spark, sf_dir)).withColumn("ts_event", F.col("ts_event").cast("timestamp"))


def ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(
    "x1_streaming_bars",
    f"""{V.TICKS} SELECT symbol, date_trunc('hour', ts_event) AS bar_ts, first(price ORDER BY ts_event, sequence) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts_event, sequence) AS close, sum(size)::DOUBLE AS volume, count(*) AS tick_count,
 sum(CASE WHEN side = 'A' THEN size ELSE 0 END)::DOUBLE AS buy_volume, sum(CASE WHEN side = 'B' THEN size ELSE 0 END)::DOUBLE AS sell_volume FROM ticks WHERE action = 'T'
 AND date_trunc('hour', ts_event) + INTERVAL 1 HOUR <= (SELECT max(ts_event) FROM ticks WHERE action = 'T') - INTERVAL 10 MINUTE GROUP BY ALL""",
    "open high low close volume buy_volume sell_volume",
)
def streaming_bars(spark, sf_dir):
    return ntz(S.drain(S.streaming_bars(ticks_stream(spark, sf_dir), "1 hour"), "bars"), "bar_ts")


def gate_columns(ticks):
    s = F.col("sequence")
    wall = F.greatest((s % 8) / 10.0, (s % 9) / 10.0)
    return ticks.select(
        *KEY, F.col("size").cast("double").alias("size"), wall.alias("wall"), (((s * 7) % 31 - 15) / 40.0).alias("obi"), (s % 50).cast("double").alias("cvd"), F.col("price").alias("micro_price"), (s % 13).cast("double").alias("liquidity_density")
    )


@query("x2_streaming_event_gate", ORACLES["r10_event_score"])
def streaming_event_gate(spark, sf_dir):
    return ntz(S.drain(S.run_machine(gate_columns(ticks_stream(spark, sf_dir)), Z.EventScore(frame=20, score_limit=1.0), KEY), "gate"), "ts_event")


@query("x3_streaming_drift", ORACLES["r5_page_hinkley"])
def streaming_drift(spark, sf_dir):
    rows = ticks_stream(spark, sf_dir).select(*KEY, (F.col("size") / 101.0).alias("error"))
    return ntz(S.drain(S.run_machine(rows, Z.PageHinkley(limit=0.8), KEY), "drift"), "ts_event")


@query(
    "x4_streaming_session_totals",
    f"""{V.TICKS} SELECT symbol, ts_event, sequence, sum(price * size) OVER d / sum(size) OVER d AS current_vwap, (sum(CASE WHEN side = 'A' THEN size ELSE -size END) OVER d)::DOUBLE AS session_cvd FROM ticks WINDOW d AS (PARTITION BY symbol, ts_event::DATE ORDER BY ts_event, sequence)""",
    "current_vwap session_cvd",
    digits=5,
)
def streaming_session_totals(spark, sf_dir):
    rows = ticks_stream(spark, sf_dir).select(*KEY, F.unix_date(F.to_date("ts_event")).alias("day"), "price", F.col("size").cast("double").alias("size"), (F.col("side") == "A").alias("is_buy"))
    return ntz(S.drain(S.run_machine(rows, Z.SessionTotals(), KEY), "session"), "ts_event")


@query(
    "x4_streaming_hawkes",
    f"""{V.TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_event, sequence) AS n, epoch_us(ts_event) AS t, (action IN ('A', 'C'))::INT AS ev FROM ticks)
SELECT a.symbol, a.ts_event, a.sequence, 0.1::DOUBLE + coalesce(sum(CASE WHEN b.n > 1 AND b.ev = 1 THEN 0.5 * exp(-0.00001::DOUBLE * (a.t - b.t) / 1e6) ELSE 0 END), 0) AS intensity, a.n > 1 AS counted FROM n a JOIN n b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY a.symbol, a.ts_event, a.sequence, a.n""",
    "intensity",
)
def streaming_hawkes(spark, sf_dir):
    rows = ticks_stream(spark, sf_dir).select(*KEY, F.unix_micros("ts_event").alias("t_us"), F.col("action").isin("A", "C").alias("is_event"))
    return ntz(S.drain(S.run_machine(rows, Z.Hawkes(beta=0.00001), KEY), "hawkes"), "ts_event")


@query(
    "x5_streaming_outcomes",
    f"""{V.TICKS}, c AS (SELECT symbol, date_trunc('day', ts_event) AS st, last(price ORDER BY ts_event, sequence) AS op FROM ticks WHERE action = 'T' GROUP BY ALL)
SELECT t.symbol, t.ts_event, t.sequence, t.price, c.op AS outcome_price, c.op > t.price AS rose FROM ticks t JOIN c ON c.symbol = t.symbol AND c.st = date_trunc('day', t.ts_event) + INTERVAL 1 DAY
WHERE t.action = 'A' AND c.st + INTERVAL 1 DAY <= least((SELECT max(ts_event) FROM ticks WHERE action = 'T'), (SELECT max(ts_event) FROM ticks WHERE action = 'A')) - INTERVAL 10 MINUTE""",
    "price outcome_price",
)
def streaming_outcomes(spark, sf_dir):
    made = ticks_stream(spark, sf_dir).filter("action = 'A'").select(*KEY, "price")
    return ntz(S.drain(S.matched_outcomes(made, ticks_stream(spark, sf_dir), "1 DAY"), "outcomes"), "ts_event")


def log_stream(spark, sf_dir):
    i = F.col("event_id")
    kinds = ["prediction_emitted", "prediction_blocked", "order_filled", "order_rejected", "regime_fallback_used", "data_gap_detected", "shadow_outcome_realized"]
    return events_stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"), F.get(F.array(*[F.lit(k) for k in kinds]), (i % 7).cast("int")).alias("event_type"), ((i % 10) / 10.0).alias("confidence"), (i % 4 != 0).alias("event_gate_passed"),
        (i % 50 == 0).cast("int").alias("missing_features"), ((i % 20) / 20.0).alias("prob_long"), (i % 3).alias("true_bias"), (i % 5 != 0).alias("correct"),
    )


DAILY = MON.replace("SELECT model, count(*)", "SELECT date_trunc('day', ts) AS window_start, count(*)").replace("FROM lg GROUP BY model", "FROM lg GROUP BY 1")
RULES = [r for r in M.ALERT_RULES if r[1] != "latency_p95"]


@query(
    "x6_streaming_alerts",
    f"""WITH {LOG_CTE}, {DAILY}, c AS (SELECT window_start, unnest([{', '.join(f"{{'a': '{a}', 'm': '{m}', 'v': {m}::DOUBLE, 'l': {v}::DOUBLE}}" for a, m, v in RULES)}]) AS u FROM mon2 WHERE window_start + INTERVAL 1 DAY <= {CLOSED})
SELECT window_start, u.a AS alert, u.m AS metric, u.v AS value, u.l AS "limit" FROM c WHERE u.v > u.l""",
    'value "limit"',
)
def streaming_alerts(spark, sf_dir):
    summary = S.windowed_summary(log_stream(spark, sf_dir), "1 day", BASELINE)
    return ntz(S.drain(M.alerts(summary, ["window_start"]), "alerts"), "window_start")


@query(
    "x7_streaming_sessions",
    f"""{V.TICKS}, g AS (SELECT *, coalesce((ts_event - lag(ts_event) OVER w > INTERVAL 12 HOUR)::INT, 0) AS nw FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_event)), r AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ts_event) AS run FROM g),
s AS (SELECT symbol, min(ts_event) AS first_ts, max(ts_event) AS last_ts, count(*) AS rows FROM r GROUP BY symbol, run) SELECT * FROM s WHERE last_ts + INTERVAL 12 HOUR <= {CLOSED}""",
)
def streaming_sessions(spark, sf_dir):
    return ntz(S.drain(S.sessions(ticks_stream(spark, sf_dir), "12 hours"), "sessions"), "first_ts", "last_ts")


@query("x8_streaming_deduplication", f"{V.TICKS} SELECT symbol, ts_event, sequence, price FROM ticks", "price")
def streaming_deduplication(spark, sf_dir):
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("sequence") % 5 == 0, 2).otherwise(0)))
    rows = ticks_stream(spark, sf_dir).select(*KEY, "price", copies.alias("copy")).drop("copy")
    return ntz(S.drain(S.deduplicated(rows, ["symbol", "sequence"]), "distinct"), "ts_event")


@query("x9_streaming_range_filter")
def streaming_range_filter(spark, sf_dir):
    s, z = F.col("sequence"), F.col("size")
    rows = ticks_stream(spark, sf_dir).select(
        *KEY, "price", F.when(F.col("side") == "A", 1).otherwise(-1).alias("signal"), (0.5 + (z % 50) / 100.0).alias("confidence"), (z % 3 == 0).alias("trending"), (z % 5 == 0).alias("near_bottom"), (z % 7 == 0).alias("near_top"),
        (z % 2 == 0).alias("in_middle"), ((z % 20) / 20.0).alias("range_place"), F.lit(10.0).alias("volatility"), (s % 4).cast("double").alias("reversal"), (s % 3 - 1).cast("int").alias("reversal_direction"), F.lit(False).alias("broke_out"),
    )
    return ntz(S.drain(S.run_machine(rows, Z.RangeFilter(needed=2, window=6), KEY), "range"), "ts_event")


@query("x9_streaming_market_state", RANGE_SQL)
def streaming_market_state(spark, sf_dir):
    rows = range_signals(ticks_stream(spark, sf_dir))
    return ntz(S.drain(S.run_machine(rows, Z.RangeFilter(needed=2, window=6), KEY), "market"), "ts_event")


# ------------------------------------------------------- whole streams, in batches that overlap in time
#: Rows of an arrival lie up to so far before the newest one of the arrivals before it.
OVERLAP = "10 days"
ARRIVALS = 4


def arriving(spark, sf_dir):
    """Events as four arrivals of a stream. Every arrival has rows that are days older than some before it."""
    events = V.events(spark, sf_dir)
    folder = S.shared_path(spark, "arrivals")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(at).alias("low"), (F.max(at) - F.min(at) + 1).alias("wide")).first()
    if span["low"] is None:
        span = {"low": 0, "wide": 1}
    place = (at - F.lit(span["low"])) * ARRIVALS / F.lit(span["wide"]) + (F.col("event_id") % 5 - 2) * 0.25
    number = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(ARRIVALS - 1))
    events.limit(0).write.parquet(folder)
    arrivals = [lambda k=k: events.filter(number == k).write.mode("append").parquet(folder) for k in range(ARRIVALS)]
    stream = spark.readStream.schema(events.schema).parquet(folder)
    ticks = V.ticks_of(stream).withColumn("ts_event", F.col("ts_event").cast("timestamp"))
    closing = S.Closing(spark)
    return ticks, [*arrivals, closing.write], closing


def in_order(spark, sf_dir, rows, machine, name):
    ticks, arrivals, closing = arriving(spark, sf_dir)
    return ntz(S.drain(S.run_ordered(rows(ticks), machine, KEY, late=OVERLAP, closing=closing), name, arrivals=arrivals), "ts_event")


@query("x2_ordered_event_gate", ORACLES["r10_event_score"])
def ordered_event_gate(spark, sf_dir):
    return in_order(spark, sf_dir, gate_columns, Z.EventScore(frame=20, score_limit=1.0), "gate")


@query("x3_ordered_drift", ORACLES["r5_page_hinkley"])
def ordered_drift(spark, sf_dir):
    return in_order(spark, sf_dir, lambda t: t.select(*KEY, (F.col("size") / 101.0).alias("error")), Z.PageHinkley(limit=0.8), "drift")


@query("x4_ordered_session_totals", ORACLES["x4_streaming_session_totals"], digits=5)
def ordered_session_totals(spark, sf_dir):
    columns = lambda t: t.select(*KEY, F.unix_date(F.to_date("ts_event")).alias("day"), "price", F.col("size").cast("double").alias("size"), (F.col("side") == "A").alias("is_buy"))
    return in_order(spark, sf_dir, columns, Z.SessionTotals(), "session")


@query("x9_ordered_market_state", RANGE_SQL)
def ordered_market_state(spark, sf_dir):
    return in_order(spark, sf_dir, range_signals, Z.RangeFilter(needed=2, window=6), "market")


def uncut(name):
    """The SQL of a query without its cut at the watermark."""
    sql = ORACLES[name]
    for cut in (
        "\n AND date_trunc('hour', ts_event) + INTERVAL 1 HOUR <= (SELECT max(ts_event) FROM ticks WHERE action = 'T') - INTERVAL 10 MINUTE",
        f" WHERE window_start + INTERVAL 1 DAY <= {CLOSED}",
        f" WHERE last_ts + INTERVAL 12 HOUR <= {CLOSED}",
    ):
        sql = sql.replace(cut, "")
    return sql


@query("x1_whole_stream_bars", uncut("x1_streaming_bars"))
def whole_stream_bars(spark, sf_dir):
    """All bars, the last ones sent at the end of the input, from arrivals that overlap."""
    ticks, arrivals, closing = arriving(spark, sf_dir)
    return ntz(S.drain(S.streaming_bars(ticks, "1 hour", closing, OVERLAP), "bars", arrivals=arrivals), "bar_ts")


@query("x6_whole_stream_alerts", uncut("x6_streaming_alerts"))
def whole_stream_alerts(spark, sf_dir):
    closing = S.Closing(spark)
    summary = S.windowed_summary(log_stream(spark, sf_dir), "1 day", BASELINE, closing)
    return ntz(S.drain(M.alerts(summary, ["window_start"]), "alerts", arrivals=[lambda: None, closing.write]), "window_start")


@query("x7_whole_stream_sessions", uncut("x7_streaming_sessions"))
def whole_stream_sessions(spark, sf_dir):
    closing = S.Closing(spark)
    return ntz(S.drain(S.sessions(ticks_stream(spark, sf_dir), "12 hours", closing), "sessions", arrivals=[lambda: None, closing.write]), "first_ts", "last_ts")
