"""Queries over cleaning, audit and sampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.market import is_trade
from tapeloom.operators import audit as A
from tapeloom.operators import clean as C
from tapeloom.operators.bars import with_bar
from tapeloom.plans import views as V
from tapeloom.plans.registry import query

RAW = f"WITH {V.TICKS_CTE}, {V.RAW_CTE}\n"
RAWB = f"WITH {V.BOOK_CTE}, {V.RAW_BOOK_CTE}\n"
BY = "PARTITION BY symbol ORDER BY ts_event, sequence"
ALL = "symbol, ts_event, ts_recv, sequence, action, side, price, size, order_id"


@query(
    "p1_coerce_time",
    f"{RAW} SELECT sequence, ingest, coalesce(try_cast(CASE WHEN sequence % 7 = 0 THEN 'bad' ELSE ts_event::VARCHAR END AS TIMESTAMP), ts_recv) AS ts_event FROM raw",
)
def coerce_time(spark, sf_dir):
    rows = V.raw_ticks(spark, sf_dir)
    text = F.when(F.col("sequence") % 7 == 0, "bad").otherwise(F.col("ts_event").cast("string"))
    return C.coerce_time(rows.withColumn("ts_event", text)).select("sequence", "ingest", "ts_event")


@query("p2_basic_clean", f"{RAW} SELECT DISTINCT {ALL} FROM raw WHERE ts_event IS NOT NULL AND NOT (upper(trim(action)) = 'T' AND coalesce(price <= 0, false))", "price")
def basic_clean(spark, sf_dir):
    return C.basic_clean(V.raw_ticks(spark, sf_dir).drop("ingest"), drop_duplicates=True, strict_trade_prices=True)


@query(
    "p2_basic_report",
    f"""{RAW}, g AS (SELECT {ALL}, count(*) AS n FROM raw GROUP BY ALL)
SELECT sum(n)::BIGINT AS input_rows, sum(CASE WHEN ts_event IS NULL THEN n ELSE 0 END)::BIGINT AS invalid_timestamp_rows, sum(CASE WHEN ts_event IS NOT NULL THEN n - 1 ELSE 0 END)::BIGINT AS exact_duplicate_rows,
 sum(CASE WHEN ts_event IS NOT NULL AND (price IS NULL OR price <= 0) THEN n ELSE 0 END)::BIGINT AS invalid_price_rows FROM g""",
)
def basic_report(spark, sf_dir):
    return C.basic_report(V.raw_ticks(spark, sf_dir).drop("ingest"))


@query(
    "p3_normalise",
    f"""{RAW}, n AS (SELECT * REPLACE (upper(trim(action)) AS action, CASE WHEN upper(side) = 'N' THEN 'A' ELSE upper(side) END AS side) FROM raw)
SELECT ingest, {ALL} FROM n WHERE action <> 'R' AND price > 0 AND size > 0""",
    "price",
)
def normalise(spark, sf_dir):
    return C.normalise(V.raw_ticks(spark, sf_dir), none_side_is_buy=True)


@query(
    "p4_clip_book_outliers",
    f"""{RAWB}, lv AS (SELECT symbol, sequence, u.i AS i, bid_px[u.i] AS px FROM raw_book, (SELECT unnest(range(1, 11)) AS i) u),
q AS (SELECT symbol, i, quantile_cont(px, 0.25) AS q1, quantile_cont(px, 0.75) AS q3, count(*) AS n FROM lv WHERE px > 0 GROUP BY ALL)
SELECT lv.symbol, lv.sequence, (lv.i - 1)::BIGINT AS level, CASE WHEN n > 10 AND q3 - q1 > 0 AND px > q3 + 5 * (q3 - q1) THEN 0 ELSE px END AS bid_px FROM lv LEFT JOIN q USING (symbol, i)""",
    "bid_px",
)
def clip_book(spark, sf_dir):
    out = C.clip_book_outliers(V.raw_book(spark, sf_dir))
    return out.select("symbol", "sequence", F.posexplode("bid_px").alias("level", "bid_px"))


@query("p5_drop_invalid_orders", f"{RAW} SELECT {ALL}, ingest FROM raw WHERE upper(trim(action)) <> 'R' AND price > 0 AND size > 0", "price")
def drop_invalid_orders(spark, sf_dir):
    return C.drop_invalid_orders(V.raw_ticks(spark, sf_dir))


@query("p6_exact_duplicates", f"{RAW} SELECT {ALL}, max(ingest) AS ingest FROM raw GROUP BY ALL", "price")
def exact_duplicates(spark, sf_dir):
    return C.drop_exact_duplicates(V.raw_ticks(spark, sf_dir))


KEEP = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts_event, action, side, price, size, order_id ORDER BY ingest DESC) AS k FROM {src}) WHERE k = 1"


@query("p7_duplicate_keys", f"{RAW} {KEEP.format(cols=ALL + ', ingest', src='raw')}", "price")
def duplicate_keys(spark, sf_dir):
    return C.keep_last(V.raw_ticks(spark, sf_dir), ["symbol", *C.MBO_KEYS])


MEDIAN = "md AS (SELECT symbol, quantile_cont(price, 0.5) AS m FROM {src} WHERE price > 0 GROUP BY symbol)"


@query("p8_price_outliers", f"{RAW}, {MEDIAN.format(src='raw')} SELECT {ALL}, ingest FROM raw JOIN md USING (symbol) WHERE price BETWEEN m / 5 AND m * 5", "price")
def price_outliers(spark, sf_dir):
    return C.drop_price_outliers(V.raw_ticks(spark, sf_dir))


SPIKE = """CASE WHEN price > 0 AND a > 0 AND b > 0 THEN abs(price - a) / a > {s} AND abs(price - b) / b > {s} AND abs(b - a) / a <= {s} / 2 ELSE false END"""


@query(
    "p9_isolated_spikes",
    f"""{V.TICKS}, x AS (SELECT symbol, ts_event, sequence, CASE WHEN sequence % 50 = 8 THEN price * 1.5::DOUBLE ELSE price END AS price FROM ticks),
y AS (SELECT *, lag(price) OVER w AS a, lead(price) OVER w AS b FROM x WINDOW w AS ({BY})) SELECT symbol, ts_event, sequence, price, coalesce({SPIKE.format(s='0.05::DOUBLE')}, false) AS is_spike FROM y""",
    "price",
)
def isolated_spikes(spark, sf_dir):
    rows = V.ticks(spark, sf_dir).select("symbol", "ts_event", "sequence", F.when(F.col("sequence") % 50 == 8, F.col("price") * 1.5).otherwise(F.col("price")).alias("price"))
    return C.mark_spikes(rows)


BAD = {
    "missing_or_nonpositive_bbo": "NOT (bid_px[1] > 0 AND ask_px[1] > 0)",
    "crossed_book": "(bid_px[1] > 0 AND ask_px[1] > 0 AND bid_px[1] > ask_px[1])",
    "spread_lt_tick": "(bid_px[1] > 0 AND ask_px[1] > 0 AND ask_px[1] - bid_px[1] + 0.01::DOUBLE * 1e-6 < 0.01::DOUBLE)",
    "negative_size": "(len(list_filter(bid_sz, lambda x: x < 0)) + len(list_filter(ask_sz, lambda x: x < 0)) > 0)",
}


@query(
    "p10_reject_invalid_books",
    f"{RAWB} SELECT symbol, ts_event, sequence, bid_px[1] AS best_bid, ask_px[1] AS best_ask, list_sum(list_transform(ask_sz, lambda x: coalesce(x, 0))) AS ask_depth FROM raw_book WHERE NOT ({' OR '.join(BAD.values())})",
    "best_bid best_ask ask_depth",
)
def reject_invalid_books(spark, sf_dir):
    out = C.reject_invalid_books(V.raw_book(spark, sf_dir), 0.01)
    return out.select("symbol", "ts_event", "sequence", F.get("bid_px", 0).alias("best_bid"), F.get("ask_px", 0).alias("best_ask"), F.aggregate("ask_sz", F.lit(0.0), lambda a, x: a + x).alias("ask_depth"))


@query(
    "p10_p26_book_report",
    f"""{RAWB} SELECT count(*) AS input_rows, {', '.join(f'sum(({c})::INT)::BIGINT AS {n}_rows' for n, c in BAD.items())},
 sum(len(list_filter(ask_sz, lambda x: x IS NULL)))::BIGINT AS null_size_values_filled_zero, sum((({' OR '.join(BAD.values())}))::INT)::BIGINT AS rows_rejected, sum((NOT ({' OR '.join(BAD.values())}))::INT)::BIGINT AS output_rows FROM raw_book""",
)
def book_report(spark, sf_dir):
    return C.invalid_book_report(V.raw_book(spark, sf_dir), 0.01)


@query(
    "p11_p12_clean_books",
    f"""{RAWB}, r AS (SELECT symbol, ts_event, sequence, CASE WHEN bid_px[1] > 0 THEN bid_px[1] ELSE 0 END AS b, CASE WHEN ask_px[1] > 0 THEN ask_px[1] ELSE 0 END AS a,
  list_sum(list_transform(bid_sz, lambda s: greatest(coalesce(s, 0), 0))) AS bid_depth FROM raw_book)
SELECT symbol, ts_event, sequence, (a + b) / 2 AS price, bid_depth FROM r WHERE b > 0 AND a > 0 AND a > b AND a - b <= 0.01::DOUBLE * 20""",
    "price bid_depth",
)
def clean_books(spark, sf_dir):
    out = C.clean_books(V.raw_book(spark, sf_dir), 0.01)
    return out.select("symbol", "ts_event", "sequence", "price", F.aggregate("bid_sz", F.lit(0.0), lambda a, x: a + x).alias("bid_depth"))


@query("p13_infer_tick", f"{RAWB} SELECT quantile_cont(ask_px[1] - bid_px[1], 0.01) AS tick_size FROM raw_book WHERE ask_px[1] - bid_px[1] > 0", "tick_size")
def infer_tick(spark, sf_dir):
    return C.infer_tick(V.raw_book(spark, sf_dir))


START, END = "2024-01-05 00:00:00", "2024-01-20 00:00:00"


@query("p15_range_filter", f"{V.TICKS} SELECT symbol, ts_event, sequence, price FROM ticks WHERE ts_event >= TIMESTAMP '{START}' AND ts_event < TIMESTAMP '{END}' AND symbol = 7", "price")
def range_filter(spark, sf_dir):
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return C.in_range(V.ticks(spark, sf_dir), stamp(START), stamp(END), 7, end_inclusive=False).select("symbol", "ts_event", "sequence", "price")


@query(
    "p15_range_report",
    f"""{V.TICKS}, c AS (SELECT ts_event < TIMESTAMP '{START}' AS e, ts_event > TIMESTAMP '{END}' AS l, symbol <> 7 AS o FROM ticks)
SELECT sum(e::INT)::BIGINT AS rows_dropped_start_filter, sum((NOT e AND l)::INT)::BIGINT AS rows_dropped_end_filter, sum((NOT e AND NOT l AND o)::INT)::BIGINT AS rows_dropped_symbol_filter, sum((NOT e AND NOT l AND NOT o)::INT)::BIGINT AS rows_kept FROM c""",
)
def range_report(spark, sf_dir):
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return C.range_report(V.ticks(spark, sf_dir), stamp(START), stamp(END), 7)


ROOTS, MONTHS = ["ES", "NQ", "6E"], ["H", "M", "U", "Z"]
CONTRACT_SQL = """contracts AS (SELECT *, CASE WHEN symbol % 11 = 0 THEN 'x-' || symbol ELSE ['es', 'NQ', '6E'][symbol % 3 + 1] || ['H', 'M', 'U', 'Z'][symbol % 4 + 1] || (symbol % 5 + 2) END AS contract_symbol FROM ticks),
parsed AS (SELECT *, nullif(regexp_extract(upper(trim(contract_symbol)), '^(.+?)([FGHJKMNQUVXZ])([0-9]{1,4})$', 1), '') AS contract_root,
  nullif(regexp_extract(upper(trim(contract_symbol)), '^(.+?)([FGHJKMNQUVXZ])([0-9]{1,4})$', 2), '') AS contract_month_code,
  nullif(regexp_extract(upper(trim(contract_symbol)), '^(.+?)([FGHJKMNQUVXZ])([0-9]{1,4})$', 3), '') AS contract_year_suffix FROM contracts)"""


def contracts(spark, sf_dir):
    s = F.col("symbol")
    name = F.concat(F.get(F.array(*[F.lit(r) for r in ("es", "NQ", "6E")]), (s % 3).cast("int")), F.get(F.array(*[F.lit(m) for m in MONTHS]), (s % 4).cast("int")), (s % 5 + 2).cast("string"))
    return V.ticks(spark, sf_dir).withColumn("contract_symbol", F.when(s % 11 == 0, F.concat(F.lit("x-"), s.cast("string"))).otherwise(name))


@query("p16_contract_filter", f"{V.TICKS}, {CONTRACT_SQL} SELECT sequence, contract_symbol, contract_root, contract_month_code, contract_year_suffix FROM parsed WHERE contract_root = 'ES'")
def contract_filter(spark, sf_dir):
    return C.contract_filter(contracts(spark, sf_dir), "ES").select("sequence", "contract_symbol", "contract_root", "contract_month_code", "contract_year_suffix")


@query("p17_continuous", f"{V.TICKS}, {CONTRACT_SQL} SELECT 'NQ' AS symbol, sequence, contract_symbol, contract_month_code FROM parsed WHERE contract_root = 'NQ'")
def continuous(spark, sf_dir):
    rows = contracts(spark, sf_dir).filter(F.col("contract_symbol").startswith("NQ"))
    return C.continuous(rows, "NQ").select("symbol", "sequence", "contract_symbol", "contract_month_code")


@query("p17_all_roots", f"{V.TICKS}, {CONTRACT_SQL} SELECT symbol AS feed, contract_root AS symbol, sequence, contract_symbol, contract_month_code FROM parsed")
def continuous_roots(spark, sf_dir):
    """Every row under its contract's root; each feed must hold one root only."""
    rows = contracts(spark, sf_dir).withColumn("feed", F.col("symbol"))
    return C.continuous_roots(rows, "feed").select("feed", "symbol", "sequence", "contract_symbol", "contract_month_code")


@query(
    "p18_front_contract",
    f"""{V.TICKS}, {CONTRACT_SQL}, c AS (SELECT contract_symbol, contract_root, contract_month_code AS mc, contract_year_suffix::INT AS y, count(*) AS rows FROM parsed WHERE contract_root IS NOT NULL GROUP BY ALL),
r AS (SELECT contract_root FROM c GROUP BY contract_root ORDER BY sum(rows) DESC, contract_root DESC LIMIT 1)
SELECT contract_symbol, contract_root, rows FROM c WHERE contract_root = (SELECT * FROM r) AND mc = 'M'
ORDER BY list_min(list_transform([2000, 2010, 2020, 2030, 2040], lambda b: abs(b + y - 2024))), rows DESC, contract_symbol LIMIT 1""",
)
def front_contract(spark, sf_dir):
    return C.front_contract(contracts(spark, sf_dir), "M", 2024)


@query(
    "p19_overlap",
    f"""{V.BOOK}, b AS (SELECT greatest((SELECT min(ts_event) FROM ticks WHERE action = 'T'), (SELECT min(ts_event) FROM book)) AS s, least((SELECT max(ts_event) FROM ticks WHERE action = 'T'), (SELECT max(ts_event) FROM book)) AS e)
SELECT symbol, ts_event, sequence FROM ticks, b WHERE action = 'T' AND ts_event BETWEEN s AND e""",
)
def overlap(spark, sf_dir):
    trades = V.ticks(spark, sf_dir).filter(is_trade()).select("symbol", "ts_event", "sequence")
    return C.trim_to_overlap(trades, C.overlap_bounds(trades, V.book(spark, sf_dir)))


LABELS_SQL = "flagged AS (SELECT symbol, ts_event, sequence, sequence % 3 AS bias_label, (sequence % 4 = 0)::BIGINT AS event_flag, 0::BIGINT AS train_event_flag, (sequence % 10) / 10.0::DOUBLE AS mbp_bar_coverage FROM ticks)"


def flagged(spark, sf_dir):
    s = F.col("sequence")
    return V.ticks(spark, sf_dir).select("symbol", "ts_event", "sequence", (s % 3).alias("bias_label"), (s % 4 == 0).cast("long").alias("event_flag"), F.lit(0).cast("long").alias("train_event_flag"), ((s % 10) / 10.0).alias("mbp_bar_coverage"))


@query("p20_training_view", f"{V.TICKS}, {LABELS_SQL} SELECT * FROM flagged WHERE mbp_bar_coverage >= 0.3::DOUBLE AND bias_label IN (0, 1) AND event_flag = 1", "mbp_bar_coverage")
def training_view(spark, sf_dir):
    return C.training_view(flagged(spark, sf_dir))


@query("p28_directional_rows", f"{V.TICKS}, {LABELS_SQL} SELECT symbol, sequence, bias_label FROM flagged WHERE bias_label IN (0, 1) AND event_flag = 1")
def directional_rows(spark, sf_dir):
    return C.training_view(flagged(spark, sf_dir).drop("mbp_bar_coverage")).select("symbol", "sequence", "bias_label")


RARE_SQL = "cls AS (SELECT symbol, sequence, CASE WHEN sequence % 500 = 0 THEN 3 ELSE sequence % 3 END AS label FROM ticks), cnt AS (SELECT label, count(*) AS n FROM cls GROUP BY label)"


def _classes(spark, sf_dir):
    return V.ticks(spark, sf_dir).select("symbol", "sequence", F.when(F.col("sequence") % 500 == 0, F.lit(3)).otherwise(F.col("sequence") % 3).alias("label"))


@query("p21_rare_classes", f"{V.TICKS}, {RARE_SQL} SELECT symbol, sequence, label FROM cls JOIN cnt USING (label) WHERE n >= 100")
def rare_classes(spark, sf_dir):
    return C.handle_rare(_classes(spark, sf_dir), "label", 100)


@query("p21_rare_merged", f"{V.TICKS}, {RARE_SQL} SELECT symbol, sequence, CASE WHEN n < 100 THEN (SELECT label FROM cnt ORDER BY n DESC, label LIMIT 1) ELSE label END AS label FROM cls JOIN cnt USING (label)")
def rare_merged(spark, sf_dir):
    return C.handle_rare(_classes(spark, sf_dir), "label", 100, strategy="merge")


@query(
    "p23_stratified_sample",
    f"""{V.TICKS}, n AS (SELECT *, row_number() OVER ({BY}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM ticks),
p AS (SELECT s.symbol, round_even(i * (s.n - 1) / 19.0::DOUBLE, 0)::BIGINT AS pos FROM (SELECT symbol, any_value(n) AS n FROM n GROUP BY symbol) s, (SELECT unnest(range(0, 20)) AS i))
SELECT symbol, ts_event, sequence FROM n WHERE n <= 20 OR EXISTS (SELECT 1 FROM p WHERE p.symbol = n.symbol AND p.pos = n.pos)""",
)
def stratified_sample(spark, sf_dir):
    return C.stratified_sample(V.ticks(spark, sf_dir).select("symbol", "ts_event", "sequence"), 20)


@query(
    "p24_stride_expand",
    f"""{V.TICKS}, n AS (SELECT *, row_number() OVER ({BY}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM ticks), s AS (SELECT *, (n <= 7 OR pos % 7 = 0 OR pos = n - 1) AS sampled FROM n)
SELECT symbol, ts_event, sequence, sampled, last_value(CASE WHEN sampled THEN sequence % 3 END IGNORE NULLS) OVER ({BY}) AS label_expanded FROM s""",
)
def stride_expand(spark, sf_dir):
    rows = V.ticks(spark, sf_dir).select("symbol", "ts_event", "sequence", (F.col("sequence") % 3).alias("label"))
    return C.expand_sample(C.stride_sample(rows, 7), "label").drop("label")


@query("p25_fill_features", f"{RAW} SELECT ingest, coalesce(price, 0) AS price, size::DOUBLE AS size, 0.0::DOUBLE AS spread FROM raw", "price size spread")
def fill_features(spark, sf_dir):
    return C.fill_features(V.raw_ticks(spark, sf_dir).withColumn("price", F.coalesce("price", F.lit(float("inf")))), ["price", "size", "spread"]).select("ingest", "price", "size", "spread")


@query("p27_ensure_price", f"{V.TICKS} SELECT sequence, price AS close, price FROM ticks", "close price")
def ensure_price(spark, sf_dir):
    return C.ensure_price(V.ticks(spark, sf_dir).select("sequence", F.col("price").alias("close"), F.lit(0.0).alias("price")))


@query(
    "j15_expand_compact",
    f"""{V.TICKS}, c AS (SELECT *, sequence % 3 = 0 AS covered FROM ticks), d AS (SELECT symbol, sequence, row_number() OVER ({BY}) * 1.5 AS score FROM c WHERE covered)
SELECT c.symbol, c.sequence, c.covered, coalesce(d.score, 0)::DOUBLE AS score FROM c LEFT JOIN d USING (symbol, sequence)""",
    "score",
)
def expand_compact(spark, sf_dir):
    from tapeloom.operators.ordered import numbered

    rows = V.ticks(spark, sf_dir).select("symbol", "ts_event", "sequence", (F.col("sequence") % 3 == 0).alias("covered"))
    compact = numbered(rows.filter("covered"), "position").select("symbol", "position", ((F.col("position") + 1) * 1.5).alias("score"))
    return C.expand_compact(rows, "covered", compact, "score").select("symbol", "sequence", "covered", "score")


@query(
    "o7_context_slice",
    f"""{V.TICKS}, n AS (SELECT symbol, ts_event, sequence, row_number() OVER ({BY}) AS pos, ts_event BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AS in_range FROM ticks),
e AS (SELECT symbol, min(pos) AS a, max(pos) AS b FROM n WHERE in_range GROUP BY symbol) SELECT symbol, ts_event, sequence, in_range FROM n JOIN e USING (symbol) WHERE pos BETWEEN a - 3 AND b + 2""",
)
def context_slice(spark, sf_dir):
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return C.context_slice(V.ticks(spark, sf_dir).select("symbol", "ts_event", "sequence"), stamp(START), stamp(END), 3, 2)


INVALID = "raw WHERE upper(trim(action)) <> 'R' AND price > 0 AND size > 0 AND ts_event IS NOT NULL"
CLEAN_SQL = f"""v AS (SELECT * FROM {INVALID}), d AS (SELECT {ALL}, max(ingest) AS ingest FROM v GROUP BY ALL), {MEDIAN.format(src='d')},
o AS (SELECT d.* FROM d JOIN md USING (symbol) WHERE price BETWEEN m / 5 AND m * 5), k AS ({KEEP.format(cols='*', src='o')}),
s AS (SELECT *, lag(price) OVER w AS a, lead(price) OVER w AS b FROM k WINDOW w AS ({BY})), cleaned AS (SELECT * FROM s WHERE NOT coalesce({SPIKE.format(s='0.05::DOUBLE')}, false))"""


@query("a35_before_after", f"""{RAW}, {CLEAN_SQL}, x AS (SELECT symbol, count(*) AS raw_rows, min(price) AS raw_min_price, max(price) AS raw_max_price FROM raw GROUP BY symbol),
y AS (SELECT symbol, count(*) AS clean_rows, min(price) AS clean_min_price, max(price) AS clean_max_price FROM cleaned GROUP BY symbol)
SELECT symbol, raw_rows, raw_min_price, raw_max_price, coalesce(clean_rows, 0) AS clean_rows, clean_min_price, clean_max_price, coalesce(clean_rows, 0)::DOUBLE / raw_rows AS kept_share FROM x FULL JOIN y USING (symbol)""",
    "raw_min_price raw_max_price clean_min_price clean_max_price kept_share",
)
def before_after(spark, sf_dir):
    raw = V.raw_ticks(spark, sf_dir)
    return A.before_after(raw, C.clean_orders(raw.filter("ts_event is not null")))


@query(
    "p26_stage_report",
    f"""{RAW}, {CLEAN_SQL}, c AS (SELECT 0 AS stage_no, 'raw' AS stage, (SELECT count(*) FROM raw) AS after_rows UNION ALL SELECT 1, 'valid', (SELECT count(*) FROM v) UNION ALL SELECT 2, 'distinct', (SELECT count(*) FROM d)
 UNION ALL SELECT 3, 'in_price_range', (SELECT count(*) FROM o) UNION ALL SELECT 4, 'one_per_key', (SELECT count(*) FROM k) UNION ALL SELECT 5, 'no_spikes', (SELECT count(*) FROM cleaned))
SELECT stage_no::BIGINT AS stage_no, stage, after_rows, coalesce(lag(after_rows) OVER (ORDER BY stage_no), after_rows) AS before_rows, coalesce(lag(after_rows) OVER (ORDER BY stage_no), after_rows) - after_rows AS dropped_rows FROM c""",
)
def stage_report(spark, sf_dir):
    raw = V.raw_ticks(spark, sf_dir)
    valid = C.drop_invalid_orders(raw.filter("ts_event is not null"))
    distinct = C.drop_exact_duplicates(valid)
    ranged = C.drop_price_outliers(distinct)
    keyed = C.keep_last(ranged, ["symbol", *C.MBO_KEYS])
    return C.stage_report({"raw": raw, "valid": valid, "distinct": distinct, "in_price_range": ranged, "one_per_key": keyed, "no_spikes": C.drop_spikes(keyed)})


STEPS = "st AS (SELECT *, epoch_us(ts_event) - lag(epoch_us(ts_event)) OVER w AS gap_us, lag(price) OVER w AS pp, lag(ts_event) OVER w AS prev_ts FROM raw WHERE ts_event IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ingest))"


INTEGRITY_SQL = f"""{RAW}, {STEPS}, t AS (SELECT symbol, count(*) AS timed_rows, sum((coalesce(gap_us < 0, false))::INT)::BIGINT AS non_monotonic_ts_steps, sum((coalesce(gap_us > 3600000000, false))::INT)::BIGINT AS gap_rows,
  greatest(max(gap_us), 0) / 1000.0 AS max_gap_ms, sum((coalesce(abs(price / nullif(pp, 0) - 1) > 0.01, false))::INT)::BIGINT AS price_jump_rows, min(ts_event) AS first_ts, max(ts_event) AS last_ts,
  count(*) - count(DISTINCT ts_event) AS duplicate_ts_rows FROM st GROUP BY symbol),
w AS (SELECT symbol, count(*) AS rows, sum((ts_event IS NULL)::INT)::BIGINT AS missing_ts_rows, sum((price IS NULL)::INT)::BIGINT AS price_missing_rows, sum((coalesce(price <= 0, false))::INT)::BIGINT AS price_nonpositive_rows,
  sum((size IS NULL)::INT)::BIGINT AS size_missing_rows, sum((size < 0)::INT)::BIGINT AS size_negative_rows, sum((size = 0)::INT)::BIGINT AS size_zero_rows FROM raw GROUP BY symbol)
SELECT * FROM w LEFT JOIN t USING (symbol)"""


@query("a17_integrity", INTEGRITY_SQL, "max_gap_ms", digits=3)
def integrity(spark, sf_dir):
    return A.integrity(V.raw_ticks(spark, sf_dir), gap_seconds=3600)


@query("a18_merged_integrity", INTEGRITY_SQL, "max_gap_ms", digits=3)
def merged_integrity(spark, sf_dir):
    """Eight uneven parts, summed up each on its own (the third has no rows), merged by fours and then to one."""
    rows = V.raw_ticks(spark, sf_dir)
    at = F.col("ingest")
    part = F.when(at < 40, 0).when(at < 700, 1).when(at < 5_000, 3).otherwise(F.least(F.expr("4 + ingest div 6000"), F.lit(7)))
    rows = rows.withColumn("part", part.cast("long"))
    parts = A.integrity_parts(rows, "part", gap_seconds=3600)
    halves = A.merged_parts(parts, F.expr("part div 4"), gap_seconds=3600)
    total = A.merged_parts(halves, F.lit(0).cast("long"), gap_seconds=3600)
    return A.integrity_report(total, A.merged_times(A.time_counts(rows)))


@query(
    "a20_a33_market_issues",
    f"""{RAW}, {STEPS}, i AS (SELECT 'invalid_ts_event' AS code, 'critical' AS severity, (SELECT count(*) FROM raw WHERE ts_event IS NULL) AS rows
 UNION ALL SELECT 'invalid_prices', 'critical', (SELECT count(*) FROM raw WHERE price IS NULL OR price <= 0) UNION ALL SELECT 'ts_event_not_monotonic', 'critical', (SELECT count(*) FROM st WHERE gap_us < 0)
 UNION ALL SELECT 'duplicate_ts_event', 'medium', (SELECT (sum(n) - count(*))::BIGINT FROM (SELECT count(*) AS n FROM raw GROUP BY symbol, ts_event))) SELECT * FROM i WHERE rows > 0""",
)
def market_issues(spark, sf_dir):
    return A.validate_market(V.raw_ticks(spark, sf_dir), 0.01)


@query(
    "a20_book_issues",
    f"""{RAWB}, i AS (SELECT 'missing_best_bid_ask' AS code, 'high' AS severity, (SELECT count(*) FROM raw_book WHERE NOT (bid_px[1] > 0 AND ask_px[1] > 0)) AS rows
 UNION ALL SELECT 'crossed_book', 'critical', (SELECT count(*) FROM raw_book WHERE bid_px[1] > 0 AND bid_px[1] > ask_px[1]) UNION ALL SELECT 'locked_book', 'medium', (SELECT count(*) FROM raw_book WHERE bid_px[1] > 0 AND bid_px[1] = ask_px[1])
 UNION ALL SELECT 'very_wide_spread_gt_20_ticks', 'medium', (SELECT count(*) FROM raw_book WHERE bid_px[1] > 0 AND (ask_px[1] - bid_px[1]) / 0.01::DOUBLE > 20)) SELECT * FROM i WHERE rows > 0""",
)
def book_issues(spark, sf_dir):
    rows = V.raw_book(spark, sf_dir).withColumns({"price": F.get("ask_px", 0), "ingest": F.col("sequence")})
    return A.validate_market(rows, 0.01)


@query("a19_monthly_rows", f"{RAW} SELECT strftime(ts_event, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT symbol) AS symbols, sum((price IS NULL)::INT)::BIGINT AS missing_price, 0::BIGINT AS missing_side FROM raw GROUP BY 1")
def monthly_rows(spark, sf_dir):
    return A.monthly_rows(V.raw_ticks(spark, sf_dir))


@query("a19_missing_values", f"{RAW}, s AS (SELECT count(*) AS n, count(ts_event) AS t, count(price) AS p, count(size) AS z FROM raw) SELECT u.c AS \"column\", n - u.v AS missing, (n - u.v)::DOUBLE / n AS missing_share FROM s, unnest([{{'c': 'ts_event', 'v': t}}, {{'c': 'price', 'v': p}}, {{'c': 'size', 'v': z}}]) AS x(u)", "missing_share")
def missing_values(spark, sf_dir):
    return A.missing_values(V.raw_ticks(spark, sf_dir), ["ts_event", "price", "size"])


@query("a19_active_columns", f"{RAW}, s AS (SELECT strftime(ts_event, '%Y-%m') AS month, count(price) AS p, count(size) AS z FROM raw GROUP BY 1) SELECT month, u.c AS \"column\", u.v AS \"values\" FROM s, unnest([{{'c': 'price', 'v': p}}, {{'c': 'size', 'v': z}}]) AS x(u) WHERE u.v > 0")
def active_columns(spark, sf_dir):
    return A.active_columns(V.raw_ticks(spark, sf_dir), ["price", "size"])


@query("a19_spread_stats", f"{RAWB}, s AS (SELECT ask_px[1] - bid_px[1] AS spread FROM raw_book) SELECT count(*) AS rows, min(spread) AS spread_min, avg(spread) AS spread_mean, max(spread) AS spread_max, quantile_cont(spread, 0.5) AS spread_median, quantile_cont(spread, 0.95) AS spread_p95 FROM s", "spread_min spread_mean spread_max spread_median spread_p95")
def spread_stats(spark, sf_dir):
    return A.spread_stats(V.raw_book(spark, sf_dir))


@query("o2_largest_gaps", f"{RAW}, g AS (SELECT symbol, lag(ts_event) OVER w AS prev_ts, ts_event, sequence, epoch_us(ts_event) - lag(epoch_us(ts_event)) OVER w AS gap_us FROM ticks WINDOW w AS ({BY})) SELECT symbol, prev_ts, ts_event, gap_us FROM g WHERE gap_us IS NOT NULL ORDER BY gap_us DESC, symbol, sequence LIMIT 25")
def largest_gaps(spark, sf_dir):
    return A.largest_gaps(V.ticks(spark, sf_dir), 25)


@query("o2_largest_jumps", f"{RAW}, g AS (SELECT symbol, ts_event, sequence, lag(price) OVER w AS prev_price, price FROM ticks WINDOW w AS ({BY})) SELECT symbol, ts_event, prev_price, price, abs(price - prev_price) / prev_price AS step_pct FROM g WHERE prev_price > 0 ORDER BY abs(price - prev_price) / prev_price DESC, symbol, sequence LIMIT 25", "prev_price price step_pct")
def largest_jumps(spark, sf_dir):
    return A.largest_jumps(V.ticks(spark, sf_dir), 25)


@query("a22_top_counts", f"{V.TICKS} SELECT symbol, count(*) AS rows FROM ticks GROUP BY symbol ORDER BY rows DESC, symbol LIMIT 20")
def top_counts(spark, sf_dir):
    return A.top_counts(V.ticks(spark, sf_dir), "symbol", 20)


@query("a28_distinct_counts", f"{RAW} SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, count(DISTINCT order_id) AS order_ids, (SELECT (sum(n) - count(*))::BIGINT FROM (SELECT count(*) AS n FROM raw GROUP BY symbol, ts_event)) AS repeated_keys FROM raw")
def distinct_counts(spark, sf_dir):
    return A.distinct_counts(V.raw_ticks(spark, sf_dir))


@query("a32_coverage_stats", f"{V.TICKS}, s AS (SELECT least(size / 100.0, 1)::DOUBLE AS v FROM ticks) SELECT avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, avg((v < 0.3)::INT) AS low_ratio FROM s", "mean median p25 p75 low_ratio")
def coverage_stats(spark, sf_dir):
    rows = V.ticks(spark, sf_dir).select(F.least(F.col("size") / 100.0, F.lit(1.0)).alias("coverage"))
    return A.coverage_stats(rows, "coverage", 0.3)


@query(
    "j13_compare_feeds",
    f"""{V.BOOK}, a AS (SELECT symbol, count(*) AS mbo_rows FROM ticks WHERE action = 'T' AND size >= 80 GROUP BY symbol), b AS (SELECT symbol, count(*) AS mbp_rows FROM book WHERE bid_px[1] > 1180 GROUP BY symbol)
SELECT symbol, coalesce(mbo_rows, 0) AS mbo_rows, coalesce(mbp_rows, 0) AS mbp_rows, CASE WHEN mbp_rows IS NULL THEN 'mbo_only' WHEN mbo_rows IS NULL THEN 'mbp_only' ELSE 'both' END AS found_in FROM a FULL JOIN b USING (symbol)""",
)
def compare_feeds(spark, sf_dir):
    large = V.ticks(spark, sf_dir).filter(is_trade() & (F.col("size") >= 80))
    return A.compare_feeds(large, V.book(spark, sf_dir).filter(F.get("bid_px", 0) > 1180))


WHOLE_FEEDS = " UNION ALL ".join(
    f"""SELECT '{kind}' AS kind, {c}::VARCHAR AS value, count(*) FILTER (WHERE action = 'T') AS mbo_rows, count(*) FILTER (WHERE action = 'C') AS mbp_rows FROM parsed GROUP BY {c} HAVING count(*) FILTER (WHERE action IN ('T', 'C')) > 0"""
    for kind, c in (("symbol", "symbol"), ("root", "contract_root"), ("month", "contract_month_code"))
)


@query("j13_whole_feeds", f"{V.TICKS}, {CONTRACT_SQL} SELECT *, CASE WHEN mbp_rows = 0 THEN 'mbo_only' WHEN mbo_rows = 0 THEN 'mbp_only' ELSE 'both' END AS found_in FROM ({WHOLE_FEEDS})")
def compare_whole_feeds(spark, sf_dir):
    """Symbols, roots and months of all trades beside those of all cancels."""
    rows = C.parse_contract(contracts(spark, sf_dir))
    trades, cancels = rows.filter(is_trade()), rows.filter("action = 'C'")
    kinds = {"symbol": "symbol", "root": "contract_root", "month": "contract_month_code"}
    parts = [A.compare_feeds(trades, cancels, c).select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"), "mbo_rows", "mbp_rows", "found_in") for kind, c in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("o1_stable_sort", f"{V.TICKS} SELECT symbol, ts_event, sequence, price FROM ticks ORDER BY ts_event, symbol, sequence", "price")
def stable_sort(spark, sf_dir):
    return V.ticks(spark, sf_dir).select("symbol", "ts_event", "sequence", "price").orderBy("ts_event", "symbol", "sequence")


@query("o4_union_by_name", f"{V.BOOK} SELECT symbol, ts_event, sequence, price, NULL::DOUBLE AS best_bid FROM ticks WHERE action = 'T' UNION ALL SELECT symbol, ts_event, sequence, NULL, bid_px[1] FROM book", "price best_bid")
def union_by_name(spark, sf_dir):
    trades = V.ticks(spark, sf_dir).filter(is_trade()).select("symbol", "ts_event", "sequence", "price")
    books = V.book(spark, sf_dir).select("symbol", "ts_event", "sequence", F.get("bid_px", 0).alias("best_bid"))
    return trades.unionByName(books, allowMissingColumns=True)


@query(
    "o5_o6_symbol_sets",
    f"""{V.TICKS}, a AS (SELECT DISTINCT symbol FROM ticks WHERE action = 'T' AND ts_event < TIMESTAMP '2024-01-10'), b AS (SELECT DISTINCT symbol FROM ticks WHERE action = 'C' AND ts_event >= TIMESTAMP '2024-01-10')
SELECT symbol, 'only_first' AS found_in FROM (SELECT symbol FROM a EXCEPT SELECT symbol FROM b) UNION ALL SELECT symbol, 'both' FROM (SELECT symbol FROM a INTERSECT SELECT symbol FROM b)""",
)
def symbol_sets(spark, sf_dir):
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    rows = V.ticks(spark, sf_dir)
    a = rows.filter((F.col("action") == "T") & (F.col("ts_event") < cut)).select("symbol").distinct()
    b = rows.filter((F.col("action") == "C") & (F.col("ts_event") >= cut)).select("symbol").distinct()
    return a.subtract(b).withColumn("found_in", F.lit("only_first")).unionByName(a.intersect(b).withColumn("found_in", F.lit("both")))


@query(
    "o5_o6_whole_sets",
    f"""{V.TICKS}, a AS (SELECT DISTINCT symbol, price FROM ticks WHERE action = 'T'), b AS (SELECT DISTINCT symbol, price FROM ticks WHERE action <> 'T')
SELECT symbol, price, 'only_first' AS found_in FROM (FROM a EXCEPT FROM b) UNION ALL SELECT symbol, price, 'only_second' FROM (FROM b EXCEPT FROM a) UNION ALL SELECT symbol, price, 'both' FROM (FROM a INTERSECT FROM b)""",
    "price",
)
def whole_sets(spark, sf_dir):
    """Price levels per symbol: those traded, those only ordered at, and both."""
    rows = V.ticks(spark, sf_dir)
    a, b = (rows.filter(c).select("symbol", "price").distinct() for c in (F.col("action") == "T", F.col("action") != "T"))
    named = lambda df, name: df.withColumn("found_in", F.lit(name))
    return named(a.subtract(b), "only_first").unionByName(named(b.subtract(a), "only_second")).unionByName(named(a.intersect(b), "both"))


@query("j10_ticks_in_bars", f"{V.TICKS}, b AS (SELECT DISTINCT symbol, date_trunc('hour', ts_event) AS bar_ts FROM ticks WHERE action = 'T') SELECT t.symbol, t.sequence, b.bar_ts FROM ticks t JOIN b ON t.symbol = b.symbol AND t.ts_event >= b.bar_ts AND t.ts_event < b.bar_ts + INTERVAL 1 HOUR")
def ticks_in_bars(spark, sf_dir):
    rows = with_bar(V.ticks(spark, sf_dir), "1 hour")
    bars = rows.filter(is_trade()).select("symbol", "bar_ts").distinct()
    return rows.join(bars, ["symbol", "bar_ts"]).select("symbol", "sequence", "bar_ts")
