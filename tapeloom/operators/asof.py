"""As-of joins: each left row takes the last right row at or before its time.

Both sides are stacked and the last right row is carried forward per symbol, so no pair is ever
built and a hot symbol is cut into blocks like any other running value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.market import is_buy, is_sell, is_trade
from tapeloom.operators.ordered import KEYS, beside, exact_quantiles, running


def asof(
    left: DataFrame,
    right: DataFrame,
    *,
    right_ts: str = "ts_event",
    columns: Sequence[str],
    keys: Sequence[str] = KEYS,
    right_sequence: str | None = "sequence",
    tolerance_ms: float | None = None,
    strict: bool = False,
) -> DataFrame:
    """Add the struct's ``columns`` of the matching right row, and ``match_ts``, its time.

    Rows of equal time match unless ``strict``. Matches older than ``tolerance_ms`` become null.
    """
    payload = F.struct(F.col(right_ts).alias("match_ts"), *[F.col(c).alias(c) for c in columns])
    side = F.lit(1 if strict else -1)  # right rows of the same time come first, or last when strict
    sequence = F.col(right_sequence).cast("long") if right_sequence else F.lit(0).cast("long")
    stacked_right = right.select(*keys, F.col(right_ts).alias("ts_event"), side.alias("_side"), sequence.alias("_seq"), payload.alias("_right"))
    left_seq = F.col("sequence").cast("long") if "sequence" in left.columns else F.lit(0).cast("long")
    # Keys and times travel once, and the rows stay parted by keys that the next step can see.
    kind = lambda df, c: df.select(c).schema[0].dataType
    shared = [k for k, r in [*((k, k) for k in keys), ("ts_event", right_ts)] if kind(left, k) == kind(right, r)]
    rest = [c for c in left.columns if c not in shared]
    whole = [F.struct(*[F.col(c) for c in rest]).alias("_left")] if rest else []
    stacked_left = left.select(*keys, "ts_event", F.lit(0).alias("_side"), left_seq.alias("_seq"), *whole)
    both = stacked_left.unionByName(stacked_right, allowMissingColumns=True)
    both = running(both, {"_match": ("last", "_right")}, keys=keys, order=["ts_event", "_side", "_seq"])
    out = both.filter("_side = 0").select(*[F.col(f"_left.`{c}`" if c in rest else c) for c in left.columns], "_match")
    match = F.col("_match")
    if tolerance_ms is not None:
        match = F.when(age_ms(F.col("ts_event"), F.col("_match.match_ts")) <= tolerance_ms, match)
    return out.withColumn("_match", match).select(*left.columns, "_match.*")


def age_ms(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(1000.0)


def flow_state(ticks: DataFrame) -> DataFrame:
    """One row per trade time: interval sums, last price and running totals."""
    size = F.col("size").cast("double")
    trades = ticks.filter(is_trade() & (F.col("price") > 0) & (F.col("size") >= 0))
    signed = F.when(is_buy(), size).when(is_sell(), -size).otherwise(0.0)
    state = trades.groupBy("symbol", F.col("ts_event").alias("mbo_state_ts")).agg(
        F.sum(signed).alias("mbo_signed_trade_size"),
        F.sum(F.greatest(signed, F.lit(0.0))).alias("mbo_buy_trade_size"),
        F.sum(F.greatest(-signed, F.lit(0.0))).alias("mbo_sell_trade_size"),
        F.count(F.lit(1)).alias("mbo_trade_count"),
        F.max_by("price", "sequence").alias("mbo_last_trade_price"),
    )
    return running(
        state,
        {
            "mbo_cvd": ("sum", "mbo_signed_trade_size"),
            "mbo_cum_buy_volume": ("sum", "mbo_buy_trade_size"),
            "mbo_cum_sell_volume": ("sum", "mbo_sell_trade_size"),
            "mbo_cum_trade_count": ("sum", "mbo_trade_count"),
        },
        order=["mbo_state_ts"],
    )


FLOW_COLUMNS = [
    "mbo_signed_trade_size",
    "mbo_buy_trade_size",
    "mbo_sell_trade_size",
    "mbo_trade_count",
    "mbo_cvd",
    "mbo_cum_buy_volume",
    "mbo_cum_sell_volume",
    "mbo_cum_trade_count",
]


def align_flow(snapshots: DataFrame, state: DataFrame) -> DataFrame:
    """Snapshots with the last flow state; totals are 0 before the first trade."""
    out = asof(snapshots, state, right_ts="mbo_state_ts", right_sequence=None, columns=[*FLOW_COLUMNS, "mbo_last_trade_price"])
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in FLOW_COLUMNS}
    return out.withColumns(zero).withColumnRenamed("match_ts", "mbo_state_ts")


def age_report(aligned: DataFrame, match_ts: str = "mbo_state_ts") -> DataFrame:
    """One row: match rate, age percentiles in ms, shares above limits and the reliability flag."""
    rows = aligned.select(age_ms(F.col("ts_event"), F.col(match_ts)).alias("age"))
    over = {f"pct_age_gt_{s}s": F.sum(F.when(F.col("age") > s * 1000, 1).otherwise(0)) / F.count(F.lit(1)) for s in (1, 5, 10, 30, 60)}
    stats = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("age").alias("matched_rows"),
        F.min("age").alias("age_min"),
        F.max("age").alias("age_max"),
        *[c.alias(n) for n, c in over.items()],
    )
    q = exact_quantiles(rows, {"_q": "age"}, [0.5, 0.9, 0.95, 0.99])
    out = stats.transform(beside, q)  # one row each
    names = ["age_median", "age_p90", "age_p95", "age_p99"]
    out = out.withColumns({n: F.get("_q", i) for i, n in enumerate(names)}).drop("_q")
    out = out.withColumn("match_rate", F.col("matched_rows") / F.greatest("rows", F.lit(1)))
    return out.withColumns(
        {
            "stale_warning": F.coalesce(F.col("age_p95") > 30_000, F.lit(False)),
            "stale_critical": F.coalesce(F.col("age_p95") > 120_000, F.col("matched_rows") == 0),
            "reliable": F.coalesce((F.col("match_rate") >= 0.95) & (F.col("age_p95") <= 30_000), F.lit(False)),
        }
    )


def overlap_ratio(rows: DataFrame, clock: DataFrame, tolerance_ms: float) -> DataFrame:
    """Per symbol: share of rows that have a clock time within the tolerance before them."""
    hit = asof(rows.select("symbol", "ts_event"), clock.select("symbol", "ts_event"), columns=[], right_sequence=None, tolerance_ms=tolerance_ms)
    return hit.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count("match_ts").alias("matched")).withColumn("overlap", F.col("matched") / F.col("rows"))


def nearest_within(rows: DataFrame, clock: DataFrame, max_age_ms: float) -> DataFrame:
    """The clock time at or before each row, and the row time at or before each clock time."""
    back = asof(rows, clock.select("symbol", "ts_event"), columns=[], right_sequence=None, tolerance_ms=max_age_ms)
    return back.withColumnRenamed("match_ts", "clock_ts")


def snapshot_position(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Position, from 0, of the last snapshot at or before each event; null where there is none."""
    from tapeloom.operators.ordered import numbered

    return asof(events, numbered(snapshots.select("symbol", "ts_event", "sequence"), "position"), columns=["position"]).drop("match_ts")


