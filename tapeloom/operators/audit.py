"""Reports on the quality of a feed: counts, gaps, jumps, coverage and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.ordered import beside, exact_quantiles, matched, windowed


def _one(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def _steps(df: DataFrame, order: list[str]) -> DataFrame:
    def step(rows, w):
        t = F.unix_micros(F.col("ts_event").cast("timestamp"))
        return rows.withColumns({"gap_us": t - F.lag(t).over(w), "prev_price": F.lag("price").over(w), "prev_ts": F.lag("ts_event").over(w)})

    return windowed(df, step, before=1, order=order)


def integrity(df: DataFrame, gap_seconds: float = 1.0, jump: float = 0.01) -> DataFrame:
    """Per symbol, in the order the rows came in: missing and repeated times, steps back, gaps, price jumps, sizes."""
    timed = _steps(df.filter("ts_event is not null"), ["ingest"])
    moved = F.abs(F.col("price") / F.nullif("prev_price", F.lit(0.0)) - 1)
    out = timed.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("timed_rows"),
        _one(F.col("gap_us") < 0).alias("non_monotonic_ts_steps"),
        _one(F.col("gap_us") > gap_seconds * 1_000_000).alias("gap_rows"),
        (F.greatest(F.max("gap_us"), F.lit(0)) / 1000.0).alias("max_gap_ms"),
        _one(moved > jump).alias("price_jump_rows"),
        F.min("ts_event").alias("first_ts"),
        F.max("ts_event").alias("last_ts"),
    )
    distinct = timed.groupBy("symbol", "ts_event").agg(F.count(F.lit(1)).alias("_n")).groupBy("symbol").agg(F.sum(F.col("_n") - 1).alias("duplicate_ts_rows"))
    whole = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        _one(F.col("ts_event").isNull()).alias("missing_ts_rows"),
        _one(F.col("price").isNull()).alias("price_missing_rows"),
        _one(F.col("price") <= 0).alias("price_nonpositive_rows"),
        _one(F.col("size").isNull()).alias("size_missing_rows"),
        _one(F.col("size") < 0).alias("size_negative_rows"),
        _one(F.col("size") == 0).alias("size_zero_rows"),
    )
    return matched(matched(whole, out, "symbol", "left"), distinct, "symbol", "left")


def validate_market(df: DataFrame, tick: float) -> DataFrame:
    """Issues found in order or book rows: code, severity and number of rows, only those that occur."""
    timed = _steps(df.filter("ts_event is not null"), ["ingest"])
    order = timed.agg(_one(F.col("gap_us") < 0).alias("back"))
    copies = df.groupBy("symbol", "ts_event").agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(F.col("_n") - 1).alias("dup"))
    checks = {
        "invalid_ts_event": ("critical", F.col("ts_event").isNull()),
        "invalid_prices": ("critical", F.col("price").isNull() | (F.col("price") <= 0)),
    }
    if "bid_px" in df.columns:
        bid, ask = F.get("bid_px", 0), F.get("ask_px", 0)
        valid = F.coalesce((bid > 0) & (ask > 0), F.lit(False))
        checks |= {
            "missing_best_bid_ask": ("high", ~valid),
            "crossed_book": ("critical", valid & (bid > ask)),
            "locked_book": ("medium", valid & (bid == ask)),
            "very_wide_spread_gt_20_ticks": ("medium", valid & ((ask - bid) / tick > 20)),
        }
    counts = df.agg(*[_one(c).alias(code) for code, (_, c) in checks.items()])
    flat = counts.transform(beside, order).transform(beside, copies)  # one row each
    entry = lambda code, severity, n: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), n.alias("rows"))
    issues = [entry(code, sev, F.col(code)) for code, (sev, _) in checks.items()]
    issues += [entry("ts_event_not_monotonic", "critical", F.col("back")), entry("duplicate_ts_event", "medium", F.col("dup"))]
    return flat.select(F.explode(F.array(*issues)).alias("i")).select("i.*").filter("rows > 0")


def monthly_rows(df: DataFrame) -> DataFrame:
    """Rows, symbols and missing values per month."""
    month = F.date_format("ts_event", "yyyy-MM").alias("month")
    return df.groupBy(month).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("symbol").alias("symbols"),
        _one(F.col("price").isNull()).alias("missing_price"),
        _one(F.col("side").isNull() | (F.trim("side") == "")).alias("missing_side"),
    )


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and distinct values per column, one row each."""
    stats = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_{c}") for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), (F.col("_rows") - F.col(f"_{c}")).alias("missing"), ((F.col("_rows") - F.col(f"_{c}")) / F.col("_rows")).alias("missing_share")) for c in columns]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def active_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Which columns hold any value in which month."""
    month = F.date_format("ts_event", "yyyy-MM").alias("month")
    stats = df.groupBy(month).agg(*[F.count(c).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns]
    return stats.select("month", F.explode(F.array(*rows)).alias("r")).select("month", "r.*").filter("values > 0")


def spread_stats(books: DataFrame) -> DataFrame:
    gap = books.select((F.get("ask_px", 0) - F.get("bid_px", 0)).alias("spread"))
    stats = gap.agg(F.count("spread").alias("rows"), F.min("spread").alias("spread_min"), F.avg("spread").alias("spread_mean"), F.max("spread").alias("spread_max"))
    q = exact_quantiles(gap, {"_q": "spread"}, [0.5, 0.95])
    return stats.transform(beside, q).withColumns({"spread_median": F.get("_q", 0), "spread_p95": F.get("_q", 1)}).drop("_q")  # one row each


def largest_gaps(df: DataFrame, top: int) -> DataFrame:
    rows = _steps(df, ["ts_event", "sequence"]).filter("gap_us is not null")
    return rows.orderBy(F.desc("gap_us"), "symbol", "sequence").limit(top).select("symbol", "prev_ts", "ts_event", "gap_us")


def largest_jumps(df: DataFrame, top: int) -> DataFrame:
    moved = F.abs(F.col("price") - F.col("prev_price")) / F.col("prev_price")
    rows = _steps(df, ["ts_event", "sequence"]).filter("prev_price > 0").withColumn("step_pct", moved)
    return rows.orderBy(F.desc("step_pct"), "symbol", "sequence").limit(top).select("symbol", "ts_event", "prev_price", "price", "step_pct")


def top_counts(df: DataFrame, column: str, limit: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column).limit(limit)


def distinct_counts(df: DataFrame) -> DataFrame:
    """Rows, distinct symbols and order ids, and rows that repeat a (symbol, time)."""
    copies = df.groupBy("symbol", "ts_event").agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(F.col("_n") - 1).alias("repeated_keys"))
    stats = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("order_id").alias("order_ids"))
    return stats.transform(beside, copies)  # one row each


def coverage_stats(df: DataFrame, column: str, low: float) -> DataFrame:
    """Mean, quartiles and the share below a threshold."""
    value = df.select(F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("v"))
    stats = value.agg(F.avg("v").alias("mean"), F.avg((F.col("v") < low).cast("double")).alias("low_ratio"))
    q = exact_quantiles(value, {"_q": "v"}, [0.25, 0.5, 0.75])
    return stats.transform(beside, q).select("mean", F.get("_q", 1).alias("median"), F.get("_q", 0).alias("p25"), F.get("_q", 2).alias("p75"), "low_ratio")  # one row each


def compare_feeds(a: DataFrame, b: DataFrame, key: str = "symbol") -> DataFrame:
    """Values of ``key`` in both feeds, null among them, with their rows, and where they occur."""
    left = a.groupBy(key).agg(F.count(F.lit(1)).alias("mbo_rows"))
    right = b.groupBy(key).agg(F.count(F.lit(1)).alias("mbp_rows"))
    both = matched(left, right, key, "full")
    place = F.when(F.col("mbp_rows").isNull(), "mbo_only").when(F.col("mbo_rows").isNull(), "mbp_only").otherwise("both")
    return both.select(key, F.coalesce("mbo_rows", F.lit(0)).alias("mbo_rows"), F.coalesce("mbp_rows", F.lit(0)).alias("mbp_rows"), place.alias("found_in"))


def before_after(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Per symbol: rows, price range and share kept, before and after cleaning."""
    stats = lambda df, p: df.groupBy("symbol").agg(F.count(F.lit(1)).alias(f"{p}_rows"), F.min("price").alias(f"{p}_min_price"), F.max("price").alias(f"{p}_max_price"))
    both = stats(raw, "raw").join(stats(clean, "clean"), "symbol", "full")
    return both.withColumn("clean_rows", F.coalesce("clean_rows", F.lit(0))).withColumn("kept_share", F.col("clean_rows") / F.col("raw_rows"))


# --------------------------------------------------------------------------- integrity that merges

#: Columns of a part's summary that add up.
ADDING = ("rows", "missing_ts_rows", "price_missing_rows", "price_nonpositive_rows", "size_missing_rows", "size_negative_rows", "size_zero_rows", "timed_rows", "non_monotonic_ts_steps", "gap_rows", "price_jump_rows")


def _stepped(before: Column, after: Column, gap_seconds: float, jump: float) -> dict[str, Column]:
    """What the step from one timed row (ts in microseconds, price) to the next adds to the counts."""
    gap = after["us"] - before["us"]
    moved = F.abs(after["price"] / F.nullif(before["price"], F.lit(0.0)) - 1)
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    return {"non_monotonic_ts_steps": one(gap < 0), "gap_rows": one(gap > gap_seconds * 1_000_000), "price_jump_rows": one(moved > jump), "max_gap_us": gap}


def integrity_parts(df: DataFrame, part: str, order: str = "ingest", gap_seconds: float = 1.0, jump: float = 0.01) -> DataFrame:
    """One summary per symbol and part, of the part's own rows only; a part without rows has none.

    ``first_row`` and ``last_row`` are the part's outer rows with a time, in ``order``; what the step
    between two parts adds is left to `merged_parts`. Null symbols and parts are values like others.
    """
    keys = ["symbol", part]
    us = F.unix_micros(F.col("ts_event").cast("timestamp"))
    row = F.struct(us.alias("us"), F.col("price").cast("double").alias("price"))
    timed = df.filter("ts_event is not null").select(*keys, order, "ts_event", row.alias("_row"))
    timed = windowed(timed, lambda rows, w: rows.withColumn("_before", F.lag("_row").over(w)), before=1, keys=keys, order=[order])
    steps = _stepped(F.col("_before"), F.col("_row"), gap_seconds, jump)
    inner = timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("timed_rows"),
        *[F.sum(c).alias(name) for name, c in steps.items() if name != "max_gap_us"],
        F.max(steps["max_gap_us"]).alias("max_gap_us"),
        F.min_by("_row", order).alias("first_row"),
        F.max_by("_row", order).alias("last_row"),
        F.min("ts_event").alias("first_ts"),
        F.max("ts_event").alias("last_ts"),
    )
    checks = {
        "missing_ts_rows": F.col("ts_event").isNull(),
        "price_missing_rows": F.col("price").isNull(),
        "price_nonpositive_rows": F.col("price") <= 0,
        "size_missing_rows": F.col("size").isNull(),
        "size_negative_rows": F.col("size") < 0,
        "size_zero_rows": F.col("size") == 0,
    }
    whole = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[_one(c).alias(name) for name, c in checks.items()])
    out = matched(whole, inner, keys, "left")
    return out.withColumn("part", F.col(part)).fillna(0, subset=[c for c in ADDING if c != "rows"]).select("symbol", "part", *ADDING, "max_gap_us", "first_row", "last_row", "first_ts", "last_ts")


def time_counts(df: DataFrame) -> DataFrame:
    """Rows per symbol and time: the part of a summary that finds times that come again in any other part."""
    return df.filter("ts_event is not null").groupBy("symbol", "ts_event").agg(F.count(F.lit(1)).alias("rows"))


def merged_times(counts: DataFrame) -> DataFrame:
    """Counts of several parts, put together, as those of one."""
    return counts.groupBy("symbol", "ts_event").agg(F.sum("rows").alias("rows"))


def merged_parts(parts: DataFrame, into: Column, gap_seconds: float = 1.0, jump: float = 0.01) -> DataFrame:
    """Summaries of consecutive parts with the same ``into`` as one, with the steps between them.

    The result has the form of its input, so parts merge in any grouping: days to months, months to
    years, an earlier total with what came since. Parts are in the order of ``part``; those without a
    timed row are stepped over. A window holds one row per part of a symbol, never its rows.
    """
    rows = parts.withColumn("_into", into)
    before = Window.partitionBy("symbol", "_into").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.last("last_row", ignorenulls=True).over(before))
    steps = _stepped(F.col("_before"), F.col("first_row"), gap_seconds, jump)
    added = [F.sum(F.col(c) + steps[c] if c in steps else F.col(c)).alias(c) for c in ADDING]
    timed = F.when(F.col("first_row").isNotNull(), F.col("part"))
    out = rows.groupBy("symbol", "_into").agg(
        *added,
        F.max(F.greatest("max_gap_us", steps["max_gap_us"])).alias("max_gap_us"),
        F.min_by("first_row", timed).alias("first_row"),
        F.max_by("last_row", timed).alias("last_row"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    return out.withColumnRenamed("_into", "part").select(*parts.columns)


def integrity_report(total: DataFrame, times: DataFrame) -> DataFrame:
    """The columns of `integrity` from one summary per symbol and its merged counts of times."""
    again = times.groupBy("symbol").agg(F.sum(F.col("rows") - 1).alias("duplicate_ts_rows"))
    timed = [c for c in ADDING if c in ("timed_rows", "non_monotonic_ts_steps", "gap_rows", "price_jump_rows")]
    known = F.col("timed_rows") > 0
    out = matched(total, again, "symbol", "left").withColumn("max_gap_ms", F.when(known, F.greatest("max_gap_us", F.lit(0)) / 1000.0))
    return out.withColumns({c: F.when(known, F.col(c)) for c in timed}).drop("part", "max_gap_us", "first_row", "last_row")
