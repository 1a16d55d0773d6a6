"""Cleaning, filtering and sampling of feeds.

Duplicates are removed by an aggregate that keeps the last copy: copies meet in the map-side
combine, so a record that makes up a third of the feed still costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.market import UNKNOWN_TEXT, is_trade
from tapeloom.operators.ordered import KEYS, ORDER, SALTS, beside, exact_quantiles, matched, numbered, running, windowed

# Text that stands for a missing entry.
UNKNOWN = [*UNKNOWN_TEXT, "NULL", "<NA>", "UNKNOWN"]
# What makes two records the same market event.
MBO_KEYS = ["ts_event", "action", "side", "price", "size", "order_id"]
MBP_KEYS = ["ts_event", "bid_px", "ask_px", "bid_sz", "ask_sz"]
# Fixed value: futures symbol = root, month code, year digits.
CONTRACT = r"^(.+?)([FGHJKMNQUVXZ])([0-9]{1,4})$"


def known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.upper(F.trim(F.col(c).cast("string"))).isin(UNKNOWN)


def coerce_time(df: DataFrame) -> DataFrame:
    """``ts_event`` from text or time, falling back to ``ts_recv``; null where neither parses."""
    parsed = [F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz") for c in ("ts_event", "ts_recv") if c in df.columns]
    return df.withColumn("ts_event", F.coalesce(*parsed))


def basic_clean(df: DataFrame, drop_duplicates: bool = False, strict_trade_prices: bool = False) -> DataFrame:
    """Drop rows without a time; if asked, exact duplicates and trades without a positive price."""
    out = df.filter(F.col("ts_event").isNotNull())
    if drop_duplicates:
        out = out.dropDuplicates()
    if strict_trade_prices:
        out = out.filter(~(is_trade() & F.coalesce(F.col("price") <= 0, F.lit(False))))
    return out


def basic_report(df: DataFrame) -> DataFrame:
    """Counts behind ``basic_clean`` from one pass over distinct records and their copies."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    timed = F.col("ts_event").isNotNull()
    bad = F.col("price").isNull() | F.isnan("price") | (F.col("price") <= 0)
    return copies.agg(
        F.sum("_n").alias("input_rows"),
        F.sum(F.when(~timed, F.col("_n")).otherwise(0)).alias("invalid_timestamp_rows"),
        F.sum(F.when(timed, F.col("_n") - 1).otherwise(0)).alias("exact_duplicate_rows"),
        F.sum(F.when(timed & bad, F.col("_n")).otherwise(0)).alias("invalid_price_rows"),
    )


def normalise(df: DataFrame, *, kind: str = "mbo", none_side_is_buy: bool = False, strict: bool = False) -> DataFrame:
    """Upper-case codes, drop resets and rows without price, size, order id or symbol.

    Side ``N`` stays unknown unless ``none_side_is_buy``. ``strict`` fails on a bad row instead of
    dropping it. Without a price column the mid of the best quotes is taken, or the one there is.
    """
    out = df
    if "size" not in out.columns:
        alias = next((c for c in ("qty", "quantity", "volume") if c in out.columns), None)
        if alias:
            out = out.withColumn("size", F.col(alias))
    if "action" in out.columns:
        out = out.withColumn("action", F.upper(F.trim("action"))).filter(F.coalesce(F.col("action") != "R", F.lit(True)))
    if "side" in out.columns:
        side = F.upper(F.trim("side"))
        out = out.withColumn("side", F.when(side == "N", "A").otherwise(side) if none_side_is_buy else side)
    if "price" not in out.columns:
        bid, ask = (F.when(F.get(c, 0) > 0, F.get(c, 0)) for c in ("bid_px", "ask_px"))
        out = out.withColumn("price", F.coalesce((bid + ask) / 2, bid, ask))
    good = (F.col("price") > 0) & known("symbol")
    if kind == "mbo":
        good = good & known("action") & known("side") & (F.col("size") > 0) & known("order_id")
    good = F.coalesce(good, F.lit(False))
    if strict:
        failed = F.raise_error(F.concat(F.lit("invalid row: "), F.to_json(F.struct(*out.columns))))
        return out.withColumn("symbol", F.when(good, F.col("symbol")).otherwise(failed.cast(dict(out.dtypes)["symbol"])))
    out = out.filter(good)
    if kind == "mbp" and "size" in out.columns:
        out = out.withColumn("size", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)))
    return out


def _zero_above(side: str, tops: Column) -> Column:
    return F.transform(side, lambda p, i: F.when(p > F.try_element_at(tops, i), F.lit(0.0)).otherwise(p))


def clip_book_outliers(df: DataFrame, multiple: float = 5.0, least: int = 10) -> DataFrame:
    """Set a level's price to 0 where it lies above q3 + multiple·IQR of that level's positive prices."""
    limits = None
    for side in ("bid_px", "ask_px"):
        lv = df.select("symbol", F.posexplode(side).alias("level", "px")).filter("px > 0")
        q = exact_quantiles(lv, {"_q": "px"}, [0.25, 0.75], keys=["symbol", "level"])
        n = lv.groupBy("symbol", "level").agg(F.count(F.lit(1)).alias("_n"))
        iqr = F.get("_q", 1) - F.get("_q", 0)
        high = F.when((F.col("_n") > least) & (iqr > 0), F.get("_q", 1) + multiple * iqr)
        table = matched(q, n, ["symbol", "level"]).select("symbol", F.struct("level", high.alias("high")).alias("_l"))
        table = table.groupBy("symbol").agg(F.array_sort(F.collect_list("_l")).alias(f"_{side}"))  # one entry per level
        limits = table if limits is None else matched(limits, table, "symbol", "full")
    out = matched(df, limits, "symbol", "left", salts=SALTS)
    for side in ("bid_px", "ask_px"):
        out = out.withColumn(side, _zero_above(side, F.map_from_entries(F.col(f"_{side}"))))
    return out.drop("_bid_px", "_ask_px")


def drop_invalid_orders(df: DataFrame) -> DataFrame:
    """Order events with a known action, side and order id, and a positive price and size; no resets."""
    ok = known("action") & known("side") & known("order_id") & (F.col("price") > 0) & (F.col("size") > 0)
    return df.filter(F.coalesce(ok & (F.upper(F.trim("action")) != "R"), F.lit(False)))


def keep_last(df: DataFrame, keys: Sequence[str], order: str = "ingest") -> DataFrame:
    """One row per key: the one that came in last."""
    rest = [c for c in df.columns if c not in keys]
    if rest == [order]:  # a plain maximum stays in a hash table
        return df.groupBy(*keys).agg(F.max(order).alias(order)).select(*df.columns)
    last = F.max_by(F.struct(*rest), order)
    return df.groupBy(*keys).agg(last.alias("_last")).select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def drop_exact_duplicates(df: DataFrame, order: str = "ingest") -> DataFrame:
    return keep_last(df, [c for c in df.columns if c != order], order)


def drop_price_outliers(df: DataFrame, max_ratio: float = 5.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep prices within the median divided and multiplied by ``max_ratio``."""
    middle = exact_quantiles(df.filter("price > 0"), {"_q": "price"}, [0.5], keys=keys).withColumn("_m", F.get("_q", 0)).drop("_q")
    out = matched(df, middle, keys, salts=SALTS) if keys else df.transform(beside, middle)  # one row without keys
    return out.filter(F.col("price").between(F.col("_m") / max_ratio, F.col("_m") * max_ratio)).drop("_m")


def mark_spikes(df: DataFrame, max_step: float = 0.05) -> DataFrame:
    """Flag single prices away from both neighbours while these agree. Looks one row ahead."""

    def mark(rows, w):
        p, a, b = F.col("price"), F.lag("price").over(w), F.lead("price").over(w)
        positive = (p > 0) & (a > 0) & (b > 0)
        spike = positive & (F.abs(p - a) / a > max_step) & (F.abs(p - b) / b > max_step) & (F.abs(b - a) / a <= max_step / 2)
        return rows.withColumn("is_spike", F.coalesce(F.when(positive, spike), F.lit(False)))

    return windowed(df, mark, before=1, after=1)


def drop_spikes(df: DataFrame, max_step: float = 0.05) -> DataFrame:
    return mark_spikes(df, max_step).filter(~F.col("is_spike")).drop("is_spike")


def _book_checks(tick: float) -> dict[str, Column]:
    bid, ask = F.get("bid_px", 0), F.get("ask_px", 0)
    valid = F.coalesce((bid > 0) & (ask > 0), F.lit(False))
    negative = F.exists("bid_sz", lambda x: F.coalesce(x < 0, F.lit(False))) | F.exists("ask_sz", lambda x: F.coalesce(x < 0, F.lit(False)))
    return {
        "missing_or_nonpositive_bbo": ~valid,
        "crossed_book": valid & (bid > ask),
        "spread_lt_tick": valid & (ask - bid + tick * 1e-6 < tick),
        "negative_size": negative,
    }


def reject_invalid_books(df: DataFrame, tick: float) -> DataFrame:
    """Drop snapshots without quotes, crossed, tighter than a tick or with negative sizes; null sizes become 0."""
    bad = F.lit(False)
    for c in _book_checks(tick).values():
        bad = bad | c
    zero = {c: F.transform(c, lambda x: F.coalesce(x, F.lit(0.0))) for c in ("bid_sz", "ask_sz")}
    return df.filter(~bad).withColumns(zero)


def invalid_book_report(df: DataFrame, tick: float) -> DataFrame:
    checks, bad = _book_checks(tick), F.lit(False)
    for c in checks.values():
        bad = bad | c
    nulls = F.size(F.filter("bid_sz", lambda x: x.isNull())) + F.size(F.filter("ask_sz", lambda x: x.isNull()))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.agg(
        F.count(F.lit(1)).alias("input_rows"),
        *[one(c).alias(f"{n}_rows") for n, c in checks.items()],
        F.sum(nulls).alias("null_size_values_filled_zero"),
        one(bad).alias("rows_rejected"),
        one(~bad).alias("output_rows"),
    )


def repair_book(df: DataFrame) -> DataFrame:
    """Non-positive prices become 0; missing sizes 0, negative ones 0, others whole numbers."""
    fixed = {c: F.transform(c, lambda p: F.when(p > 0, p).otherwise(0.0)) for c in ("bid_px", "ask_px")}
    fixed |= {c: F.transform(c, lambda s: F.bround(F.greatest(F.coalesce(s, F.lit(0.0)), F.lit(0.0)))) for c in ("bid_sz", "ask_sz")}
    return df.withColumns(fixed)


def infer_tick(df: DataFrame) -> DataFrame:
    """One row: the first percentile of the positive spreads."""
    gap = df.select((F.get("ask_px", 0) - F.get("bid_px", 0)).alias("spread")).filter("spread > 0")
    return exact_quantiles(gap, {"_q": "spread"}, [0.01]).select(F.get("_q", 0).alias("tick_size"))


def clean_books(df: DataFrame, tick: float, max_spread_ticks: float = 20.0, drop_locked: bool = True) -> DataFrame:
    """Repair levels, drop crossed, locked and too wide snapshots, and take the mid as price."""
    out = repair_book(df)
    bid, ask = F.get("bid_px", 0), F.get("ask_px", 0)
    ordered = ask > bid if drop_locked else ask >= bid
    keep = (bid > 0) & (ask > 0) & ordered & (ask - bid <= tick * max_spread_ticks)
    return out.filter(F.coalesce(keep, F.lit(False))).withColumn("price", (bid + ask) / 2)


def clean_orders(df: DataFrame, max_ratio: float = 5.0, max_step: float = 0.05) -> DataFrame:
    """All cleaning steps of order events in sequence."""
    out = drop_exact_duplicates(drop_invalid_orders(df))
    out = keep_last(drop_price_outliers(out, max_ratio), ["symbol", *MBO_KEYS])
    return drop_spikes(out, max_step)


def stage_report(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows after every stage, and how many it dropped against the stage before it."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        row = df.agg(F.count(F.lit(1)).alias("after_rows")).select(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "after_rows")
        out = row if out is None else out.unionByName(row)
    from pyspark.sql import Window

    before = F.lag("after_rows").over(Window.orderBy("stage_no"))  # one row per stage
    out = out.withColumn("before_rows", F.coalesce(before, F.col("after_rows")))
    return out.withColumn("dropped_rows", F.col("before_rows") - F.col("after_rows"))


def in_range(df: DataFrame, start=None, end=None, symbol=None, end_inclusive: bool = True) -> DataFrame:
    out = df
    if start is not None:
        out = out.filter(F.col("ts_event") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("ts_event") <= F.lit(end) if end_inclusive else F.col("ts_event") < F.lit(end))
    return out if symbol is None else out.filter(F.col("symbol") == F.lit(symbol))


def range_report(df: DataFrame, start, end, symbol) -> DataFrame:
    """How many rows each filter in turn drops."""
    early, late, other = F.col("ts_event") < F.lit(start), F.col("ts_event") > F.lit(end), F.col("symbol") != F.lit(symbol)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.agg(
        one(early).alias("rows_dropped_start_filter"),
        one(~early & late).alias("rows_dropped_end_filter"),
        one(~early & ~late & other).alias("rows_dropped_symbol_filter"),
        one(~early & ~late & ~other).alias("rows_kept"),
    )


def parse_contract(df: DataFrame, column: str = "contract_symbol") -> DataFrame:
    """Root, month code and year digits of a futures symbol; null where it is none."""
    text = F.upper(F.trim(column))
    part = lambda i: F.nullif(F.regexp_extract(text, CONTRACT, i), F.lit(""))
    return df.withColumns({"contract_root": part(1), "contract_month_code": part(2), "contract_year_suffix": part(3)})


def contract_filter(df: DataFrame, root: str | None = None, symbol: str | None = None) -> DataFrame:
    out = parse_contract(df)
    if root:
        out = out.filter(F.col("contract_root") == root.upper())
    return out.filter(F.upper(F.trim("contract_symbol")) == symbol.upper()) if symbol else out


def continuous(df: DataFrame, root: str) -> DataFrame:
    """Relabel all contracts as their root; fails on a contract of another root."""
    out = parse_contract(df)
    wrong = F.raise_error(F.concat(F.lit(f"not a contract of {root}: "), F.coalesce("contract_symbol", F.lit("null"))))
    return out.withColumn("symbol", F.when(F.col("contract_root") == root, F.lit(root)).otherwise(wrong.cast("string")))


def continuous_roots(df: DataFrame, group: str) -> DataFrame:
    """Relabel all contracts as their own root; fails where a ``group`` (a file, a feed) holds contracts of two roots.

    Rows that name no contract keep a null symbol. Groups meet their check by two small aggregates.
    """
    out = parse_contract(df)
    roots = out.groupBy(group).agg(F.min("contract_root").alias("_least"), F.max("contract_root").alias("_most"))
    checked = matched(out, roots, group, salts=SALTS)
    wrong = F.raise_error(F.concat(F.lit("contracts of two roots: "), F.col("_least"), F.lit(", "), F.col("_most")))
    return checked.withColumn("symbol", F.when(F.col("_least") != F.col("_most"), wrong.cast("string")).otherwise(F.col("contract_root"))).drop("_least", "_most")


def full_year(suffix: Column, year: int) -> Column:
    """The year with these last digits that is nearest to ``year`` (the earlier of two)."""
    value, span = suffix.cast("int"), F.pow(F.lit(10), F.length(suffix)).cast("int")
    base = F.lit(year) - F.lit(year) % span
    options = F.array(*[base + value + span * k for k in range(-2, 3)])
    best = F.array_min(F.transform(options, lambda y: F.struct(F.abs(y - F.lit(year)).alias("far"), y.alias("y"))))
    return F.when(F.length(suffix) == 4, value).otherwise(best["y"])


def front_contract(df: DataFrame, month_code: str, year: int, prefer_year: bool = True) -> DataFrame:
    """The contract of the commonest root with this month code, nearest year first, then most rows."""
    counts = parse_contract(df).filter("contract_root is not null").groupBy("contract_symbol", "contract_root", "contract_month_code", "contract_year_suffix").agg(F.count(F.lit(1)).alias("rows"))
    root = counts.groupBy("contract_root").agg(F.sum("rows").alias("_n")).agg(F.max_by("contract_root", F.struct("_n", "contract_root")).alias("contract_root"))
    near = F.abs(full_year(F.col("contract_year_suffix"), year) - year)
    rows = counts.join(F.broadcast(root), "contract_root").filter(F.col("contract_month_code") == month_code)  # one row
    order = [near, F.desc("rows")] if prefer_year else [F.desc("rows"), near]
    return rows.orderBy(*order, "contract_symbol").limit(1).select("contract_symbol", "contract_root", "rows")


def overlap_bounds(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the time range both feeds cover."""
    span = lambda df, p: df.agg(F.min("ts_event").alias(f"{p}0"), F.max("ts_event").alias(f"{p}1"))
    both = span(a, "a").transform(beside, span(b, "b"))  # one row each
    return both.select(F.greatest("a0", "b0").alias("start"), F.least("a1", "b1").alias("end"))


def trim_to_overlap(df: DataFrame, bounds: DataFrame) -> DataFrame:
    out = df.transform(beside, bounds)  # one row
    return out.filter(F.col("ts_event").between(F.col("start"), F.col("end"))).drop("start", "end")


def training_view(df: DataFrame, coverage: float = 0.30) -> DataFrame:
    """Covered, directional rows: by the training flag, else by the event flag, else all of them.

    Which flag holds is decided by counts over the whole table, joined as one row.
    """
    rows = df.filter(F.coalesce("mbp_bar_coverage", F.lit(0.0)) >= coverage) if "mbp_bar_coverage" in df.columns else df
    directional = F.col("bias_label").isin(0, 1)
    found = rows.agg(
        F.max(((F.col("train_event_flag") == 1) & directional).cast("int")).alias("_train"),
        F.max(((F.col("event_flag") == 1) & directional).cast("int")).alias("_event"),
    )
    out = rows.transform(beside, found)  # one row
    keep = F.when(F.col("_train") == 1, F.col("train_event_flag") == 1).when(F.col("_event") == 1, F.col("event_flag") == 1).otherwise(True)
    return out.filter(directional & keep).drop("_train", "_event")


def handle_rare(df: DataFrame, label: str, least: int, strategy: str = "auto") -> DataFrame:
    """Drop classes with fewer rows than ``least``, or merge them in the commonest one.

    ``auto`` drops where there are more than two classes. The class table has one row per class.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.agg(F.count(F.lit(1)).alias("_classes"), F.max_by(label, F.struct("_n", -F.col(label))).alias("_major"))
    table = counts.transform(beside, whole)  # one row
    out = matched(df, table, label, "left", salts=SALTS)
    rare = F.col("_n") < least
    drop = F.lit(strategy == "drop") | (F.lit(strategy == "auto") & (F.col("_classes") > 2))
    out = out.filter(~(rare & drop)).withColumn(label, F.when(rare, F.col("_major")).otherwise(F.col(label)))
    return out.drop("_n", "_classes", "_major")


def stratified_sample(df: DataFrame, rows: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Evenly spaced rows of each key, first and last among them."""
    placed = numbered(df, "_at", keys=keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = matched(placed, sizes, keys, salts=SALTS)
    # Position p is picked when some i in 0..rows-1 has round(i·(n-1)/(rows-1)) = p; ties go to even.
    step = (F.col("_n") - 1) / F.lit(float(max(rows - 1, 1)))
    i = F.rint(F.col("_at") / step)
    picked = F.lit(False)
    for k in (-1, 0, 1):
        j = i + k
        picked = picked | ((j >= 0) & (j <= rows - 1) & (F.rint(j * step) == F.col("_at")))
    return out.filter((F.col("_n") <= rows) | picked).drop("_at", "_n")


def stride_sample(df: DataFrame, stride: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every stride-th row of a key and its last one, marked; other rows stay unmarked."""
    placed = numbered(df, "_at", keys=keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = matched(placed, sizes, keys, salts=SALTS)
    whole = F.col("_n") <= stride
    mark = whole | (F.col("_at") % stride == 0) | (F.col("_at") == F.col("_n") - 1)
    return out.withColumn("sampled", mark).drop("_at", "_n")


def expand_sample(df: DataFrame, label: str) -> DataFrame:
    """Carry the labels of sampled rows forward over the rows between."""
    return running(df, {f"{label}_expanded": ("last", F.when(F.col("sampled"), F.col(label)))})


def fill_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All named columns as doubles: absent, null, NaN and infinite values become 0."""
    from tapeloom.functions.market import finite

    return df.withColumns({n: F.coalesce(finite(F.col(n)), F.lit(0.0)) if n in df.columns else F.lit(0.0) for n in names})


def ensure_price(df: DataFrame) -> DataFrame:
    """Take ``close`` for ``price`` where the table has no usable price at all."""
    if "close" not in df.columns:
        return df
    if "price" not in df.columns:
        return df.withColumn("price", F.col("close").cast("double"))
    top = df.agg(F.max(F.abs(F.nanvl(F.col("price").cast("double"), F.lit(0.0)))).alias("_top"))
    out = df.transform(beside, top)  # one row
    return out.withColumn("price", F.when(F.coalesce("_top", F.lit(0.0)) < 1e-12, F.col("close")).otherwise(F.col("price"))).drop("_top")


def expand_compact(rows: DataFrame, covered: str, compact: DataFrame, value: str) -> DataFrame:
    """Put the values of a compact table (symbol, position) back on the covered rows; 0 elsewhere."""
    marked = running(rows, {"_k": ("sum", F.col(covered).cast("long"))})
    marked = marked.withColumn("_pos", F.when(F.col(covered), F.col("_k") - 1))
    source = compact.select("symbol", F.col("position").alias("_pos"), F.col(value))
    return matched(marked, source, ["symbol", "_pos"], "left").withColumn(value, F.coalesce(value, F.lit(0.0))).drop("_k", "_pos")


def context_slice(df: DataFrame, start, end, warmup: int, tail: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Rows in [start, end] of each key, with some rows before and after, marked ``in_range``."""
    placed = numbered(df, "_at", keys=keys, order=order).withColumn("in_range", F.col("ts_event").between(F.lit(start), F.lit(end)))
    ends = placed.filter("in_range").groupBy(*keys).agg(F.min("_at").alias("_a"), F.max("_at").alias("_b"))
    out = matched(placed, ends, keys, salts=SALTS)
    return out.filter(F.col("_at").between(F.col("_a") - warmup, F.col("_b") + tail)).drop("_at", "_a", "_b")
