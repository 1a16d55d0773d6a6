"""Array features of bars and rows for sequence models, as array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import book as B
from tapeloom.functions.market import is_buy, is_sell, is_trade
from tapeloom.operators.bars import BAR_KEYS, with_bar
from tapeloom.operators.ordered import beside, exact_quantiles, windowed

LEVELS = B.LEVELS


def _usual_size(ticks: DataFrame) -> DataFrame:
    q = exact_quantiles(ticks.filter("size <> 0"), {"_q": "size"}, [0.5])
    return q.select(F.greatest(F.coalesce(F.get("_q", 0), F.lit(1.0)), F.lit(1e-6)).alias("_usual"))


def bar_snapshots(snapshots: DataFrame, freq: str) -> DataFrame:
    """The most lopsided snapshot of each bar: best quotes and log depth of both sides."""
    b, a = B.depth("bid_sz"), B.depth("ask_sz")
    early = (-F.unix_micros(F.col("ts_event").cast("timestamp"))).alias("t"), (-F.col("sequence")).alias("s")
    best = F.max_by(F.struct("bid_px", "ask_px", "bid_sz", "ask_sz"), F.struct(F.abs((b - a) / (b + a + 1e-9)).alias("m"), *early))
    bars = with_bar(snapshots, freq).groupBy(*BAR_KEYS).agg(best.alias("_b"))
    sizes = F.concat("_b.bid_sz", "_b.ask_sz")
    return bars.select(*BAR_KEYS, F.get("_b.bid_px", 0).alias("bid0"), F.get("_b.ask_px", 0).alias("ask0"), F.transform(sizes, lambda x: F.log1p(F.greatest(x, F.lit(0.0)))).alias("depth"))


def footprint(ticks: DataFrame, tops: DataFrame, freq: str, levels: int = LEVELS) -> DataFrame:
    """Traded size per bar, side and distance from the best quote in spreads, over the usual size, as arrays."""
    trades = with_bar(ticks.filter(is_trade() & (F.col("size") > 0) & (F.col("price") > 0)), freq)
    rows = trades.join(tops.filter("ask0 > bid0 and bid0 > 0").select(*BAR_KEYS, "bid0", "ask0"), BAR_KEYS)
    gap = F.col("ask0") - F.col("bid0")
    away = F.when(is_buy(), F.abs((F.col("price") - F.col("ask0")) / gap)).when(is_sell(), F.abs((F.col("bid0") - F.col("price")) / gap))
    level = F.least(F.rint(away), F.lit(float(levels - 1))).cast("int")
    rows = rows.withColumns({"_level": level, "_buy": is_buy()}).filter("_level is not null")
    cells = rows.transform(beside, _usual_size(ticks))  # one row
    part = F.col("size") / F.col("_usual")
    sums = lambda buy: [F.sum(F.when((F.col("_buy") == buy) & (F.col("_level") == i), part).otherwise(0.0)) for i in range(levels)]
    return cells.groupBy(*BAR_KEYS).agg(F.array(*sums(True)).alias("buy_footprint"), F.array(*sums(False)).alias("sell_footprint"))


def _zeros(n: int):
    return F.array_repeat(F.lit(0.0), n)


def _rolled(bars: DataFrame, steps: int, width: int) -> DataFrame:
    """The last ``steps`` bars' vectors (column _v, null where a bar has none), oldest first, zeros in front."""
    w = Window.partitionBy("symbol").orderBy("bar_ts").rowsBetween(-(steps - 1), 0)  # one row per bar
    have = F.sum(F.when(F.col("_v").isNotNull(), 1).otherwise(0)).over(w)
    filled = F.collect_list(F.coalesce("_v", _zeros(width))).over(w)
    out = bars.withColumns({"_list": filled, "coverage": have / F.lit(float(steps))})
    pad = F.array_repeat(_zeros(width), F.greatest(F.lit(steps) - F.size("_list"), F.lit(0)))
    return out.withColumn("tensor", F.concat(pad, "_list")).drop("_list", "_v")


def book_tensors(bars: DataFrame, ticks: DataFrame, snapshots: DataFrame, freq: str, steps: int = 50, levels: int = LEVELS) -> DataFrame:
    """Per bar the last bars' depth and trade footprints: steps by (2·levels·3) numbers.

    Channels follow each other: log depth of all levels, buyers' footprint on the ask half,
    sellers' on the bid half.
    """
    tops = bar_snapshots(snapshots, freq)
    prints = footprint(ticks, tops, freq, levels)
    out = bars.select(*BAR_KEYS).join(tops, BAR_KEYS, "left").join(prints, BAR_KEYS, "left")
    none = _zeros(levels)
    vector = F.concat("depth", none, F.coalesce("buy_footprint", none), F.coalesce("sell_footprint", none), none)
    out = out.withColumn("_v", F.when(F.col("depth").isNotNull(), vector))
    return _rolled(out.select(*BAR_KEYS, "_v"), steps, 6 * levels)


def flow_tensors(bars: DataFrame, ticks: DataFrame, freq: str, steps: int = 50) -> DataFrame:
    """Without a book: imbalance and the sides' traded size of the last bars, three numbers a step."""
    size = F.col("size").cast("double")
    q = exact_quantiles(ticks, {"_q": "size"}, [0.5]).select(F.greatest(F.coalesce(F.get("_q", 0), F.lit(1.0)), F.lit(1e-6)).alias("_usual"))
    sums = with_bar(ticks, freq).groupBy(*BAR_KEYS).agg(
        F.sum(F.when(is_buy(), size).otherwise(0.0)).alias("b"), F.sum(F.when(is_sell(), size).otherwise(0.0)).alias("s"),
        F.sum(F.when(is_buy() & is_trade(), size).otherwise(0.0)).alias("bt"), F.sum(F.when(is_sell() & is_trade(), size).otherwise(0.0)).alias("st"),
    )
    sums = sums.transform(beside, q)  # one row
    vector = F.array((F.col("b") - F.col("s")) / F.greatest(F.col("b") + F.col("s"), F.lit(1.0)), F.col("bt") / F.col("_usual"), F.col("st") / F.col("_usual"))
    out = bars.select(*BAR_KEYS).join(sums.select(*BAR_KEYS, vector.alias("_v")), BAR_KEYS, "left")
    return _rolled(out, steps, 3)


def normalise_channels(tensors: DataFrame, channels: int, least: int = 10, eps: float = 1e-12) -> DataFrame:
    """Centre and scale each channel by its cells that are not 0, over the whole table.

    Every row sums up its own cells first; only three numbers per channel leave the row.
    """
    width = F.size(F.get("tensor", 0)) / channels

    def cells(c: int):
        return F.flatten(F.transform("tensor", lambda v: F.slice(v, (width * c + 1).cast("int"), width.cast("int"))))

    aggs = []
    for c in range(channels):
        full = F.filter(cells(c), lambda x: F.abs(x) > eps)
        total = lambda f, a=full: F.aggregate(F.transform(a, f), F.lit(0.0), lambda x, y: x + y)
        aggs += [F.sum(F.size(full)).alias(f"n{c}"), F.sum(total(lambda x: x)).alias(f"s{c}"), F.sum(total(lambda x: x * x)).alias(f"q{c}")]
    stats = tensors.agg(*aggs)
    for c in range(channels):
        mean = F.col(f"s{c}") / F.col(f"n{c}")
        std = F.sqrt(F.greatest(F.col(f"q{c}") / F.col(f"n{c}") - mean * mean, F.lit(0.0)))
        ok = (F.col(f"n{c}") >= least) & (std > 1e-8)
        stats = stats.withColumns({f"_m{c}": F.when(ok, mean).otherwise(0.0), f"_d{c}": F.when(ok, std).otherwise(1.0)})
    means, devs = F.array(*[f"_m{c}" for c in range(channels)]), F.array(*[f"_d{c}" for c in range(channels)])
    out = tensors.transform(beside, stats.select(means.alias("_means"), devs.alias("_devs")))  # one row
    channel = lambda i: F.floor(i / width).cast("int")
    scaled = F.transform("tensor", lambda v: F.transform(v, lambda x, i: (x - F.get("_means", channel(i))) / F.get("_devs", channel(i))))
    return out.withColumn("tensor", scaled).drop("_means", "_devs")


def sequences(rows: DataFrame, features: Sequence[str], steps: int, covered: str, part: str, min_coverage: float = 0.80) -> DataFrame:
    """The last ``steps`` rows' features per row; only full ones that stay in one part of the split and are covered well enough."""

    def gather(df, w):
        f = w.rowsBetween(-(steps - 1), 0)
        return df.withColumns(
            {
                "sequence_features": F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(f),
                "_parts": F.min(part).over(f) == F.max(part).over(f),
                "_cover": F.avg(F.col(covered).cast("double")).over(f),
            }
        )

    out = windowed(rows, gather, before=steps)
    keep = (F.size("sequence_features") == steps) & F.col("_parts") & F.col(covered) & (F.col("_cover") >= min_coverage)
    return out.filter(keep).drop("_parts", "_cover")


def past_windows(rows: DataFrame, features: Sequence[str], steps: int, event: str) -> DataFrame:
    """For event rows with enough past: the features of the ``steps`` rows before."""

    def gather(df, w):
        return df.withColumn("window", F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(w.rowsBetween(-steps, -1)))

    return windowed(rows, gather, before=steps).filter(F.col(event) & (F.size("window") == steps))


def rolling_summary(rows: DataFrame, columns: Sequence[str], n: int = 20) -> DataFrame:
    """Mean, deviation, least and greatest of the last n rows."""

    def stats(df, w):
        f, out = w.rowsBetween(-(n - 1), 0), {}
        for c in columns:
            out |= {f"{c}_mean": F.avg(c).over(f), f"{c}_std": F.stddev_pop(c).over(f) + 1e-8, f"{c}_min": F.min(c).over(f), f"{c}_max": F.max(c).over(f)}
        return df.withColumns(out)

    return windowed(rows, stats, before=n)
