"""The whole way from raw feeds to a labelled, split and checked dataset, as one lazy plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import asof, clean, labels, snapshots, splits
from tapeloom.operators.evaluate import label_distribution
from tapeloom.operators.ordered import beside, sized
from tapeloom.runtime import brief_shuffles, discard, written
from tapeloom.sources import tables

KEYS = ["symbol", "ts_event", "sequence"]
LABELS = [
    "bias_label",
    "tradeability_label",
    "event_flag",
    "train_event_flag",
    "label_end_ts",
    "horizon_end_ts",
    "label_horizon_steps",
    "barrier_hit_type",
    "realized_return",
    "upper_barrier",
    "lower_barrier",
    "neutral_distance",
]


#: The levels of a snapshot, which no feature of the written tables is.
ARRAYS = ["bid_px", "ask_px", "bid_sz", "ask_sz", "mlofi"]


def _changes(ticks: DataFrame, book: DataFrame, tick: float) -> DataFrame:
    """Snapshots that hold, with the flow state before them and what has changed since the one before."""
    rows = asof.align_flow(clean.reject_invalid_books(book, tick), asof.flow_state(ticks))
    rows = snapshots.with_mlofi(snapshots.top_of_book(rows))
    return snapshots.interval_flow(snapshots.price_change(rows, tick))


def features(ticks: DataFrame, book: DataFrame, tick: float, frames: tuple[int, ...] = snapshots.ROLLING) -> DataFrame:
    """Snapshots that hold, each with the flow state before it and everything derived from both."""
    rows = snapshots.rolling(_changes(ticks, book, tick), tick, frames)
    return snapshots.compat_features(snapshots.clock_features(rows), tick)


def labelled(ticks: DataFrame, book: DataFrame, rule: labels.BarrierRule, frames: tuple[int, ...] = snapshots.ROLLING, arrays: bool = True) -> DataFrame:
    """Features with cost-aware first-barrier labels and their end times; ``arrays``: also the levels they are made of.

    What looks back at the row before comes first, so that all frames take one pass and the barriers another, and
    what each row tells by itself comes last, so that it isn't shuffled.
    """
    with sized(ticks.select("symbol"), ["symbol"]):
        rows = labels.price_step(snapshots.cvd_step(_changes(ticks, book, rule.tick)))
        rows = snapshots.rolling(rows if arrays else rows.drop(*ARRAYS), rule.tick, frames, labels.USUAL_STEP)
        rows = labels.triple_barrier(rows.withColumn("_filled", F.col("realized_vol")), rule, vol="_filled", stepped=True)
        rows = snapshots.compat_features(snapshots.clock_features(rows), rule.tick, stepped=True)  # of the volatility as it was measured
        return rows.withColumn("realized_vol", F.col("_filled")).drop("_filled")


def feature_names(rows: DataFrame) -> list[str]:
    """Columns that may feed a model: no keys, labels, placeholders, arrays or forbidden names."""
    out = set(rows.columns) - set(KEYS) - set(LABELS) - set(snapshots.compat_placeholders())
    out -= {n for n, t in rows.dtypes if t.startswith(("array", "timestamp", "string", "struct"))}
    return sorted(out - set(splits.forbidden_columns(sorted(out))))


def write(rows: DataFrame, root: str) -> DataFrame:
    """Write features, labels and metadata, with a manifest."""
    names = feature_names(rows)
    return tables.write_artifact(root, rows.select(*KEYS, *names), rows.select(*KEYS, *LABELS), rows.select(*KEYS), {"schema_version": "1"})


# ------------------------------------------------------------------------------ the artifact
REPORTS = ["data_validation", "symbols_before_filters", "feature_report", "label_distribution", "leakage_report", "shards"]


def _only(df: DataFrame, symbol) -> DataFrame:
    return df if symbol is None else df.filter(F.col("symbol") == F.lit(symbol))


def validation(ticks: DataFrame, book: DataFrame, tick: float, symbol=None, max_rows: int = 0) -> DataFrame:
    """One row: rows after each filter, the share of snapshots with a flow state, and what speaks against writing.

    ``max_rows`` refuses larger datasets, it never cuts them (0: no limit).
    """
    t, b = _only(ticks, symbol), _only(book, symbol)
    valid = clean.reject_invalid_books(b, tick)
    rows = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    flow = asof.align_flow(valid.select(*KEYS), asof.flow_state(t)).agg(F.count(F.lit(1)).alias("feature_rows"), F.count("mbo_state_ts").alias("matched_rows"))
    out = reduce(beside, [rows(t, "tick_rows"), rows(b, "book_rows"), flow])
    out = out.withColumn("match_rate", F.col("matched_rows") / F.greatest("feature_rows", F.lit(1)))
    c, listed = F.col, lambda rules: F.concat_ws(",", *[F.when(test, F.lit(name)) for name, test in rules.items()])
    critical = {
        "empty_ticks_after_filters": c("tick_rows") == 0,
        "empty_book_after_filters": c("book_rows") == 0,
        "no_valid_book_rows": (c("book_rows") > 0) & (c("feature_rows") == 0),
        "max_rows_exceeded": (F.lit(max_rows) > 0) & (c("feature_rows") > max_rows),
    }
    warnings = {"book_rows_rejected": c("feature_rows") < c("book_rows"), "low_match_rate": (c("feature_rows") > 0) & (c("match_rate") < 0.5)}
    out = out.withColumns({"critical": listed(critical), "warnings": listed(warnings)})
    return out.withColumn("passed", F.col("critical") == "")


def symbol_counts(ticks: DataFrame, book: DataFrame) -> DataFrame:
    """Rows of each symbol in both feeds before any filter."""
    count = lambda df, feed: df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(feed).alias("feed"), "symbol", "rows")
    return count(ticks, "ticks").unionByName(count(book, "book"))


def feature_report(rows: DataFrame, names: list[str]) -> DataFrame:
    """Of each feature: nulls, mean, smallest and largest value, and whether it varies. One pass."""
    cells = [
        F.struct(
            F.lit(n).alias("feature"), (F.count(F.lit(1)) - F.count(n)).alias("nulls"), F.avg(F.col(n).cast("double")).alias("mean"),
            F.min(F.col(n).cast("double")).alias("min"), F.max(F.col(n).cast("double")).alias("max"),
        )
        for n in names
    ]
    out = rows.agg(F.array(*cells).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    return out.withColumn("varies", F.coalesce(F.col("min") < F.col("max"), F.lit(False)))


def prepare(ticks: DataFrame, book: DataFrame, rule: labels.BarrierRule, root: str, *, frames: tuple[int, ...] = snapshots.ROLLING, symbol=None, max_rows: int = 0, dry_run: bool = False) -> DataFrame:
    """Check the feeds, then write the artifact and its reports under ``root``; returns the validation row.

    The validation and the symbol counts are written first, also when nothing else is: on a dry run,
    and when something critical was found, which raises.
    """
    spark = ticks.sparkSession
    tables.write_report(symbol_counts(ticks, book), f"{root}/symbols_before_filters")
    report = validation(ticks, book, rule.tick, symbol, max_rows)
    tables.write_report(report, f"{root}/data_validation")
    report = spark.read.schema(report.schema).json(f"{root}/data_validation")
    found = report.first()
    if dry_run:
        return report
    if not found["passed"]:
        raise RuntimeError(f"data validation failed: {found['critical']}")
    with brief_shuffles(spark):
        _write_all(labelled(_only(ticks, symbol), _only(book, symbol), rule, frames, arrays=False), root)
    return report


def _write_all(rows: DataFrame, root: str) -> None:
    """The artifact of labelled rows and its reports."""
    spark = rows.sparkSession
    price = F.coalesce("mid_price", "microprice")
    rows = rows.withColumns({"open": price, "high": price, "low": price, "raw__cvd": F.col("mbo_cvd")})
    weights = {"soft_sample_weight": F.lit(1.0), "mc_sample_weight": F.lit(1.0)}
    names = feature_names(rows)
    extra = ["mbo_state_ts"]
    rows = written(rows.select(*dict.fromkeys([*KEYS, *names, *LABELS, *extra])), "labelled")  # read for three tables
    tables.write_artifact(root, rows.select(*KEYS, *names), rows.select(*KEYS, *LABELS).withColumns(weights), rows.select(*KEYS, *extra), {"schema_version": "1"})
    discard(rows)
    done = tables.load_artifact(spark, root)
    loaded, times = tables.load_features(spark, root)
    tables.write_report(feature_report(loaded, names), f"{root}/feature_report")
    discard(times)
    tables.write_report(label_distribution(done), f"{root}/label_distribution")
    tables.write_report(splits.leakage_report(done.withColumn("feature_ts", F.coalesce("mbo_state_ts", "ts_event")), names), f"{root}/leakage_report")
    tables.write_report(tables.shard_report(spark, f"{root}/features"), f"{root}/shards")
