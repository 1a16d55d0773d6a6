"""Time splits that cannot leak, as tables (fold, row, role), and checks on them.

Rows are numbered in time order across the whole table. A split is a handful of positions and
times, so folds travel as a short array, never as a join.
"""

from __future__ import annotations

from itertools import combinations
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.ordered import beside, exact_quantiles, numbered

TIME = ("ts_event", "sequence")
# Parts of a name that no feature may have.
FORBIDDEN_TOKENS = ["label", "target", "future", "forward", "end_ts", "path_outcome"]


def in_time_order(df: DataFrame) -> DataFrame:
    return numbered(df, "pos", keys=(), order=TIME)


Folds = Sequence[tuple[int, int, int]]  # (fold, first test position, position after the last)


def _assign(rows: DataFrame, folds: Folds, embargo_before: int = 0) -> DataFrame:
    """Roles from positions: a train row and its label end before the first test time."""
    if not folds:
        return rows.withColumns({"fold": F.lit(0).cast("long"), "role": F.lit("train")}).limit(0)
    first = lambda a: F.max(F.when(F.col("pos") == a, F.col("ts_event")))
    cells = [F.struct(F.lit(k).cast("long").alias("fold"), F.lit(a).alias("a"), F.lit(b).alias("b"), first(a).alias("t")) for k, a, b in folds]
    out = rows.transform(beside, rows.agg(F.array(*cells).alias("_folds"))).withColumn("_f", F.explode("_folds"))
    pos, f = F.col("pos"), F.col("_f")
    train = (F.col("ts_event") < f["t"]) & (F.col("label_end_ts") < f["t"]) & (pos < f["a"] - embargo_before)
    role = F.when((pos >= f["a"]) & (pos < f["b"]), "test").when(train, "train")
    return out.withColumns({"fold": f["fold"], "role": role}).filter("role is not null").drop("_folds", "_f")


def _keep_large(split: DataFrame, min_train: int, min_test: int, renumber: bool = True) -> DataFrame:
    sizes = split.groupBy("fold").agg(F.sum((F.col("role") == "train").cast("int")).alias("_train"), F.sum((F.col("role") == "test").cast("int")).alias("_test"))
    good = sizes.filter((F.col("_train") >= min_train) & (F.col("_test") >= min_test)).select("fold")
    good = good.withColumn("_no", F.row_number().over(Window.orderBy("fold")))  # one row per fold
    out = split.join(F.broadcast(good), "fold")
    return out.withColumn("fold", F.col("_no") if renumber else F.col("fold")).drop("_no")


def purged_walk_forward(df: DataFrame, n_folds: int = 5, initial_train: float = 0.50, test: float = 0.10, embargo_rows: int = 0, min_train: int = 100, min_test: int = 20) -> DataFrame:
    """Test blocks after a first training part; train rows whose label reaches a test are dropped."""
    n = df.count()
    first, size = max(int(n * initial_train), min_train), max(int(n * test), min_test)
    folds = [(k, first + k * size, min(first + (k + 1) * size, n)) for k in range(n_folds)]
    folds = [f for f in folds if f[1] < n and f[2] - f[1] >= min_test]
    return _keep_large(_assign(in_time_order(df), folds, embargo_rows), min_train, 1)


def expanding_blocks(n: int, n_folds: int, test: float, min_train_share: float, min_train_rows: int) -> list[tuple[int, int, int]]:
    """Positions of equal test blocks over all rows after the first training part."""
    size = max(1, int(n * test))
    start = min(max(int(n * min_train_share), min_train_rows), max(size + 50, n - size))
    rows = n - start
    if rows <= 0:
        return []
    blocks = min(max(n_folds, -(-rows // size), 1), rows)
    # the first rows % blocks blocks hold one row more
    cuts = [start + i * (rows // blocks) + min(i, rows % blocks) for i in range(blocks + 1)]
    return list(zip(range(blocks), cuts, cuts[1:]))


def expanding_walk_forward(df: DataFrame, n_folds: int = 6, test: float = 0.10, min_train_share: float = 0.20, min_train_rows: int = 200) -> DataFrame:
    """Expanding training set with test blocks over the rest; more folds than asked where blocks would be too long.

    An embargo after the test never applies here, as training rows come before it.
    """
    folds = expanding_blocks(df.count(), n_folds, test, min_train_share, min_train_rows)
    return _keep_large(_assign(in_time_order(df), folds), 50, 10)


def drop_embargoed(split: DataFrame, share: float = 0.01) -> DataFrame:
    """Drop training rows in the stretch after a test block, where training reaches past the test."""
    ends = split.groupBy("fold").agg(F.max(F.when(F.col("role") == "test", F.col("pos"))).alias("_te"), F.max(F.when(F.col("role") == "train", F.col("pos"))).alias("_tr"))
    length = F.greatest(F.lit(1), F.floor((F.greatest("_te", "_tr") + 1) * share))
    ends = ends.withColumn("_len", length)
    out = split.join(F.broadcast(ends), "fold")  # one row per fold
    hit = (F.col("role") == "train") & (F.col("_tr") > F.col("_te")) & (F.col("pos") > F.col("_te")) & (F.col("pos") <= F.col("_te") + F.col("_len"))
    return out.filter(~F.coalesce(hit, F.lit(False))).drop("_te", "_tr", "_len")


def combinatorial(df: DataFrame, groups: int = 6, test_groups: int = 2, embargo: float = 0.01) -> DataFrame:
    """Every choice of test groups; train rows whose label reaches the earliest test time are dropped."""
    size = max(df.count() // groups, 1)
    rows = in_time_order(df).withColumn("grp", F.least(F.floor(F.col("pos") / size), F.lit(groups - 1)))
    starts = rows.agg(F.array(*[F.min(F.when(F.col("grp") == g, F.col("ts_event"))) for g in range(groups)]).alias("_starts"))
    choices = [
        F.struct(F.lit(k).cast("long").alias("fold"), F.array(*[F.lit(g) for g in chosen]).alias("tests"), F.array_min(F.array(*[F.get("_starts", g) for g in chosen])).alias("t"))
        for k, chosen in enumerate(combinations(range(groups), test_groups))
    ]
    out = rows.transform(beside, starts).withColumn("_f", F.explode(F.array(*choices)))
    f = F.col("_f")
    role = F.when(F.array_contains(f["tests"], F.col("grp").cast("int")), "test").when(F.col("label_end_ts") < f["t"], "train")
    out = out.withColumns({"fold": f["fold"], "role": role}).filter("role is not null").drop("_starts", "_f", "grp")
    return _keep_large(drop_embargoed(out, embargo), 30, 5, renumber=False)


def fold_report(split: DataFrame) -> DataFrame:
    """Per fold: rows, times and whether training ends, with its labels, before the test starts."""
    train, test = F.col("role") == "train", F.col("role") == "test"
    out = split.groupBy("fold").agg(
        F.sum(train.cast("int")).alias("train_rows"),
        F.sum(test.cast("int")).alias("test_rows"),
        F.max(F.when(train, F.col("ts_event"))).alias("train_end_ts"),
        F.max(F.when(train, F.col("label_end_ts"))).alias("train_max_label_end_ts"),
        F.min(F.when(test, F.col("ts_event"))).alias("test_start_ts"),
        F.max(F.when(test, F.col("ts_event"))).alias("test_end_ts"),
    )
    return out.withColumns({"chronological": F.col("train_end_ts") < F.col("test_start_ts"), "labels_before_test": F.col("train_max_label_end_ts") < F.col("test_start_ts")})


def walk_forward_windows(df: DataFrame, n_splits: int, initial_train: float, test: float, min_train: int) -> DataFrame:
    """Windows of whole months where there are six of them, else of equal row counts."""
    months = df.groupBy(F.date_format("ts_event", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("ts_event").alias("first"), F.max("ts_event").alias("last"))
    if months.count() >= 6:
        w = Window.orderBy("month")  # one row per month
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        out = months.withColumns({"train_rows": F.sum("n").over(before), "train_start": F.min("first").over(before), "train_end": F.max("last").over(before)})
        out = out.filter((F.col("train_rows") >= min_train) & (F.col("n") > 10))
        return out.select(
            F.row_number().over(w).cast("long").alias("fold"), F.lit("monthly_expanding").alias("mode"), "train_start", "train_end",
            F.col("first").alias("test_start"), F.expr("last + INTERVAL 1 MICROSECOND").alias("test_end"), "train_rows", F.col("n").alias("test_rows"),
        )
    n = df.count()
    first, size = max(int(n * initial_train), min_train), max(int(n * test), 1)
    folds = [(k + 1, first + k * size, min(first + (k + 1) * size, n)) for k in range(max(n_splits, 3))]
    folds = [f for f in folds if f[1] < n and f[2] - f[1] > 10]
    at = lambda p: F.max(F.when(F.col("pos") == p, F.col("ts_event")))
    cells = [
        F.struct(
            F.lit(k).cast("long").alias("fold"), F.lit("chronological_expanding").alias("mode"), at(0).alias("train_start"), at(a - 1).alias("train_end"), at(a).alias("test_start"),
            (at(b - 1) + F.expr("INTERVAL 1 MICROSECOND")).alias("test_end"), F.lit(a).cast("long").alias("train_rows"), F.lit(b - a).cast("long").alias("test_rows"),
        )
        for k, a, b in folds
    ]
    return in_time_order(df.select("ts_event", "sequence")).agg(F.array(*cells).alias("c")).select(F.explode("c").alias("f")).select("f.*")


def split_plan(df: DataFrame, n_folds: int = 6, test: float = 0.10, embargo: float = 0.02, min_train_share: float = 0.20, quantile: float = 0.95) -> DataFrame:
    """One row: embargo from the horizon's percentile, and how many folds the data carries."""
    horizon = df.filter(F.col("bias_label").isin(0, 1)).select("label_horizon_steps")
    q = exact_quantiles(horizon, {"_q": "label_horizon_steps"}, [quantile]).select(F.coalesce(F.ceil(F.get("_q", 0)), F.lit(0)).alias("horizon_rows"))
    n = F.col("n")
    out = df.agg(F.count(F.lit(1)).alias("n")).transform(beside, q)  # one row each
    size = F.greatest(F.lit(1), F.floor(n * test))
    first = F.least(F.greatest(F.floor(n * min_train_share), F.lit(200)), F.greatest(size + 50, n - size))
    tail = F.greatest(F.lit(0), n - first)
    cap = F.greatest(F.lit(1), F.floor(tail / F.when(n >= 3000, 500).otherwise(350)))
    folds = F.when(n < 300, 1).when(tail > 0, F.greatest(F.lit(3), F.least(F.lit(n_folds), cap))).otherwise(1)
    rows = F.when(n < 300, 0).otherwise(F.greatest(F.ceil(n * embargo), F.col("horizon_rows")))
    return out.select(n.alias("rows"), rows.alias("embargo_rows"), (rows / F.greatest(n, F.lit(1))).alias("embargo_share"), folds.alias("folds"), (n < 300).alias("tiny_fallback"))


def inner_split(split: DataFrame, share: float = 0.15, least: int = 50) -> DataFrame:
    """Cut each fold's training rows in train and validation, the latest rows being validation."""
    train = numbered(split.filter("role = 'train'"), "_i", keys=("fold",), order=("pos",))
    sizes = train.groupBy("fold").agg(F.count(F.lit(1)).alias("_n"))
    val = F.least(F.greatest(F.lit(least), F.floor(F.col("_n") * share)), F.col("_n") - 50)
    sizes = sizes.withColumn("_val", val).filter((F.col("_n") >= max(100, least * 2)) & (F.col("_val") >= least))
    train = train.join(F.broadcast(sizes), "fold")  # one row per fold
    is_val = F.col("_i") >= F.col("_n") - F.col("_val")
    starts = train.groupBy("fold").agg(F.min(F.when(is_val, F.col("ts_event"))).alias("_from"))
    train = train.join(F.broadcast(starts), "fold")
    role = F.when(is_val, "validation").when(F.col("label_end_ts") < F.col("_from"), "train")
    return train.withColumn("role", role).filter("role is not null").drop("_i", "_n", "_val", "_from")


def growing_split(df: DataFrame, n_splits: int = 4, min_train_share: float = 0.3) -> DataFrame:
    """Equal steps in time order: train on all before, test on the next."""
    n = df.count()
    step = n // (n_splits + 1)
    folds = [(i, step * i, min(step * (i + 1), n)) for i in range(1, n_splits + 1) if step * i >= int(n * min_train_share)]
    cells = [F.struct(F.lit(k).cast("long").alias("fold"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in folds]
    rows = in_time_order(df).withColumn("_f", F.explode(F.array(*cells)))
    f = F.col("_f")
    role = F.when(F.col("pos") < f["a"], "train").when(F.col("pos") < f["b"], "test")
    return rows.withColumns({"fold": f["fold"], "role": role}).filter("role is not null").drop("_f")


def chronological_split(df: DataFrame, share: float) -> DataFrame:
    n = df.count()
    cut = min(max(int(n * share), 1), n - 1)
    return in_time_order(df).withColumn("role", F.when(F.col("pos") < cut, "train").otherwise("holdout"))


def tail_share(df: DataFrame, share: float = 0.60, least: int = 10) -> DataFrame:
    """The latest share of the rows."""
    n = df.count()
    return in_time_order(df).filter(F.col("pos") >= n - max(int(n * share), least)).drop("pos")


def label_violations(df: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """One row: labels that end before their row, or at or after a cutoff."""
    late = F.col("label_end_ts") >= cutoff if cutoff is not None else F.lit(False)
    out = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.col("label_end_ts") < F.col("ts_event")).cast("int")).alias("invalid_label_horizons"),
        F.sum(late.cast("int")).alias("leaking_rows"),
        F.max("label_end_ts").alias("max_label_end_ts"),
    )
    return out.withColumn("passed", (F.col("invalid_label_horizons") == 0) & (F.col("leaking_rows") == 0))


def forbidden_columns(names: Sequence[str]) -> list[str]:
    return [n for n in names if any(t in n.lower() for t in FORBIDDEN_TOKENS)]


def schema_check(df: DataFrame, features: Sequence[str], required: Sequence[str] = ("ts_event", "label_end_ts", "bias_label")) -> DataFrame:
    """One row: rows, missing required columns and features that would leak."""
    missing, bad = [c for c in required if c not in df.columns], forbidden_columns(features)
    lit = lambda values: F.concat_ws(",", F.array(*[F.lit(v) for v in values])) if values else F.lit("")
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", lit(missing).alias("missing_columns"), lit(bad).alias("forbidden_features"), F.lit(not missing and not bad).alias("passed"))


def leakage_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: label times, feature names and feature times checked together."""
    checks = label_violations(df).select("rows", "invalid_label_horizons", "max_label_end_ts")
    late = df.agg(F.sum((F.col("feature_ts") > F.col("ts_event")).cast("int")).alias("feature_after_start_rows"))
    names = forbidden_columns(features)
    out = checks.transform(beside, late)  # one row each
    return out.withColumns({"forbidden_features": F.lit(len(names)), "passed": (F.col("invalid_label_horizons") == 0) & (F.col("feature_after_start_rows") == 0) & F.lit(not names)})


def out_of_sample(df: DataFrame, split_ts: Column, same_dataset: bool) -> DataFrame:
    """One row: may these rows be scored? Only after the split, in a pure holdout, or on other data."""
    out = df.agg(F.min("ts_event").alias("first_ts"), F.min((F.col("dataset_slice") == "holdout").cast("int")).alias("_pure"))
    reason = F.when(F.lit(not same_dataset), "no_overlap_detected").when(F.col("_pure") == 1, "same_dataset_holdout_only").when(F.col("first_ts") >= split_ts, "post_split_window_only").otherwise("same_training_dataset")
    return out.withColumn("reason", reason).withColumn("allowed", F.col("reason") != "same_training_dataset").drop("_pure")


def cost_check(configs: DataFrame) -> DataFrame:
    """Errors and warnings per row of cost and latency parameters."""
    c = F.col
    warn = {
        "round_trip_cost_pips_is_zero": c("round_trip_cost_pips") <= 0,
        "commission_per_side_is_zero": c("commission_per_side") <= 0,
        "min_spread_ticks_below_one": c("min_spread_ticks") < 1.0,
        "min_slippage_ticks_below_half_tick": c("min_slippage_ticks") < 0.5,
        "latency_rows_zero_or_negative": c("latency_rows") <= 0,
    }
    negative = (c("round_trip_cost_pips") < 0) | (c("commission_per_side") < 0) | (c("min_spread_ticks") < 0) | (c("min_slippage_ticks") < 0)
    error = {"tick_size_must_be_positive": c("tick_size") <= 0, "tick_value_must_be_positive": c("tick_value") <= 0, "negative_cost_parameter": negative, "max_size_must_be_positive": c("max_size") <= 0}
    listed = lambda rules: F.concat_ws(",", *[F.when(t, F.lit(n)) for n, t in rules.items()])
    return configs.withColumns({"errors": listed(error), "warnings": listed(warn)}).withColumn("passed", F.col("errors") == "")
