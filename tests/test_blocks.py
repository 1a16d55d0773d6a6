"""A hot key is cut in blocks; the rows must come out as if it had not been."""

import pytest
from conftest import canonical

from tapeloom import plans
from tapeloom.runtime import MAX_GROUP_ROWS_KEY

NAMES = [
    "j1_asof_flow_to_book",
    "w21_tape_speed",
    "w38_l23_flag_runs",
    "w48_cancel_ratio",
    "p9_isolated_spikes",
    "l1_j11_triple_barrier",
    "l2_j14_label_grid",
    "l19_monte_carlo",
    "e20_trade_paths",
    "t1_j12_purged_walk_forward",
    "e5_auc",
    "r5_page_hinkley",
    "w34_fractional_difference",
]


@pytest.mark.parametrize("name", NAMES)
def test_blocks_give_the_same_rows(spark, sf, name):
    whole = canonical(plans.QUERIES[name](spark, sf))
    spark.conf.set(MAX_GROUP_ROWS_KEY, "16")
    try:
        cut = canonical(plans.QUERIES[name](spark, sf))
    finally:
        spark.conf.unset(MAX_GROUP_ROWS_KEY)
    assert whole == cut and whole


def test_order_statistics_of_the_past(spark, small_blocks):
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from tapeloom.operators.orderstat import prefix_quantile

    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"symbol": ["a"] * 40 + ["b"] * 3, "ts_event": range(43), "sequence": range(43), "x": rng.integers(0, 9, 43).astype(float)})
    pdf.loc[::7, "x"] = None
    rows = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    out = prefix_quantile(rows, "x", "q", F.lit(0.3), least=2).toPandas().sort_values("sequence")
    for s, g in pdf.groupby("symbol"):
        want = g["x"].expanding(min_periods=2).quantile(0.3).to_numpy()
        got = out[out["symbol"] == s]["q"].astype(float).to_numpy()
        np.testing.assert_allclose(got, want, equal_nan=True)


def test_uneven_keys(spark, small_blocks):
    """One key with most rows among many small ones."""
    from pyspark.sql import functions as F

    from tapeloom.operators.ordered import exact_quantiles, numbered, running

    rows = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("symbol"), F.col("id").alias("ts_event"), F.col("id").alias("sequence"), (F.col("id") % 17).cast("double").alias("v"))
    got = running(numbered(rows), {"total": ("sum", "v"), "seen": ("last", F.when(F.col("v") > 12, F.col("v")))}).toPandas().sort_values("sequence")
    want = rows.toPandas().sort_values("sequence")
    assert got["rn"].tolist() == want.groupby("symbol").cumcount().tolist()
    assert got["total"].tolist() == want.groupby("symbol")["v"].cumsum().tolist()
    kept = want["v"].where(want["v"] > 12).groupby(want["symbol"]).ffill()
    assert got["seen"].fillna(-1).tolist() == kept.fillna(-1).tolist()
    q = exact_quantiles(rows, {"q": "v"}, [0.1, 0.5, 0.9], keys=["symbol"]).filter("symbol = 0").first()["q"]
    assert q == want[want["symbol"] == 0]["v"].quantile([0.1, 0.5, 0.9]).tolist()


def null_keyed(spark):
    """200 rows, half of them without a symbol."""
    from pyspark.sql import functions as F

    at = F.timestamp_seconds(F.col("id") + 1_700_000_000)
    return spark.range(200).select(
        F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("symbol"),
        at.alias("ts_event"),
        F.col("id").alias("sequence"),
        ((F.col("id") * 37) % 23).cast("double").alias("price"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("order_id"),
        F.when(F.col("id") % 4 > 0, F.lit("A")).alias("side"),
        F.element_at(F.array(F.lit("A"), F.lit("C"), F.lit("T")), (F.col("id") % 3 + 1).cast("int")).alias("action"),
        (F.col("id") % 11 + 1).alias("size"),
    )


def _steps():
    from pyspark.sql import functions as F

    from tapeloom.functions.machines import Ewma
    from tapeloom.operators import clean, labels, stateful, tickwin
    from tapeloom.operators.asof import asof
    from tapeloom.operators.ordered import exact_quantiles, numbered, running, windowed

    mean = lambda df, w: df.withColumn("m", F.avg("price").over(w.rowsBetween(-3, 2)))
    seen = F.when(F.col("price") > 9, F.col("price"))
    return {
        "numbered": numbered,
        "windowed": lambda d: windowed(d, mean, before=3, after=2),
        "running": lambda d: running(d, {"total": ("sum", "price"), "seen": ("last", seen), "most": ("max", "price")}),
        "two keys": lambda d: running(d, {"total": ("sum", "price")}, keys=("order_id", "side"), exclusive=True),
        "quantiles": lambda d: exact_quantiles(d, {"q": "price", "s": "size"}, [0.2, 0.5], keys=["symbol"]),
        "quantiles of nulls": lambda d: exact_quantiles(d.withColumn("x", F.when(F.col("symbol") == 1, F.col("price"))), {"q": "x"}, [0.5], keys=["symbol"]),
        "fold": lambda d: stateful.fold(d.select("symbol", "ts_event", "sequence", "price"), Ewma("price", 0.25)),
        "expanding median": lambda d: labels.expanding_median(d.withColumn("v", seen), "v", "med", 3),
        "sample": lambda d: clean.stratified_sample(d, 7),
        "stride": lambda d: clean.stride_sample(d, 7),
        "outliers": lambda d: clean.drop_price_outliers(d, 2.0),
        "cancel ratio": lambda d: tickwin.cancel_ratio(d, n=9, sizes=4, least_sizes=1, least=1),
        "tape speed": lambda d: tickwin.tape_speed(d, 5.0),
        "as-of": lambda d: asof(d.select("symbol", "ts_event", "sequence"), d.where("sequence % 3 = 0").select("symbol", "ts_event", "sequence", F.col("price").alias("last_price")), columns=["last_price"]),
    }


STEPS = ["numbered", "windowed", "running", "two keys", "quantiles", "quantiles of nulls", "fold", "expanding median", "sample", "stride", "outliers", "cancel ratio", "tape speed", "as-of"]


@pytest.mark.parametrize("name", STEPS)
def test_null_keys_in_both_ways(spark, name):
    rows, step = null_keyed(spark), _steps()[name]
    whole = canonical(step(rows))
    spark.conf.set(MAX_GROUP_ROWS_KEY, "16")
    try:
        cut = canonical(step(rows))
    finally:
        spark.conf.unset(MAX_GROUP_ROWS_KEY)
    assert whole == cut and whole


def test_expanding_median_is_that_of_the_past(spark):
    import numpy as np
    import pandas as pd

    from tapeloom.operators.labels import expanding_median

    got = expanding_median(null_keyed(spark), "price", "med", 2).toPandas().sort_values("sequence")
    for _, g in got.groupby(got["symbol"].fillna(-1)):
        want = g["price"].expanding(min_periods=2).median()
        np.testing.assert_allclose(pd.to_numeric(g["med"]), want, equal_nan=True)


def test_null_long_keys_keep_their_state(spark):
    from pyspark.sql import functions as F

    from tapeloom.functions.machines import Ewma
    from tapeloom.operators.stateful import fold

    rows = null_keyed(spark).select("symbol", "ts_event", "sequence", F.col("price"))
    got = fold(rows, Ewma("price", 0.0))
    assert got.where("symbol is null").select("ewma").distinct().count() == 1


@pytest.mark.parametrize("blocks", [4, 16])
def test_a_rule_that_never_forgets_needs_a_fixed_number_of_rounds(spark, blocks, monkeypatch):
    from pyspark.sql import functions as F

    from tapeloom.functions import machines
    from tapeloom.operators import stateful

    rounds = []
    frozen = stateful.frozen
    monkeypatch.setattr(stateful, "frozen", lambda df: rounds.append(1) or frozen(df))
    rows = spark.range(64 * blocks).select(F.when(F.col("id") % 4 > 0, F.lit(1)).alias("symbol"), F.col("id").alias("ts_event"), F.col("id").alias("sequence"), (F.col("id") % 7).cast("double").alias("close"))
    rule = machines.KalmanLevel(noise=1e-3, drift=0.0)
    whole = canonical(stateful.fold(rows, rule))
    spark.conf.set(MAX_GROUP_ROWS_KEY, "48")
    try:
        cut = canonical(stateful.fold(rows, rule))
    finally:
        spark.conf.unset(MAX_GROUP_ROWS_KEY)
    assert whole == cut and len(rounds) <= stateful.ROUNDS + 2
