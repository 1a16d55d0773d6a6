"""Steps that must not grow faster than their input."""

from conftest import canonical

from tapeloom import plans
from tapeloom.runtime import MAX_GROUP_ROWS_KEY


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_session_labels_send_no_table_to_all_tasks(spark, sf):
    """There are nearly as many sessions as rows."""
    whole = plans.QUERIES["l17_session_labels"](spark, sf)
    assert "Broadcast" not in plan_of(whole) and plan_of(whole).count("Exchange hashpartitioning") == 1
    spark.conf.set(MAX_GROUP_ROWS_KEY, "1")
    try:
        cut = plans.QUERIES["l17_session_labels"](spark, sf)
        assert canonical(cut) == canonical(whole)
    finally:
        spark.conf.unset(MAX_GROUP_ROWS_KEY)


def test_state_calls_do_not_grow_with_the_keys():
    import json

    import pandas as pd

    from tapeloom.functions.machines import PageHinkley
    from tapeloom.streaming.flows import _Ordered

    class State:
        def __init__(self):
            self.values, self.calls = [], 0

        def get(self):
            return iter(self.values)

        def put(self, values):
            self.values, self.calls = list(values), self.calls + 1

        def appendList(self, values):
            self.values, self.calls = self.values + list(values), self.calls + 1

        def clear(self):
            self.values = []

    class Handle:
        def __init__(self):
            self.kept, self.timers = {}, []

        def getListState(self, name, schema):
            return self.kept.setdefault(name, State())

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, t):
            self.timers.append(t)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 1_000

    handle, work = Handle(), _Ordered(PageHinkley(limit=0.8), ["ts_event"], ["symbol", "ts_event"])
    work.init(handle)
    line = lambda k, us: json.dumps({"order": {"ts_event": us}, "columns": {"symbol": k, "ts_event": us}, "inputs": {"error": 0.5}})
    keys = [2**60 + k for k in range(300)]
    rows = [(us, k) for us in (900_000, 100, 2_000_000) for k in keys]
    chunk = pd.DataFrame({"event_us": [us for us, _ in rows], "owner": [str(k) for _, k in rows], "row": [line(k, us) for us, k in rows]})
    list(work.handleInputRows((0,), iter([chunk]), Now()))
    out = pd.concat(list(work.handleExpiredTimer((0,), Now(), None)))
    assert [out[out["symbol"] == k]["ts_event"].tolist() for k in keys] == [[100, 900_000]] * 300
    assert {n: (s.calls, len(s.values)) for n, s in handle.kept.items()} == {"states": (1, 1), "waiting": (2, 1)}
    assert handle.timers == [1, 2_001]


def test_ordered_streams_keep_null_keys(spark, tmp_path):
    from pyspark.sql import functions as F

    from tapeloom.functions.machines import PageHinkley
    from tapeloom.operators.stateful import fold
    from tapeloom.streaming import flows as S

    rows = spark.range(60).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("symbol"), F.timestamp_seconds(F.col("id") * 37 % 60).alias("ts_event"),
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("sequence"), F.when(F.col("id") % 5 > 0, F.col("id") / 7).otherwise(float("nan")).alias("error"),
    )
    rows = rows.filter("error = error and not isnan(error)")
    rows.write.parquet(str(tmp_path / "in"))
    closing = S.Closing(spark)
    stream = S.run_ordered(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), PageHinkley(limit=0.8), ["symbol", "ts_event", "sequence"], closing=closing, buckets=2)
    found = S.drain(stream, "ordered", arrivals=[lambda: None, closing.write])
    told = lambda df: sorted(map(str, df.select("symbol", "ts_event", "sequence", "statistic", "drift").collect()))
    assert told(found) == told(fold(rows, PageHinkley(limit=0.8)))


def test_quantiles_of_a_table_rank_only_values_near_them(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from tapeloom.operators import ordered

    rows = spark.range(3_000).select(
        F.when(F.col("id") % 9 > 0, F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7.0).alias("x"), F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(0).cast("double").alias("ties"),
        F.lit(None).cast("double").alias("none"), F.when(F.col("id") == 5, 2.5).alias("one"),
    )
    probs, columns = [0.0, 0.1, 0.25, 0.5, 0.8215, 0.99, 1.0], {f"_{c}": c for c in rows.columns}
    want = {n: [np.nanquantile(rows.select(c).toPandas()[c].astype(float), p) for p in probs] for n, c in columns.items() if c != "none"}
    whole = ordered.exact_quantiles(rows, columns, probs).first()
    spread = ordered._spread_quantiles
    monkeypatch.setattr(ordered, "COUNTED_ROWS", 10)
    monkeypatch.setattr(ordered, "_spread_quantiles", None)  # all values of a column
    ranked = ordered.exact_quantiles(rows, columns, probs).first()
    for n in want:
        np.testing.assert_allclose(ranked[n], want[n], rtol=1e-12)
        np.testing.assert_allclose(whole[n], want[n], rtol=1e-12)
    assert ranked["_none"] is None and whole["_none"] is None
    monkeypatch.setattr(ordered, "_spread_quantiles", spread)
    monkeypatch.setattr(ordered, "ACCURACY", -1_000_000)  # bounds that miss
    monkeypatch.setattr(F, "percentile_approx", lambda c, marks, _: F.transform(marks, lambda m: F.lit(1e9)))
    missed = ordered.exact_quantiles(rows, columns, probs).first()
    np.testing.assert_allclose(missed["_x"], want["_x"], rtol=1e-12)


def test_small_keys_share_calls(spark, monkeypatch):
    """Rows of many keys are answered at once, and none sees another key's rows."""
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tapeloom.operators import ahead
    from tapeloom.operators.sliding import sliding

    rows = spark.range(900).select((F.col("id") % 300).alias("symbol"), F.col("id").alias("ts_event"), F.col("id").alias("sequence"), F.when(F.col("id") % 5 > 0, (F.col("id") * 37 % 101).cast("double")).alias("x"))
    calls = ahead.streamed(rows.repartition(1), 0, [ahead.T.StructField("n", ahead.T.LongType())], lambda part, a, b, first, last: [pa.array([b - a] * (b - a))], many=True)
    assert calls.select(F.max("n")).first()[0] > 3
    got = sliding(rows, {"m": ("median", "x", 2), "n": ("rows", "x", 2)}).toPandas().sort_values("sequence")
    for _, g in got.groupby("symbol"):
        assert g["n"].tolist() == [1, 2, 2]
        pd.testing.assert_series_equal(g["m"], g["x"].rolling(2, min_periods=1).median(), check_names=False)
    hits = ahead.first_ahead(rows.withColumns({"up": F.col("x") + 1, "down": F.col("x") - 1}), 5, {"hit": ("up", "down")}, "x").toPandas()
    assert hits.groupby("symbol")["_end"].apply(lambda s: s.isna().sum()).tolist() == [1] * 300


def test_weights_read_their_rows_once(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tapeloom.operators.weights import structural_weights

    one = lambda v: F.lit(v).cast("double")
    rows = spark.range(40).withColumn("label_dynamic_threshold", F.avg("id").over(Window.partitionBy(F.col("id") % 3).orderBy("id"))).withColumns(
        {"bias_label": F.lit(0), "effective_horizon": F.lit(10), "bid_wall_strength": one(1), "ask_wall_strength": one(2), "signal_quality": F.lit(1)}
    )
    assert "Window" not in plan_of(structural_weights(rows))


def test_models_share_one_split(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tapeloom.operators import learn

    seen, real = [], learn.frozen
    monkeypatch.setattr(learn, "frozen", lambda df: seen.append(df.columns) or real(df))
    rows = spark.range(120).select(F.lit(1).alias("symbol"), F.col("id").alias("sequence"), F.lit(1).alias("fold"), F.when(F.col("id") < 80, "train").otherwise("test").alias("role"), (F.col("id") % 2).alias("bias_label"), (F.col("id") * 7 % 11).cast("double").alias("x"))
    assert learn.sanity(rows, {"x": ["x"]}).first()["rows"] == 40
    assert seen[0] == ["symbol", "sequence", "fold", "role", "bias_label", "x"] and ["bias_label", "prob_long"] in seen
