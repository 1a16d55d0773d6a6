"""Small inputs with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import trading as X
from tapeloom.operators import bars, clean, labels, snapshots, splits

T0 = dt.datetime(2024, 1, 1)


def book(spark):
    rows = [(0, 1.2500, 1.2501, 10.0, 11.0), (1, 1.2500, 1.2501, 12.0, 9.0), (2, 1.2501, 1.2502, 8.0, 9.0), (3, 1.2501, 1.2502, 10.0, 7.0)]
    data = [("x", T0 + dt.timedelta(seconds=i), i, [b], [a], [bs], [az]) for i, b, a, bs, az in rows]
    return spark.createDataFrame(data, "symbol string, ts_event timestamp_ntz, sequence long, bid_px array<double>, ask_px array<double>, bid_sz array<double>, ask_sz array<double>")


def test_snapshot_features(spark):
    out = snapshots.with_mlofi(snapshots.top_of_book(book(spark)), levels=1).orderBy("sequence").collect()
    assert out[0]["spread"] == pytest.approx(0.0001)
    assert out[1]["order_book_imbalance"] > 0
    assert [r["mlofi"][0] for r in out][:2] == [0.0, 4.0]
    assert out[2]["mlofi"][0] != out[3]["mlofi"][0]


def barrier_frame(spark, prices):
    data = [("x", T0 + dt.timedelta(seconds=i), i, p, 0.0001, 0.0001) for i, p in enumerate(prices)]
    return spark.createDataFrame(data, "symbol string, ts_event timestamp_ntz, sequence long, mid_price double, spread double, realized_vol double")


def test_first_barrier(spark):
    rule = labels.BarrierRule(horizon=3, tp=1.0, sl=1.0, neutral=1.0, cost_ticks=0.0)
    out = labels.triple_barrier(barrier_frame(spark, [1.2500, 1.2501, 1.2503, 1.2504, 1.2502, 1.2501]), rule).orderBy("sequence").collect()
    assert out[0]["bias_label"] == 0 and out[-1]["bias_label"] == 2
    assert all(r["label_end_ts"] >= r["ts_event"] for r in out)
    assert out[-1]["barrier_hit_type"] == "no_future"


def test_directional_timeout_is_not_tradeable(spark):
    rule = labels.BarrierRule(horizon=2, tp=100.0, sl=100.0, neutral=0.1, cost_ticks=0.0)
    first = labels.triple_barrier(barrier_frame(spark, [1.0, 1.0002, 1.0005, 1.0009]), rule).orderBy("sequence").first()
    assert (first["bias_label"], first["tradeability_label"], first["barrier_hit_type"]) == (0, 0, "timeout_directional_up")


def test_missing_price_fails(spark):
    with pytest.raises(Exception, match="no price"):
        labels.triple_barrier(barrier_frame(spark, [1.0, None, 1.1]), labels.BarrierRule(horizon=2)).collect()


def test_splits_cannot_leak(spark):
    data = [("x", T0 + dt.timedelta(seconds=i), i, T0 + dt.timedelta(seconds=i + 5)) for i in range(200)]
    rows = spark.createDataFrame(data, "symbol string, ts_event timestamp_ntz, sequence long, label_end_ts timestamp_ntz")
    split = splits.purged_walk_forward(rows, n_folds=2, initial_train=0.5, test=0.2, min_train=10)
    report = splits.fold_report(split).collect()
    assert len(report) == 2
    assert all(r["labels_before_test"] and r["chronological"] for r in report)


def test_forbidden_features():
    assert splits.forbidden_columns(["raw__price", "raw__forward_return"]) == ["raw__forward_return"]


def test_fill_probability(spark):
    p = lambda latency: X.fill_probability(F.lit(5.0), F.lit(10.0), F.lit(10.0), F.lit(latency), F.lit(0.0))
    slow, fast = spark.range(1).select(p(10), p(0)).first()
    assert 0 <= slow <= fast <= 1


def test_depth_source(spark):
    rows = [(0.9, -0.2, 1.0, -0.2, 1), (0.8, 0.4, 1.0, 0.4, 1), (-0.8, 0.1, 0.0, -0.8, 0)]
    df = spark.createDataFrame(rows, "order_flow_imbalance double, mbp_imbalance_signed_peak double, mbp_bar_coverage double, want double, source int")
    for r in bars.depth_source(df).collect():
        assert (r["lob_imbalance"], r["lob_imbalance_is_depth"]) == (r["want"], r["source"])


def test_strict_normalisation_fails(spark):
    df = spark.createDataFrame([("s", "A", "B", -1.0, 1, 1)], "symbol string, action string, side string, price double, size long, order_id long")
    assert clean.normalise(df).isEmpty()
    with pytest.raises(Exception, match="invalid row"):
        clean.normalise(df, strict=True).collect()


def test_continuous_contract_rejects_another_root(spark):
    df = spark.createDataFrame([("ESH4",), ("NQM4",)], "contract_symbol string")
    with pytest.raises(Exception, match="not a contract of ES"):
        clean.continuous(df, "ES").collect()


def test_wide_book_and_feed_type(spark):
    from tapeloom.sources import tables

    df = spark.createDataFrame([(T0, 1.0, 1.1, 5.0, 6.0)], "ts_event timestamp_ntz, bid_px_00 double, ask_px_00 double, bid_sz_00 double, ask_sz_00 double")
    assert tables.feed_type(df) == "MBP" and tables.missing_columns(df) == []
    row = tables.wide_to_arrays(df, 2).first()
    assert row["bid_sz"] == [5.0, 0.0] and row["ask_px"] == [1.1, None]
