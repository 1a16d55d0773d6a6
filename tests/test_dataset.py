"""The written artifact: its reports, and when nothing is written."""

import os

import pytest
from pyspark.sql import functions as F

from tapeloom.operators.labels import BarrierRule
from tapeloom.plans import dataset
from tapeloom.plans import views as V
from tapeloom.sources import tables

RULE = BarrierRule(horizon=12, tick=0.01)


def feeds(spark, sf):
    return V.ticks(spark, sf).limit(400), V.book(spark, sf).limit(300)


def test_artifact_and_reports(spark, sf, tmp_path):
    ticks, book = V.ticks(spark, sf), V.book(spark, sf)
    report = dataset.prepare(ticks, book, RULE, str(tmp_path / "a"), frames=(20, 50)).first()
    assert report["passed"] and report["critical"] == ""
    assert {*dataset.REPORTS, "features", "labels", "metadata", "manifest"} <= set(os.listdir(tmp_path / "a"))
    rows = tables.load_artifact(spark, str(tmp_path / "a"))
    assert rows.count() == report["feature_rows"]
    assert {"label_end_ts", "bias_label", "train_event_flag", "open", "high", "low", "raw__cvd", "soft_sample_weight", "mc_sample_weight"} <= set(rows.columns)
    assert rows.where("label_end_ts < ts_event or mbo_state_ts > ts_event or least(open, high, low) <= 0").isEmpty()
    leakage = spark.read.json(str(tmp_path / "a" / "leakage_report")).first()
    assert leakage["passed"] and leakage["rows"] == rows.count()
    features = spark.read.json(str(tmp_path / "a" / "feature_report"))
    assert features.count() == len(dataset.feature_names(rows.drop("mbo_state_ts", "soft_sample_weight", "mc_sample_weight")))
    assert features.where("feature = 'cvd'").first()["varies"]


def test_dry_run_writes_reports_only(spark, sf, tmp_path):
    report = dataset.prepare(*feeds(spark, sf), RULE, str(tmp_path / "d"), dry_run=True).first()
    assert report["passed"]
    assert set(os.listdir(tmp_path / "d")) == {"data_validation", "symbols_before_filters"}


def test_empty_filter_is_reported_with_the_symbols_there_are(spark, sf, tmp_path):
    ticks, book = feeds(spark, sf)
    report = dataset.prepare(ticks, book, RULE, str(tmp_path / "e"), symbol=-5, dry_run=True).first()
    assert not report["passed"] and report["book_rows"] == 0
    assert "empty_book_after_filters" in report["critical"]
    counts = spark.read.json(str(tmp_path / "e" / "symbols_before_filters"))
    assert counts.groupBy("feed").agg(F.sum("rows").alias("n")).where("feed = 'book'").first()["n"] == 300
    assert not os.path.exists(tmp_path / "e" / "features")


def test_too_many_rows_are_refused_not_cut(spark, sf, tmp_path):
    with pytest.raises(RuntimeError, match="max_rows_exceeded"):
        dataset.prepare(*feeds(spark, sf), RULE, str(tmp_path / "m"), max_rows=10)
    assert spark.read.json(str(tmp_path / "m" / "data_validation")).first()["critical"] == "max_rows_exceeded"
    assert not os.path.exists(tmp_path / "m" / "features")


def test_labelled_rows_are_shuffled_twice_and_without_levels(spark, sf):
    """Flow states are grouped and summed up, rows meet them, and the barriers look ahead: no other shuffle, no level in the last."""
    rows = dataset.labelled(V.ticks(spark, sf), V.book(spark, sf), RULE, (20, 50), arrays=False)
    lines = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("Exchange hashpartitioning" in line for line in lines) == 4
    assert sum("MapInArrow" in line for line in lines) == 2 and not {*dataset.ARRAYS} & {*rows.columns}
    whole = dataset.labelled(V.ticks(spark, sf), V.book(spark, sf), RULE, (20, 50))
    assert {*whole.columns} == {*rows.columns, *dataset.ARRAYS} and dataset.feature_names(whole) == dataset.feature_names(rows)


def test_labels_in_the_shared_pass_are_those_of_the_single_steps(spark, sf):
    from conftest import canonical

    from tapeloom.operators import labels

    ticks, book = V.ticks(spark, sf), V.book(spark, sf)
    once = dataset.labelled(ticks, book, RULE, (20, 50), arrays=False)
    steps = labels.triple_barrier(dataset.features(ticks, book, RULE.tick, (20, 50)), RULE)
    assert canonical(once) == canonical(steps.drop(*dataset.ARRAYS))


def test_only_the_artifact_is_left(spark, sf, tmp_path):
    from tapeloom.runtime import shared_dir

    kept = lambda: {f"{d}/{f}" for d, _, files in os.walk(shared_dir(spark).removeprefix("file:")) for f in files}
    before = kept()
    dataset.prepare(V.ticks(spark, sf), V.book(spark, sf), RULE, str(tmp_path / "l"), frames=(20, 50))
    assert kept() == before


def test_features_come_as_often_as_in_the_artifact(spark, tmp_path):
    import datetime

    from conftest import canonical

    day = datetime.datetime(2024, 1, 1)
    rows = [(1, day, 1, 0.5), (1, day, 2, None), (1, day, 2, 1.5), (None, day, 3, 2.5), (2, None, 3, 3.5), (2, day, 3, 4.5)]
    rows = spark.createDataFrame(rows, "symbol long, ts_event timestamp_ntz, sequence long, x double")
    keys = rows.drop("x")
    extra = spark.createDataFrame([(2, day, 3)], keys.schema)
    lone = spark.createDataFrame([(7, day, 7, 9.5)], rows.schema)  # has no labels
    tables.write_artifact(str(tmp_path / "f"), rows.union(lone), keys.withColumn("label", F.lit(1)), keys.union(extra), {})
    loaded, times = tables.load_features(spark, str(tmp_path / "f"))
    assert canonical(loaded) == canonical(tables.load_artifact(spark, str(tmp_path / "f")).drop("label"))
    assert loaded.count() == 1 + 2 * 2 * 2 + 2 and times.count() == 3
