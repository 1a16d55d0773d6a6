"""Summaries of parts merge to the summary of the whole, however they are grouped."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import canonical
from pyspark.sql import functions as F

from tapeloom.operators import audit as A

SCHEMA = "symbol string, ts_event timestamp, price double, size long, ingest long"


def feed(spark, n=400):
    r = random.Random(3)
    start, rows, us = datetime(2024, 1, 1), [], 0
    for i in range(n):
        us += r.choice([0, 400_000, 900_000, 1_000_001, 30_000_000, -5_000_000])
        ts = None if r.random() < 0.1 else start + timedelta(microseconds=us)
        symbol = r.choice(["hot", "hot", "hot", "cold", None, "untimed"])
        rows.append((symbol, None if symbol == "untimed" else ts, r.choice([None, 0.0, -1.0, 100.0, 100.5, 102.0]), r.choice([None, -1, 0, 5]), i))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("cuts", [[], [0], [3, 3, 4, 200], list(range(0, 400, 7))])
def test_any_cut_and_grouping(spark, cuts):
    df = feed(spark)
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("ingest") >= c).cast("long")
    rows = df.withColumn("day", part)
    parts = A.integrity_parts(rows, "day")
    once = A.merged_parts(parts, F.lit(0))
    twice = A.merged_parts(A.merged_parts(A.merged_parts(parts, F.expr("part div 2")), F.expr("part div 3")), F.lit(0))
    times = A.merged_times(A.time_counts(rows.filter("ingest < 100")).unionByName(A.time_counts(rows.filter("ingest >= 100"))))
    want = A.integrity(df)
    for total in (once, twice):
        got = A.integrity_report(total, times).select(want.columns)
        assert canonical(got) == canonical(want)


def test_adding_a_part_to_a_total_reads_summaries_only(spark):
    df = feed(spark).filter("symbol is not null").withColumn("day", F.expr("ingest div 150"))
    parts = [A.integrity_parts(df.filter(F.col("day") == d), "day") for d in (0, 1, 2, 9)]  # the last one is empty
    total = A.merged_parts(parts[0], F.lit(0))
    for i, more in enumerate(parts[1:], 1):
        total = A.merged_parts(total.withColumn("part", F.lit(i - 1)).unionByName(more), F.lit(0))
    got = A.integrity_report(total, A.time_counts(df))
    want = A.integrity(df.drop("day"))
    assert canonical(got.select(want.columns)) == canonical(want)
