"""Statistics beside pandas, with nulls."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeloom.operators import evaluate as E
from tapeloom.operators.events import causal_threshold


def frame(spark):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": r.integers(0, 6, 120).astype(float), "b": r.normal(size=120), "c": r.normal(size=120), "y": r.normal(size=120)})
    pdf["b"] += 0.2 * pdf["a"]
    pdf["twin"] = pdf["b"] * 3 + 1
    pdf.loc[::5, "c"] = np.nan
    pdf.loc[::7, "y"] = np.nan
    rows = spark.createDataFrame(pdf)
    return pdf, rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns])


def test_rank_correlation_of_common_rows(spark):
    pdf, rows = frame(spark)
    want = pdf.corr(method="spearman").abs()
    got = E.spearman_matrix(rows, list(pdf.columns)).toPandas().pivot(index="a", columns="b", values="rho")
    np.testing.assert_allclose(got.loc[want.index, want.columns].to_numpy(float), want.to_numpy(), atol=1e-9)


def test_feature_picks(spark):
    pdf, rows = frame(spark)
    rho = pdf.corr(method="spearman").abs()
    features = ["a", "b", "twin", "c"]
    kept = E.redundancy_filter(rows, features, "y", threshold=0.85)
    assert "b" in kept and "twin" not in kept and {"a", "c"} <= set(kept)
    assert E.redundancy_filter(rows, features, "y", threshold=0.85, protected=["twin"])[0] == "twin"
    picked = E.mrmr(rows, features, "y", 3, protected=["c"])
    rest, want = ["a", "b", "twin"], ["c"]
    while len(want) < 3:
        best = max(rest, key=lambda f: rho.loc[f, "y"] - np.mean([rho.loc[f, p] for p in want]))
        rest.remove(best)
        want.append(best)
    assert picked == want


def test_null_scores_count_as_zero(spark):
    rows = spark.range(40).select(F.lit(1).alias("symbol"), F.col("id").alias("ts_event"), F.col("id").alias("sequence"), F.when(F.col("id") % 3 > 0, F.col("id") / 40.0).alias("s"))
    got = causal_threshold(rows, "s", 0.3, n=10, least=5).toPandas().sort_values("sequence")
    s = got["s"].fillna(0)
    want = s.rolling(10, min_periods=5).quantile(0.7).shift(1).fillna(0).clip(0, 1)
    np.testing.assert_allclose(got["event_threshold"], want)
