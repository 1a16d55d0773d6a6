"""Models from Spark ML on purged time splits: out-of-fold probabilities, calibration, mixture regimes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.market import LONG, NEUTRAL, clip
from tapeloom.operators.evaluate import auc, calibration_error, macro_scores, probability_scores
from tapeloom.operators.ordered import beside, numbered
from tapeloom.runtime import frozen


def _vectors(features: Sequence[str]) -> list:
    return [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]


def align_classes(probs: Column, classes: Sequence[int], n: int) -> Column:
    """Probabilities of the given classes as an array over all n classes, summing to 1 where any is there."""
    cells = [F.get(probs, list(classes).index(c)) if c in classes else F.lit(0.0) for c in range(n)]
    total = reduce(lambda a, b: a + b, cells)
    return F.when(total > 0, F.array(*[c / total for c in cells])).otherwise(F.array(*[F.lit(0.0)] * n))


def out_of_fold(split: DataFrame, features: Sequence[str], keys: Sequence[str] = ("symbol", "sequence"), max_iter: int = 20) -> DataFrame:
    """Train on each fold's training rows, score its test rows, and stack the scores: columns fold, prob_long."""
    rows = split.filter(F.col("bias_label") != NEUTRAL).withColumn("_y", (F.col("bias_label") == LONG).cast("double"))
    rows = frozen(rows.select(*keys, "fold", "role", "bias_label", "_y", *features))  # training reads the rows many times
    folds = [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]  # one row per fold
    model = Pipeline(stages=[*_vectors(features), LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=max_iter)])
    parts = []
    for fold in folds:
        fold_rows = rows.filter(F.col("fold") == fold)
        fitted = model.fit(fold_rows.filter("role = 'train'"))
        scored = fitted.transform(fold_rows.filter("role = 'test'"))
        parts.append(scored.select(*keys, "fold", "bias_label", F.get(vector_to_array("probability"), 1).alias("prob_long")))
    return reduce(DataFrame.unionByName, parts)


def fill_uncovered(rows: DataFrame, scored: DataFrame, prior: float = 0.5, keys: Sequence[str] = ("symbol", "sequence")) -> DataFrame:
    """Every row with its out-of-fold probability, or the prior where no fold tested it; ``covered`` tells which."""
    out = rows.join(scored.select(*keys, "prob_long"), list(keys), "left")
    return out.withColumns({"covered": F.col("prob_long").isNotNull(), "prob_long": F.coalesce("prob_long", F.lit(prior))})


def isotonic(df: DataFrame, least: int = 64) -> tuple[DataFrame, DataFrame]:
    """Calibrate prob_long on the older half; keep it only if Brier score and log loss fall on the newer half.

    Returns the rows with prob_calibrated, and a one-row report.
    """
    rows = df.filter(F.col("bias_label") != NEUTRAL).withColumn("_y", (F.col("bias_label") == LONG).cast("double"))
    rows = frozen(rows)  # read by every step below
    n = rows.count()
    if n < least:
        report = df.sparkSession.createDataFrame([(n, False, "insufficient_rows")], "rows long, enabled boolean, reason string")
        return df.withColumn("prob_calibrated", F.col("prob_long")), report
    half = min(max(32, n // 2), n - 32)
    placed = numbered(rows, "_i", keys=(), order=("ts_event", "sequence"))
    rule = IsotonicRegression(featuresCol="prob_long", labelCol="_y", predictionCol="prob_calibrated")
    guard = rule.fit(placed.filter(F.col("_i") < half))
    scores = probability_scores(guard.transform(placed.filter(F.col("_i") >= half)), {"raw": "prob_long", "calibrated": "prob_calibrated"})
    better = (F.col("calibrated_brier") <= F.col("raw_brier") - 1e-5) & (F.col("calibrated_nll") <= F.col("raw_nll") - 1e-5)
    report = scores.select(F.lit(n).cast("long").alias("rows"), better.alias("enabled"), F.when(better, "accepted").otherwise("rejected").alias("reason"), *[c for c in scores.columns if c != "rows"])
    if not report.first()["enabled"]:
        return df.withColumn("prob_calibrated", F.col("prob_long")), report
    return rule.fit(rows).transform(df).withColumn("prob_calibrated", clip(F.col("prob_calibrated"), 1e-6, 1 - 1e-6)), report


def temperature(df: DataFrame) -> DataFrame:
    """One row: the temperature from 0.5 to 3 with the least log loss, and the loss before and after.

    Rows become counts per (probability, label) before they meet the 51 temperatures.
    """
    counts = df.filter(F.col("bias_label") != NEUTRAL).groupBy(clip(F.col("prob_long"), 1e-6, 1 - 1e-6).alias("p"), (F.col("bias_label") == LONG).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*[F.lit(round(0.5 + 0.05 * i, 2)) for i in range(51)])
    rows = counts.withColumn("t", F.explode(grid))
    scaled = 1 / (1 + F.exp(-(F.ln(F.col("p")) - F.ln(1 - F.col("p"))) / F.col("t")))
    loss = -F.ln(F.greatest(F.when(F.col("y"), scaled).otherwise(1 - scaled), F.lit(1e-15)))
    losses = rows.groupBy("t").agg((F.sum(loss * F.col("n")) / F.sum("n")).alias("nll"), F.sum("n").alias("rows"))
    return losses.agg(F.min_by("t", F.struct("nll", "t")).alias("temperature"), F.max(F.when(F.col("t") == 1.0, F.col("nll"))).alias("raw_nll"), F.min("nll").alias("calibrated_nll"), F.max("rows").alias("rows"))


def sanity(split: DataFrame, feature_sets: dict[str, Sequence[str]]) -> DataFrame:
    """A plain model per feature set: AUC, calibration error, Brier, log loss and F1 over its out-of-fold scores."""
    out, used = None, dict.fromkeys(f for features in feature_sets.values() for f in features)
    split = frozen(split.filter(F.col("bias_label") != NEUTRAL).select("symbol", "sequence", "fold", "role", "bias_label", *used))  # one split for all models
    for name, features in feature_sets.items():
        scored = frozen(out_of_fold(split, features).select("bias_label", "prob_long")).withColumn("guess", F.when(F.col("prob_long") >= 0.5, 0).otherwise(1))  # read by each measure
        row = auc(scored, "prob_long", F.col("bias_label") == LONG).select("rows", "auc")
        for extra in (calibration_error(scored).select("ece"), probability_scores(scored, {"model": "prob_long"}).drop("rows"), macro_scores(scored, "bias_label", "guess")):
            row = row.transform(beside, extra)  # one row each
        row = row.select(F.lit(name).alias("feature_set"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def map_clusters(means: Sequence[Sequence[float]]) -> dict[int, int]:
    """Regime of each cluster from its centre (volatility, volume ratio, CVD, imbalance, activity, trend).

    The most volatile cluster is taken first, then the quietest, then the most directed.
    """
    wants = [
        (2, lambda m: m[0] + m[1] + 0.25 * m[4]),
        (3, lambda m: -m[4] - m[1]),
        (0, lambda m: abs(m[5]) + abs(m[2]) + 0.20 * m[4]),
        (1, lambda m: 0.0),
    ]
    free, out = list(range(len(means))), {}
    for regime, score in wants:
        if free:
            best = max(free, key=lambda c: score(means[c]))
            out[best] = regime
            free.remove(best)
    return {**{c: 1 for c in free}, **out}


def mixture_regimes(df: DataFrame, features: Sequence[str], k: int = 4, seed: int = 42, max_iter: int = 30) -> DataFrame:
    """Gaussian mixture over scaled features, its clusters named as regimes. Features in the order ``map_clusters`` reads."""
    df = frozen(df)  # the fit reads the rows many times
    ready = Pipeline(stages=_vectors(features)).fit(df).transform(df)
    model = GaussianMixture(featuresCol="_x", k=k, seed=seed, maxIter=max_iter).fit(ready)
    centres = [[float(v) for v in g.mean.toArray()] for g in model.gaussians]
    names = map_clusters(centres)
    regime = F.lit(1)
    for cluster, code in names.items():
        regime = F.when(F.col("prediction") == cluster, code).otherwise(regime)
    return model.transform(ready).withColumn("regime", regime).withColumnRenamed("prediction", "cluster").drop("_raw", "_x", "probability")
