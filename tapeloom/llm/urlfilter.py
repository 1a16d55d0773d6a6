"""URL verdicts: a rule list first, else logistic regression on hashed character n-grams of host and path.

``parts`` cuts a URL in host and path; null URLs and those without ``://`` have both empty. A rule
``host/path`` fits its host and all subdomains if the URL's path starts with the rule's; the longest
rule wins, among equally long ones the one with the longer host, then the larger text. The rule list
is a parameter and part of the plan, so it should hold thousands of rules at most.

The model is fitted on a small labelled table of different URLs, each weighted by its rows (`fit(..., rows=)`
bounds it by the hash of the URL, so a URL that repeats is one row of it). Without labelled URLs, or with one class only, the score is the smoothed share of ``block``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import bounded, slices

FIT_ROWS = 4_000
BUCKETS = 1 << 18
SIZES = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that fits, and its verdict; both null if none does. rules: (verdict, ``host/path``)."""
    none = F.lit(None).cast("string")
    if not rules:
        return none, none
    known = F.array(
        *[
            F.struct(F.lit(len(rule)).alias("size"), F.lit(len(of)).alias("host_size"), F.lit(rule).alias("rule"), F.lit(of).alias("host"), F.lit("/" + rest).alias("path"), F.lit(verdict).alias("verdict"))
            for verdict, rule in rules
            for of, _, rest in [rule.partition("/")]
        ]
    )
    fits = F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    best = F.array_max(fits)
    return best["rule"], best["verdict"]


def ngrams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all URLs: row, bucket, and of each row 1 / sqrt(its n-grams). Ends count as characters."""
    rows, cells = [], []
    for part, values in enumerate((hosts, paths)):
        raw = [b"\x02" + v.encode() + b"\x03" if v else b"" for v in values]
        code = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        for size in SIZES:
            if len(code) < size:
                continue
            n = len(code) - size + 1
            mixed = np.full(n, np.uint64(0x100001B3 * (2 * size + part) + 1), np.uint64)
            for k in range(size):
                mixed = (mixed ^ code[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            same = owner[:n] == owner[size - 1 :]
            rows.append(owner[:n][same])
            cells.append((mixed[same] >> np.uint64(7)).astype(np.int64) & (BUCKETS - 1))
    row, cell = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cells))
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(hosts))))
    return row, cell, scale


@dataclass
class Regression:
    weights: np.ndarray
    bias: float

    def score(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability of ``block``."""
        row, cell, scale = ngrams(hosts, paths)
        total = np.bincount(row, self.weights[cell], len(hosts)) * scale + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def regress(hosts: list[str], paths: list[str], y: np.ndarray, steps: int = 150, rate: float = 0.5, l2: float = 1e-4, weight: np.ndarray | None = None) -> Regression:
    """Logistic regression by AdaGrad on all rows at once. Rows are few: the caller has bounded them."""
    weight = np.ones(len(y)) if weight is None else weight
    share = ((weight * y).sum() + 0.5) / (weight.sum() + 1)
    model = Regression(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    row, cell, scale = ngrams(hosts, paths)
    used, at = np.unique(cell, return_inverse=True)
    value, w, seen, bias_seen = scale[row], np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    for _ in range(steps):
        total = np.bincount(row, w[at] * value, len(y)) + model.bias
        wrong = (1 / (1 + np.exp(-total)) - y) * weight / weight.sum()
        slope = np.bincount(at, wrong[row] * value, len(used)) + l2 * w
        seen += slope**2
        w -= rate * slope / np.sqrt(seen)
        bias_seen += wrong.sum() ** 2
        model.bias -= rate * wrong.sum() / np.sqrt(bias_seen)
    model.weights[used] = w
    return model


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Regression:
    """From columns host, path and verdict (``block`` or ``allow``); null verdicts are not learned from."""
    known = labelled.where(F.col("verdict").isNotNull()).groupBy("host", "path", "verdict").agg(F.count("*").alias("n"))
    some = bounded(known, F.concat("host", "path"), rows).toPandas().sort_values(["host", "path", "verdict"], kind="stable")
    return regress(some["host"].tolist(), some["path"].tolist(), (some["verdict"] == "block").to_numpy(float), weight=some["n"].to_numpy(float))


def judged(df: DataFrame, model: Regression) -> DataFrame:
    """Fill null ``verdict`` by the model; adds ``score``, the model's probability of block, for all rows."""
    fields = [f for f in df.schema.fields if f.name not in ("verdict", "score")]
    schema = T.StructType([*fields, T.StructField("verdict", T.StringType()), T.StructField("score", T.DoubleType())])
    spread = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "path", 1 << 20):
                score = spread.value.score(part.column("host").to_pylist(), part.column("path").to_pylist())
                verdict = [v or ("block" if s >= 0.5 else "allow") for v, s in zip(part.column("verdict").to_pylist(), score)]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in fields] + [pa.array(verdict, pa.string()), pa.array(score)], schema.names)

    return df.mapInArrow(run, schema)
