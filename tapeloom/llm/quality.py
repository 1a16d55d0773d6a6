"""Quality scores: histogram gradient-boosted trees over document statistics.

Each text is turned into a fixed list of statistics (`STATISTICS`), all rows alike. Trees are fitted
on a bounded sample of labelled rows (`fit(..., rows=)`, chosen by the hash of the id): statistics are
cut into histogram bins, splits are chosen by gain over the bins' gradient sums. The trees are then
flattened into arrays, one complete binary tree per row, that numpy walks for many rows at once.

Null and empty texts have all statistics 0 and are scored like any other. Without labelled rows every
score is 0.5; with one class only it is that class's smoothed share. Rows with a null label, or with
an id that has no label, are not learned from; an id labelled more than once has its largest label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import bounded, byte_texts, lists, slices

STATISTICS = [
    "log_bytes", "log_words", "upper", "lower", "digits", "spaces", "lines", "stops", "shouts", "odd", "quotes", "beyond_ascii",
    "mean_word", "longest_word", "distinct_words", "mean_line", "distinct_lines", "words_without_letter", "shouted_words", "short_words",
]
#: Labelled rows that the trees are fitted on, at most (about).
FIT_ROWS = 20_000


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 8, np.uint8)  # odd
    for chars, k in ((range(65, 91), 0), (range(97, 123), 1), (range(48, 58), 2), (b" \t", 3), (b"\n\r", 4), (b".,;:", 5), (b"!?", 6), (b"'\"()-", 7), (range(0xC0, 256), 9), (range(0x80, 0xC0), 10)):
        kind[list(chars)] = k
    return kind


CLASSES = _byte_classes()


def statistics(text: bytes) -> np.ndarray:
    """The statistics of one text; shares are of its characters, words or lines."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    n = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=11).astype(float)
    chars = max(1.0, n[:10].sum())
    out[0] = np.log1p(len(text))
    out[2:12] = n[:10] / chars
    words, rows = text.split(), text.split(b"\n")
    out[15] = chars / len(rows)
    out[16] = len(set(rows)) / len(rows)
    if words:
        size = np.fromiter(map(len, words), np.int64, len(words))
        kinds = set(words)
        out[1], out[12], out[13], out[14] = np.log1p(len(words)), size.mean(), np.log1p(size.max()), len(kinds) / len(words)
        bare = sum(not w.isalpha() and w.translate(None, LETTERS) == w for w in kinds)
        out[17], out[18] = bare / len(kinds), sum(map(bytes.isupper, kinds)) / len(kinds)
        out[19] = float((size <= 3).mean())
    return out


#: Bytes that count as parts of letters: ASCII letters and all beyond ASCII.
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])


def statistics_of(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and the array ``statistics`` of every text."""
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + [T.StructField("statistics", T.ArrayType(T.DoubleType(), False), False)])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = lists(map(statistics, byte_texts(part.column(text))), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [made], schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


@dataclass
class Trees:
    """Flattened trees of one depth: node 0 is the root, the children of node i are 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 5, l2: float = 1.0) -> Trees:
    """Boosted trees for logistic loss. Rows are few: the caller has bounded them."""
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) < 2 * least or y.min() == y.max():
        return Trees(base, feature[:0], threshold[:0], leaf[:0], depth)
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # x <= edges[b] is bin <= b
    total = np.full(len(y), base)
    cell = np.arange(width) * bins + binned
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            flat = ((node - first)[:, None] * (width * bins) + cell).ravel()
            g, h, n = (np.bincount(flat, np.repeat(v, width), count * width * bins).reshape(count, width, bins).cumsum(2) for v in (grad, hess, np.ones(len(y))))
            all_g, all_h, all_n = g[:, :, -1:], h[:, :, -1:], n[:, :, -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[(n < least) | (all_n - n < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for i in range(count):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-9 and b < len(edges[j]):
                    feature[t, first + i], threshold[t, first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + l2)
        total += leaf[t][at]
    return Trees(base, feature, threshold, leaf, depth)


def sample_of(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS) -> DataFrame:
    """doc_id and _label of at most about ``rows`` labelled ids, by the hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("_label"))
    return bounded(known, F.col(doc_id), rows)


def fit(stats: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS) -> Trees:
    """Trees from the rows of ``stats`` that have a label and pass ``learn``; at most about ``rows`` of them."""
    known = F.broadcast(sample_of(labels, doc_id, label, rows))  # bounded
    pairs = stats.where(learn).join(known, doc_id).select(doc_id, "statistics", "_label").distinct()
    pairs = bounded(pairs, F.struct(doc_id, "statistics"), rows).toPandas()
    if not len(pairs):
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    pairs = pairs.sort_values(doc_id, kind="stable")
    x = np.stack(pairs["statistics"].to_numpy())
    order = np.lexsort((*x.T, pairs["_label"].to_numpy(), pairs[doc_id].to_numpy()))
    return grow(x[order], pairs["_label"].to_numpy(float)[order])


def score(stats: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """Replace ``statistics`` by the probability of label 1."""
    keep = [f for f in stats.schema.fields if f.name not in ("statistics", name)]
    schema = T.StructType(keep + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("statistics").flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(model.score(x), pa.float64())], schema.names)

    return stats.mapInArrow(run, schema)


def scored(df: DataFrame, model: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``df`` and the score of its text, in one pass. A column with the new name is replaced."""
    keep = [f for f in df.schema.fields if f.name != name]
    schema = T.StructType(keep + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                x = np.stack([statistics(t) for t in byte_texts(part.column(text))])
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in keep] + [pa.array(model.score(x), pa.float64())], schema.names)

    return df.mapInArrow(run, schema)
