"""Moments and extremes over the last n rows, for many frames in one pass over streamed rows.

Moments (count, mean, squared deviations) of stretches of 1, 2, 4 .. rows are merged from those of half
the length; a frame of n rows is put together from at most log2(n) of them. Nothing is subtracted from
running totals, so prices near a million lose no digits and a constant stretch has no deviation at all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeloom.operators.ahead import Extremes, doubles, floats, streamed
from tapeloom.operators.ordered import KEYS, ORDER

Parts = tuple[np.ndarray, np.ndarray, np.ndarray]


def merged(a: Parts, b: Parts) -> Parts:
    """Count, mean and squared deviations of two neighbouring stretches together."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    step = b[1] - a[1]
    return n, a[1] + step * share, a[2] + b[2] + step * step * share * a[0]


class Moments:
    """Counts, means and squared deviations of stretches of 1, 2, 4 .. values; NaN is passed over."""

    def __init__(self, x: np.ndarray, longest: int):
        known = ~np.isnan(x)
        self.levels: list[Parts] = [(known.astype(np.float64), np.where(known, x, 0.0), np.zeros(len(x)))]
        step = 1
        while 2 * step <= min(longest, len(x)):
            last = self.levels[-1]
            self.levels.append(merged(tuple(v[:-step] for v in last), tuple(v[step:] for v in last)))
            step *= 2

    def over(self, begin: np.ndarray, length: np.ndarray) -> Parts:
        """Of the ``length`` values from ``begin`` on."""
        out: Parts = (np.zeros(len(begin)), np.zeros(len(begin)), np.zeros(len(begin)))
        at = begin.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            some = np.flatnonzero(length >> level & 1)
            found = merged(tuple(v[some] for v in out), tuple(v[at[some]] for v in self.levels[level]))
            for have, new in zip(out, found):
                have[some] = new
            at[some] += 1 << level
        return out


def medians(x: np.ndarray, a: int, length: np.ndarray, n: int) -> np.ndarray:
    """Medians of the last ``length`` values, n at most, at the places from a on; NaN is passed over."""
    out = np.full(len(length), np.nan)
    padded = np.concatenate((np.full(n - 1, np.nan), x))
    for low in range(0, len(length), 4096):
        size = length[low : low + 4096]
        frames = np.lib.stride_tricks.sliding_window_view(padded[a + low : a + low + len(size) + n - 1], n)
        frames = np.sort(np.where(np.arange(n) < n - size[:, None], np.nan, frames), axis=1)  # NaN comes last
        count = n - np.isnan(frames).sum(axis=1)
        some = np.flatnonzero(count)
        at = (count[some] - 1) / 2
        below, above = frames[some, np.floor(at).astype(int)], frames[some, np.ceil(at).astype(int)]
        out[low + some] = np.where(below == above, below, 0.5 * below + 0.5 * above)
    return out


def sliding(df: DataFrame, frames: dict[str, tuple[str, str, int]], *, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Add columns, each (kind, column, n) over the row and the n - 1 rows before it of its key.

    Kinds: rows (of any value), count, sum, mean, std (of the population), median, max, min; all doubles. Null
    and NaN values take no part; without other ones counts are 0 and the rest is null.
    """
    before = max(n for _, _, n in frames.values()) - 1
    columns = sorted({c for kind, c, _ in frames.values() if kind != "rows"})

    def answer(part: pa.Table, a: int, b: int, first: np.ndarray, last: np.ndarray) -> list[pa.Array]:
        at = np.arange(a, b)
        moments: dict[str, Moments] = {}
        extremes: dict[str, Extremes] = {}
        made: dict[tuple[str, int], Parts] = {}
        spans: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        values = {c: floats(part, c) for c in columns}
        out = []
        for kind, column, n in frames.values():
            length = np.minimum(at + 1 - first, n)
            begin, this = at + 1 - length, (column, n)
            if kind == "rows":
                out.append(doubles(length.astype(np.float64)))
            elif kind == "median":
                out.append(doubles(medians(values[column], a, length, n)))
            elif kind in ("max", "min"):
                if column not in extremes:
                    extremes[column] = Extremes(values[column], values[column], before + 1)
                if this not in spans:
                    spans[this] = extremes[column].over(begin, length)
                out.append(doubles(spans[this][kind == "min"]))
            else:
                if column not in moments:
                    moments[column] = Moments(values[column], before + 1)
                if this not in made:
                    made[this] = moments[column].over(begin, length)
                count, mean, squares = made[this]
                some = np.where(count > 0, count, np.nan)
                out.append(doubles({"count": count, "sum": mean * some, "mean": mean + 0 * some, "std": np.sqrt(squares / some)}[kind]))
        return out

    return streamed(df, 0, [T.StructField(n, T.DoubleType()) for n in frames], answer, before=before, many=True, keys=keys, order=order)


def split_extremes(df: DataFrame, column: str, n: int, share: float, names: Sequence[str], *, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Of the values in the last n rows: how many, their deviation, and the extremes of the older ``share`` and of the newer rest.

    ``names``: the six columns, the highest before the lowest. Null and NaN values take no part.
    """

    def answer(part: pa.Table, a: int, b: int) -> list[pa.Array]:
        x, at = floats(part, column), np.arange(a, b)
        before = np.concatenate(([0], np.cumsum(~np.isnan(x))))
        x, begin = x[~np.isnan(x)], before[np.maximum(at + 1 - n, 0)]
        length = before[at + 1] - begin
        old = np.floor(length * share).astype(np.int64)
        count, _, squares = Moments(x, n).over(begin, length)
        index = Extremes(x, x, n)
        found = [count, np.sqrt(squares / np.where(count > 0, count, np.nan)), *index.over(begin, old), *index.over(begin + old, length - old)]
        return [doubles(v) for v in found]

    return streamed(df, 0, [T.StructField(name, T.DoubleType()) for name in names], answer, before=n - 1, keys=keys, order=order)
