"""What the next rows of a key hold, found while its rows stream by in order.

A task holds a batch and the next h rows, whatever the size of a key, with an index of their running
extremes (`Extremes`). Any number of barriers a row is searched in it by halving, and the highest and
lowest value of any stretch is two lookups; no row carries the rows ahead of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeloom.operators.ordered import KEYS, ORDER, fits, haloed


class Extremes:
    """Highest and lowest values of stretches of 1, 2, 4 .. values, up to ``longest``; NaN is passed over."""

    def __init__(self, high: np.ndarray, low: np.ndarray, longest: int):
        self.high, self.low, step = [high], [low], 1
        while 2 * step <= min(longest, len(high)):
            self.high.append(np.fmax(self.high[-1][:-step], self.high[-1][step:]))
            self.low.append(np.fmin(self.low[-1][:-step], self.low[-1][step:]))
            step *= 2

    def first(self, begin: np.ndarray, reach: np.ndarray, up: np.ndarray, down: np.ndarray, base: np.ndarray | float = 0.0) -> np.ndarray:
        """Which of the ``reach`` values from ``begin`` on is the first that, less the base, is at or beyond a barrier; from 1, 0 for none."""
        passed, base = np.zeros(len(begin), np.int64), np.broadcast_to(base, len(begin))
        for level in range(len(self.high) - 1, -1, -1):
            todo = np.flatnonzero(passed + (1 << level) <= reach)
            at = begin[todo] + passed[todo]
            met = (self.high[level][at] - base[todo] >= up[todo]) | (self.low[level][at] - base[todo] <= down[todo])
            passed[todo[~met]] += 1 << level
        return np.where(passed < reach, passed + 1, 0)

    def over(self, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest and lowest of the ``length`` values from ``begin`` on; NaN where there are none."""
        top, bottom = np.full(len(begin), np.nan), np.full(len(begin), np.nan)
        levels = np.frexp(np.maximum(length, 0))[1] - 1
        for level, (high, low) in enumerate(zip(self.high, self.low)):
            at = np.flatnonzero(levels == level)
            a, b = begin[at], begin[at] + length[at] - (1 << level)
            top[at], bottom[at] = np.fmax(high[a], high[b]), np.fmin(low[a], low[b])
        return top, bottom


def floats(part: pa.Table, name: str) -> np.ndarray:
    return part.column(name).cast(pa.float64()).to_numpy()


def doubles(values: np.ndarray) -> pa.Array:
    """NaN becomes null."""
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def key_codes(key: pa.Array) -> Iterator[np.ndarray]:
    """Numbers that are equal where the key is; several for a struct."""
    if pa.types.is_struct(key.type):
        yield key.is_valid().to_numpy(zero_copy_only=False)
        for field in key.flatten():
            yield from key_codes(field)
    else:
        yield key.dictionary_encode(null_encoding="encode").indices.to_numpy()


def key_starts(rows: pa.Table, keys: Sequence[str]) -> list[int]:
    """Places where another key begins, and the end; null and NaN are equal to themselves."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for key in keys:
        for codes in key_codes(rows.column(key).combine_chunks()):
            new[1:] |= codes[1:] != codes[:-1]
    return [*np.flatnonzero(new).tolist(), rows.num_rows]


def streamed(
    df: DataFrame,
    h: int,
    added: Sequence[T.StructField],
    answer: Callable[[pa.Table, int, int], list[pa.Array]],
    *,
    before: int = 0,
    check: bool = True,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    spent: Sequence[str] = (),
    many: bool = False,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Add columns: ``answer(part, a, b)`` gives them for the rows from a to b of a part of one key.

    ``many``: the part may hold several keys, so that small ones share the work of a call. Then it is
    ``answer(part, a, b, first, last)``, with the places where each row's key begins and ends.

    The part is in order and has the h rows after these and the ``before`` rows before them, fewer at the
    ends of the key. ``prepare`` adds columns to the sorted rows, so these are not shuffled; the columns ``spent`` are dropped. ``check=False``
    is for tables whose groups are bounded by the calendar, such as bars.
    """
    if not check or fits(df, keys):
        rows, groups, cut = df, list(keys), False
        rows = rows.repartition(*groups).sortWithinPartitions(*groups, *order)
    else:
        rows, groups, cut = haloed(df, keys, order, before, h), [*keys, "_blk"], True
        rows = rows.repartition(*groups).sortWithinPartitions(*groups, "_rn")
    rows = prepare(rows)
    names = [f.name for f in added]
    schema = T.StructType([f for f in rows.schema.fields if f.name not in (*names, *spent)] + list(added))
    kept = schema.names[: len(schema) - len(names)]

    def decided(part: pa.Table, a: int, b: int, starts: Sequence[int] = ()) -> pa.RecordBatch:
        bounds = np.array(starts or [0, part.num_rows])
        spans = [np.repeat(v, np.diff(bounds))[a:b] for v in (bounds[:-1], bounds[1:])] if many else []
        return pa.RecordBatch.from_arrays([part.column(c).slice(a, b - a).combine_chunks() for c in kept] + answer(part, a, b, *spans), schema.names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        done = 0  # rows at its head that are answered, kept for those after them
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, fresh]) if held is not None else fresh
            starts = key_starts(held, groups)
            if many and starts[-2] > done:
                yield decided(held.slice(0, starts[-2]), done, starts[-2], starts[:-1])
            done = 0 if many and starts[-2] else done
            for a, b in zip(starts[:-2], starts[1:]) if not many else ():  # keys that have ended
                if b - a > done:
                    yield decided(held.slice(a, b - a), done, b - a)
                done = 0
            held = held.slice(starts[-2])
            ready = held.num_rows - h
            if ready - done > max(h, before):  # so an index of the rows around is made for as many at least
                yield decided(held, done, ready)
                spare = max(ready - before, 0)
                held, done = held.slice(spare), ready - spare
            held = held.combine_chunks()
        if held is not None and held.num_rows > done:
            yield decided(held, done, held.num_rows)

    out = rows.mapInArrow(walk, schema)
    return out.filter("_own").drop("_rn", "_blk", "_own") if cut else out


def first_ahead(
    df: DataFrame,
    h: int,
    races: dict[str, tuple[str, str]],
    value: str,
    *,
    time: str = "ts_event",
    moves: bool = False,
    horizon: str | None = None,
    ends: Sequence[int] = (),
    skip: int = 0,
    path: bool = False,
    high: str | None = None,
    low: str | None = None,
    also: Sequence[str] = (),
    check: bool = True,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Add, for each race (upper column, lower column), the first of the next rows at or beyond either.

    With ``moves`` the change of the value is compared instead of the value. ``horizon``: a column
    with the rows to look ahead, at most h (null: h). Each race is a struct (_n: steps ahead, the
    value, the time), null where no row gets there; ``_end`` is the last row within the horizon,
    null without later rows, ``_end_<k>`` for each k of ``ends`` the last one of k rows. ``skip``: rows
    after which the search begins. With ``path`` come ``_from``, the value there, ``_top`` and
    ``_bottom``, the extremes of the rows looked at. Columns ``high`` and ``low`` are compared with the
    barriers instead of the value; columns ``also`` come in the structs. Null values and barriers are never met.
    """
    ends = list(dict.fromkeys(ends))
    shown = [value, time, *also]
    struct = T.StructType([T.StructField("_n", T.IntegerType()), *(T.StructField(c, df.schema[c].dataType) for c in shown)])
    names = [*races, "_end", *(f"_end_{k}" for k in ends)]
    added = [T.StructField(n, struct) for n in names] + [T.StructField(n, T.DoubleType()) for n in ("_from", "_top", "_bottom") if path]

    def answer(part: pa.Table, _: int, n: int, first: np.ndarray, last: np.ndarray) -> list[pa.Array]:
        x, begin = floats(part, value), np.arange(n) + skip
        reach = np.full(n, h)
        if horizon:
            wanted = floats(part, horizon)[:n]
            reach = np.where(np.isnan(wanted), h, np.clip(np.nan_to_num(wanted), 0, h)).astype(np.int64)
        reach = np.clip(last - 1 - begin, 0, reach)
        start = x[np.minimum(begin, part.num_rows - 1)]
        index = Extremes(floats(part, high or value), floats(part, low or value), h)
        steps = [index.first(begin + 1, reach, floats(part, up)[:n], floats(part, down)[:n], start if moves else 0.0) for up, down in races.values()]
        steps += [reach, *(np.minimum(reach, k) for k in ends)]
        columns = []
        for some in steps:
            none = some == 0
            at = pa.array(begin + some, mask=none)
            fields = [pa.array(some.astype(np.int32), mask=none), *(part.column(c).combine_chunks().take(at) for c in shown)]
            columns.append(pa.StructArray.from_arrays(fields, names=["_n", *shown], mask=pa.array(none)))
        if path:
            columns += [doubles(np.where(begin < last, start, np.nan)), *map(doubles, index.over(begin + 1, reach))]
        return columns

    return streamed(df, h + skip, added, answer, check=check, many=True, keys=keys, order=order)
