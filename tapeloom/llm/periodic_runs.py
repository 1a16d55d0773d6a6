"""Maximal runs of words: stretches that repeat with a smallest period, three times or more.

The texts of an Arrow slice form one sequence of word codes, with a code of its own after each text, so that no run
leaves its text. At scale t (1, 2, 4, ..) the string synchronising set holds the positions whose t words, or those t
further, have the least hash among the stretches of t words that begin within the next t; stretches with a period of
t / 3 or less, known from the runs of smaller scales, are left out. Which positions belong to the set depends on the
2 t words after them only, so inside a run they come back after each period. A position and the next one with the
same context, 3 t or 4 t words, propose their distance as a period from 2 t to 4 t: in a run of period p with p at
most the context, the next equal context is exactly p away, as two periods that fit twice would have their greatest
common divisor as one. Contexts lie to the right of the position, or begin t before it: three periods have room for
one of the two wherever in its period the position is. Period 1 is read off directly. Proposals are extended by
binary search on hashes of stretches, compared word by word, and kept if no smaller period divides them.

A text stays in one task (a run can span it all); steps are vectorised over a slice, and only texts long enough take
part in a scale. Cases: null, empty and short texts have no runs; repeated rows are handled one by one; an empty
table gives no rows. Columns of the input named like the results (in any case) are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import slices, unused
from tapeloom.llm.wordarrays import Stretches, mixed, words_of

#: Periods that a run holds at least.
TIMES = 3
NONE = np.iinfo(np.uint64).max


@functools.lru_cache(maxsize=1 << 16)
def prime_factors(n: int) -> tuple[int, ...]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return tuple(out + [n] * (n > 1))


class Sequence:
    """The texts of some documents one after the other, each followed by a code of its own."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, docs: np.ndarray):
        sizes = np.diff(offsets)[docs]
        self.begins = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]  # place of each document's first word
        self.docs, self.sizes = docs, sizes
        self.codes = np.empty(int((sizes + 1).sum()), np.int64)
        ends = self.begins + sizes
        self.codes[ends] = -1 - docs
        inside = np.ones(len(self.codes), bool)
        inside[ends] = False
        self.codes[inside] = codes[np.repeat(offsets[:-1][docs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        self.stretches = Stretches(mixed(self.codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        self.top = int(sizes.max(initial=0)).bit_length()

    def place(self, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        return self.begins[np.searchsorted(self.docs, doc)] + start

    def equal_words(self, at: np.ndarray, step: int, way: int) -> np.ndarray:
        """How many words from ``at`` on (way 1) or before it (way -1) equal those ``step`` further."""
        n, size = np.zeros(len(at), np.int64), len(self.codes)
        for b in range(self.top, -1, -1):
            more = 1 << b
            begin = at + n if way > 0 else at - n - more
            fits = np.flatnonzero((begin >= 0) & (begin + step + more <= size))
            here = begin[fits]
            same = self.stretches.of(here, more) == self.stretches.of(here + step[fits], more)
            n[fits[same]] += more
        return n

    def synchronising(self, t: int, left_out: np.ndarray) -> np.ndarray:
        """Positions of the set at scale t; ``left_out`` marks starts of highly periodic stretches of t words."""
        h = mixed(self.stretches.every(t))
        h[h == NONE] -= np.uint64(1)
        h[left_out[: len(h)]] = NONE
        least, w = h, 1
        while w < t:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        least = np.minimum(least[:-1], least[1:])  # over the stretches that begin at i .. i + t
        return np.flatnonzero((least != NONE) & ((least == h[: len(least)]) | (least == h[t : t + len(least)])))

    def proposals(self, sync: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances to the next position with an equal context."""
        at, step = [], []
        for size, nearest, farthest in ((3 * t, 2 * t, 3 * t), (4 * t, 3 * t + 1, 4 * t - 1)):
            for before in (0, t):
                if nearest > farthest:
                    continue
                begin = sync - before
                begin = begin[(begin >= 0) & (begin + size <= len(self.codes))]
                context = self.stretches.of(begin, size)
                order = np.argsort(context)
                new = np.diff(context[order], prepend=np.uint64(0)) != 0
                # equal contexts by position: a value sort by (rank of the context, place) is faster than a stable one
                place = np.sort((np.cumsum(new) << 32) | order) & 0xFFFFFFFF
                same = np.flatnonzero(~new[1:])
                i, j = begin[place[same]], begin[place[same + 1]]
                ok = (j - i >= nearest) & (j - i <= farthest)
                at.append(i[ok])
                step.append((j - i)[ok])
        return np.concatenate(at), np.concatenate(step)

    def runs(self, at: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Maximal runs (document, start, length, period) that the proposals lie in."""
        begin = at - self.equal_words(at, step, -1)
        end = at + self.equal_words(at, step, 1) + step
        long = np.flatnonzero(end - begin >= TIMES * step)
        seen = {(int(begin[k]), int(step[k])): (int(at[k]), int(end[k])) for k in long[::-1]}
        out = []
        for (a, p), (i, b) in seen.items():
            if not np.array_equal(self.codes[a : b - p], self.codes[a + p : b]):  # hashes collided
                differ = np.flatnonzero(self.codes[:-p] != self.codes[p:])
                k = np.searchsorted(differ, i)
                a, b = int(differ[k - 1]) + 1 if k else 0, int(differ[k]) + p if k < len(differ) else len(self.codes)
                if b - a < TIMES * p:
                    continue
            if any(np.array_equal(self.codes[a : b - q], self.codes[a + q : b]) for q in (p // f for f in prime_factors(p))):
                continue
            k = int(np.searchsorted(self.begins, a, "right")) - 1
            out.append((int(self.docs[k]), a - int(self.begins[k]), b - a, p))
        return np.array(out, np.int64).reshape(-1, 4)


def all_runs(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Every maximal run (document, start, length, smallest period) of three periods or more, of all documents."""
    sizes = np.diff(offsets)
    found = np.zeros((0, 4), np.int64)
    seq, t = None, 1
    while True:
        docs = np.flatnonzero(sizes >= (TIMES if seq is None else TIMES * 2 * t))
        if not len(docs):
            return found
        if seq is None or len(docs) < len(seq.docs):
            seq = Sequence(codes, offsets, docs)
        if t == 1:
            at = np.flatnonzero(seq.codes[1:] == seq.codes[:-1])
            at = at[np.diff(at, prepend=-2) > 1]  # the first of each stretch
            found = np.concatenate((found, seq.runs(at, np.ones(len(at), np.int64))))
        left_out = np.zeros(len(seq.codes) + 1, np.int64)
        small = found[(found[:, 3] * 3 <= t) & (found[:, 2] >= t)]
        small = small[np.isin(small[:, 0], seq.docs)]
        begin = seq.place(small[:, 0], small[:, 1])
        np.add.at(left_out, begin, 1)
        np.subtract.at(left_out, begin + small[:, 2] - t + 1, 1)
        sync = seq.synchronising(t, np.cumsum(left_out[:-1]) > 0)
        found = np.unique(np.concatenate((found, seq.runs(*seq.proposals(sync, t)))), axis=0)
        t *= 2


def collapsed(docs: DataFrame, text: str = "text", least: int = 24) -> DataFrame:
    """Every row with ``runs`` of ``least`` words or more, by start and period, and ``collapsed``.

    The latter is the text without the words that a run holds after its first period.
    """
    added = T.StructType.fromDDL("runs array<struct<start:long,length:long,period:long>>, collapsed string")
    source = unused(docs, "source")
    names = [c for c in docs.columns if c.lower() not in added.names]
    schema = T.StructType([*[docs.schema[c] for c in names], *added.fields])
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(source))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source):
                words, offsets = words_of(part.column(source))
                codes = np.asarray(words.dictionary_encode().indices).astype(np.int64) if len(words) else np.zeros(0, np.int64)
                found = all_runs(codes, offsets)
                found = found[found[:, 2] >= least]
                found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
                edges = np.zeros(len(words) + 1, np.int64)
                begin = offsets[found[:, 0]] + found[:, 1]
                np.add.at(edges, begin + found[:, 3], 1)
                np.subtract.at(edges, begin + found[:, 2], 1)
                dropped = np.cumsum(edges[:-1]) > 0
                before = np.concatenate(([0], np.cumsum(dropped)))
                kept = pa.ListArray.from_arrays(pa.array((offsets - before[offsets]).astype(np.int32)), words.filter(pa.array(~dropped)))
                ends = np.searchsorted(found[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], runs, pc.binary_join(kept, " ")], names=schema.names)

    return rows.mapInArrow(scan, schema)
