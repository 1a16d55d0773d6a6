"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may be found with up to ``floor(rate * n)`` edits (the error budget, one
at least from `FREE` characters on). It is split into budget + 1 pieces; edits touch at most budget of
them, so any occurrence holds one piece unchanged. An Aho-Corasick automaton finds all pieces in one
walk over a text; around each hit the item's window is verified with Myers' bit-parallel distance.

Texts and items are compared in lower case, with every run of characters that are neither letters nor
digits as one space, and with a space at both ends; begin and end count characters of that form.

The items go to the tasks in batches of at most `BATCH_CHARS` characters, so what is broadcast is
bounded however large the benchmark is. Items that are null or without letters and digits match
nothing; equal items are found once and reported for each id. Null texts hold nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import slices

RATE = 0.08
FREE = 20
BATCH_CHARS = 8_000_000
HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]), False)
#: Of each byte itself, or a space if it is ASCII and neither letter nor digit.
ASCII = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str) -> str:
    low = text.lower()
    if not low.isascii():
        for c in set(low):
            if c > "\x7f" and not c.isalnum():
                low = low.replace(c, " ")
    body = b" ".join(low.encode().translate(ASCII).split()).decode()
    return f" {body} " if body else ""


def budget(size: int, rate: float) -> int:
    return max(int(rate * size), 1) if size >= FREE and rate > 0 else 0


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least distance of the pattern to a part of the text, and where the first such part ends; None: over ``most``."""
    size = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last = (1 << size) - 1, 1 << size - 1
    up, down, score, best = full, 0, size, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(horizontal | up) & full, up & horizontal
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(vertical | plus) & full, plus & vertical
        if score <= most and (best is None or score < best[0]):
            best = score, at + 1
    return best


class Items:
    """Items of one batch, ready for search."""

    def __init__(self, items: dict[str, list[int]], rate: float):
        self.items = [(text, ids, budget(len(text), rate)) for text, ids in sorted(items.items())]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (text, _, errors) in enumerate(self.items):
            for at, piece in pieces(text, errors):
                places.setdefault(piece, []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """For each item in the text its best place, the first among equals: id, distance, begin, end."""
        text, windows = plain(text), {}
        if not text:
            return []
        for end, (size, where) in self.automaton.iter(text):
            for number, at in where:
                item, _, errors = self.items[number]
                start = end + 1 - size - at
                a, b = max(0, start - errors), min(len(text), start + len(item) + errors)
                if (mine := windows.setdefault(number, [])) and mine[-1][0] <= a <= mine[-1][1]:
                    mine[-1] = mine[-1][0], max(mine[-1][1], b)
                else:
                    mine.append((a, b))
        out = []
        for number, mine in windows.items():
            item, ids, errors = self.items[number]
            best = None
            for a, b in sorted(set(mine)):
                if (got := myers(item, text[a:b], errors)) and (best is None or got[0] < best[0]):
                    best = got[0], a + got[1]
                    if not got[0]:
                        break
            if best:
                distance, end = best
                # the same match from its end backwards tells where it begins
                back = myers(item[::-1], text[max(0, end - len(item) - errors) : end][::-1], distance)
                out += [(i, distance, end - back[1], end) for i in ids]
        return sorted(out, key=lambda x: (x[0] is None, x[0] or 0))


def batches_of(benchmark: DataFrame, item_id: str, text: str) -> Iterator[dict[str, list[int]]]:
    """The items by their plain text, at most BATCH_CHARS characters (or one item) at a time on the driver."""
    held, size = {}, 0
    for row in benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).toLocalIterator():
        if body := plain(row["text"]):
            if held and size + len(body) > BATCH_CHARS:
                yield held
                held, size = {}, 0
            held.setdefault(body, []).append(row["id"])
            size += len(body)
    if held:
        yield held


def flagged(docs: DataFrame, benchmark: DataFrame, text: str = "text", hits: str = "hits", rate: float = RATE, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``hits``: the items found, with distance, begin and end (empty: none).

    A column with the new name is replaced. Documents are read once for each batch of items.
    """
    fields = [f for f in docs.schema.fields if f.name != hits]
    schema = T.StructType([*fields, T.StructField(hits, HITS)])
    out = docs.select(*[f.name for f in fields]).withColumn(hits, F.array().cast(HITS))
    for items in batches_of(benchmark, item_id, item_text):
        out = out.mapInArrow(_finder(out.sparkSession.sparkContext.broadcast(items), rate, text, schema), schema)
    return out


def _finder(spread, rate: float, text: str, schema: T.StructType):
    kept, kind = schema.names[:-1], pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Items(spread.value, rate)
        for batch in batches:
            for part in slices(batch, text):
                before = part.column(schema.names[-1]).to_pylist()
                found = [b + [dict(zip(("item_id", "distance", "begin", "end"), x)) for x in search.find(t or "")] for b, t in zip(before, part.column(text).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.array(found, kind)], schema.names)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """A row (doc_id, item_id, distance, begin, end) for each document and each item found in it."""
    found = flagged(docs.select(doc_id, text), benchmark, text, rate=rate)
    return found.select(doc_id, F.explode("hits").alias("hit")).select(doc_id, "hit.*")
