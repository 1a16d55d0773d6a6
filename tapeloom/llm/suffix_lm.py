"""A probabilistic suffix tree over words: fit on a corpus, score texts.

Tokens of a text are its words (ASCII letters lowered) and then one end. The tree's root is the
add-one unigram model. A context of one to `depth` words is retained if the next-symbol distribution
diverges from its parent's, the context without its oldest word: count * KL >= `DIVERGENCE` nats over
the successors seen twice or more. A state's distribution takes `DISCOUNT` off each such successor's
count and gives what is left to the parent's distribution, so every distribution sums to one. A text
is scored by walking it: the state of each token is the longest suffix of the words before it (in its
text) that was retained. The rules are absolute, so the tree grows with its corpus. A tree may be
pruned (`fit(heavy=)`): successors then need a share of 1 / heavy of all tokens, contexts `LEAST_CONTEXT`.

Scale. Counts, states and successors are Spark tables, made by group-by and join. Groups of words travel
packed: a task sends each bucket one block per `FLUSH_TOKENS` tokens, with each word's hash once and the
groups as places among them. Buckets are ranges of the first word's hash, for hot first words (1 / `HOT` of
all tokens or more) of the whole group's, and their number grows with the corpus (`PER_BUCKET`).

The logarithm of a text's probability is a sum over its word groups: a word gives its base and, as a
context, the weight it leaves to the root; a longer group gives what it gains over backing off and, as a
context, the weight it leaves to its parent. So texts are cut into chunks of up to `CHUNK` bytes; a chunk asks each
bucket of values once for all different groups it holds, and the answers come back to the chunk. Two things
of fixed size spare work and change no result: values of groups with a share of 1 / `HEAVY` of all tokens are
broadcast, and a bitmap of `BITS` bits rules out groups that have no value. Tables between two steps and the
shuffles of a step are deleted once the next table is written. Values travel to the nearest `UNIT`, 2^-40: that is
as little as the sums themselves round.

Words and groups are told apart by hashes. Null and empty texts consist of the end alone. Without
training tokens every token has probability 1 / (V + 1) = 1. Rows are kept one to one, whatever their ids.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import brief_shuffles, discard, give_back, slices, written
from tapeloom.llm.wordarrays import BASES, mixed, words_of

HEAVY = 1 << 19
LEAST_CONTEXT = 1e-4
DIVERGENCE = 20.0
DISCOUNT = 0.5
CHUNK = 16 << 20
FLUSH = 1_000_000
FLUSH_TOKENS = 1_500_000
BITS = 1 << 27
UNIT = 2.0**-40
HOT = 1 << 12
PER_BUCKET = 1 << 21
LOW = (1 << 63) - 1
END = xxhash.xxh3_64_intdigest(b"") >> 1  # no word is empty


class Lookup:
    """Values of whole numbers >= 0, by open addressing; looked up for many numbers at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: float):
        size = 1 << max(4, (3 * len(keys)).bit_length())
        self.mask, self.default = size - 1, default
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, default, values.dtype)
        todo, at = np.arange(len(keys)), self._first(keys)
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]  # of several in one place the last one stays
            placed = self.keys[at] == keys[todo]
            self.values[at[placed]] = values[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(20)).astype(np.int64) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        out, at = np.full(len(keys), self.default, self.values.dtype), self._first(keys)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out


def _hashes(words: pa.Array) -> np.ndarray:
    """63-bit hashes of words, of up to 16 bytes by arithmetic on all at once."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0]).tobytes() + bytes(16)
    at, sizes = ends[:-1] - ends[0], np.diff(ends)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each byte on
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    first, second = eight[at] & masks[np.minimum(sizes, 8)], eight[np.minimum(at + 8, len(data) - 8)] & masks[np.clip(sizes - 8, 0, 8)]
    out = mixed(mixed(first + np.uint64(BASES[0])) ^ (second * np.uint64(BASES[1]) + sizes.astype(np.uint64)))
    for i in np.flatnonzero(sizes > 16).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i] + sizes[i]])
    return (out >> np.uint64(1)).view(np.int64)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different tokens of all texts, each token's place among them, and how many each text has."""
    words, starts = words_of(pc.ascii_lower(texts.cast(pa.string())))
    coded = words.dictionary_encode()
    sizes = np.diff(starts) + 1
    tokens = np.full(len(words) + len(sizes), len(coded.dictionary), np.int64)  # the end's place
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(sizes) - 1] = False
    tokens[inner] = np.asarray(coded.indices)
    return np.append(_hashes(coded.dictionary), END), tokens, sizes


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In order, an index of each different key; where it begins in the order of all; and that order."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    return order[starts], starts, order


def _turn(level: int) -> int:
    return 4 + 13 * level  # another one per level, or the words in the middle would cancel out


def _key(older: Column, newer: Column, level: int) -> Column:
    """Key of a group of ``level`` + 1 words, from the keys of the group without its last and without its first."""
    turned = F.shiftleft(newer, _turn(level)).bitwiseOR(F.shiftrightunsigned(newer, 64 - _turn(level)))
    return older.bitwiseXOR(turned).bitwiseAND(F.lit(LOW))


def _joined(older: np.ndarray, newer: np.ndarray, level: int) -> np.ndarray:
    """`_key` of arrays."""
    older, newer = older.view(np.uint64), newer.view(np.uint64)
    turned = newer << np.uint64(_turn(level)) | newer >> np.uint64(64 - _turn(level))
    return ((older ^ turned) & np.uint64(LOW)).view(np.int64)


def _keys(tokens: np.ndarray, depth: int) -> list[np.ndarray]:
    """Per level the key of the group of level + 1 tokens that ends at each place; the first ``level`` of a text are void."""
    out = [tokens]
    for level in range(1, depth + 1):
        out.append(_joined(np.roll(out[-1], 1), out[-1], level))
    return out


def _places(sizes: np.ndarray) -> np.ndarray:
    """Place of each token in its text."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Two bits of ``BITS`` for each of the column ``key``."""
    spots = F.explode(F.array(F.col("key").bitwiseAND(F.lit(BITS - 1)), F.shiftright("key", 31).bitwiseAND(F.lit(BITS - 1))))
    set_bits = keys.select(spots.alias("spot")).select(F.shiftright("spot", 6).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("spot").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    got = _columns(set_bits.groupBy("at").agg(F.bit_or("bit").alias("bits")))
    out = np.zeros(BITS >> 6, np.int64)
    out[got["at"]] = got["bits"]
    return out.view(np.uint64)


def _held(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among those of the bitmap."""
    out = np.ones(len(keys), bool)
    for spot in (keys & (BITS - 1), keys >> 31 & (BITS - 1)):
        out &= (bitmap[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return out


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers >= 0, or logarithms to the nearest `UNIT`, in as few bytes as they need, all first bytes together, then all second ones."""
    out = []
    for a in arrays:
        kind = a.dtype.kind.encode()
        if kind == b"f":
            a = np.rint(a / UNIT).astype(np.int64)
            a = a << 1 ^ a >> 63  # the sign comes last
        a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
        out += [struct.pack("<cBq", kind, a.itemsize, len(a)), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    raw = b"".join(out)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(block: bytes) -> list[np.ndarray]:
    size = struct.unpack_from("<q", block)[0]
    raw, at, out = pa.decompress(memoryview(block)[8:], size, codec="zstd", asbytes=True), 0, []
    while at < size:
        kind, width, n = struct.unpack_from("<cBq", raw, at)
        at += struct.calcsize("<cBq")
        a = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(f"u{width}").reshape(n).astype(np.int64)
        out.append((a >> 1 ^ -(a & 1)) * UNIT if kind == b"f" else a)
        at += n * width
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The range of each key >= 0."""
    return np.minimum(keys // (LOW // buckets), buckets - 1)


def _blocks(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Each bucket that has any of these rows, which are in order, with where they begin and end."""
    ends = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
    return ((b, start, end) for b, (start, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if start < end)


# -- fitting -----------------------------------------------------------------------------------


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: list[tuple] = []
    held = 0

    def out() -> pa.RecordBatch:
        hashes, n = (np.concatenate(column) for column in zip(*seen, strict=True))
        at, starts, order = _distinct(hashes)
        return pa.RecordBatch.from_arrays([pa.array(hashes[at]), pa.array(np.add.reduceat(n[order], starts))], ["word", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            hashes, tokens, _ = _tokens(part.column("text"))
            seen.append((hashes, np.bincount(tokens, minlength=len(hashes))))
            held += len(hashes)
            if held > FLUSH:
                yield out()
                seen, held = [], 0
    if held:
        yield out()


def _groups(spread, level: int, buckets: int):
    """Count groups of ``level`` + 1 tokens and pack them by bucket: the hashes of the words, the place of each word of each group among them, counts.

    Left out are groups whose part without the last token, or without the first, is not in the bitmap, so is too rare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = spread.value
        seen: list[tuple] = []
        held = known = 0

        def out() -> pa.RecordBatch:
            hashes, tokens, at, key = (np.concatenate(column) for column in zip(*seen, strict=True))
            first, starts, _ = _distinct(key)
            n, key, at = np.diff(np.append(starts, len(key))), key[first], at[first]
            vocabulary, place = np.unique(hashes, return_inverse=True)
            tokens = place[tokens]
            bucket = np.where(np.isin(vocabulary, hot)[tokens[at - level]], _bucket(key, buckets), _bucket(vocabulary, buckets)[tokens[at - level]])
            order = np.argsort(bucket * len(vocabulary) + tokens[at - level])
            bucket, at, n = bucket[order], at[order], n[order]
            rows = []
            for b, start, end in _blocks(bucket, buckets):
                members = [tokens[at[start:end] - level + i] for i in range(level + 1)]
                used = np.zeros(len(vocabulary), bool)
                for member in members:
                    used[member] = True
                place = np.cumsum(used) - 1
                rows.append((b, _packed(vocabulary[used], *(place[member] for member in members), n[start:end])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "block"])

        for batch in batches:
            for part in slices(batch, "text"):
                hashes, tokens, sizes = _tokens(part.column("text"))
                below, whole = _keys(hashes[tokens], level)[-2:]
                often = _held(bitmap, below)
                at = np.flatnonzero((_places(sizes) >= level) & often & np.roll(often, 1))
                seen.append((hashes, tokens + known, at + held, whole[at]))
                held, known = held + len(tokens), known + len(hashes)
                if held > FLUSH_TOKENS:
                    yield out()
                    seen, held, known = [], 0, 0
                    give_back()
        if held:
            yield out()

    return run


def _counted(level: int, least: float):
    """Counts of the groups of a bucket, by the group without its last token and without its first; those below ``least`` are left out."""

    def run(blocks: pa.Table) -> pa.Table:
        parts = []
        for block in blocks.column("block").to_pylist():
            words, *members, n = _unpacked(block)
            parts.append([*(words[member] for member in members), n])
        *members, n = (np.concatenate(column) for column in zip(*parts, strict=True))
        del parts
        for size in range(1, level + 1):
            below = members
            members = [_joined(older, newer, size) for older, newer in zip(below[:-1], below[1:], strict=True)]
        first, starts, order = _distinct(members[0])
        n = np.add.reduceat(n[order], starts)
        first, n = first[n >= least], n[n >= least]
        give_back()
        return pa.table([pa.array(x) for x in (below[0][first], below[1][first], n)], ["older", "newer", "n"])

    return run


@dataclass
class Model:
    """What tasks need. Groups of words are told apart by their keys.

    total: tokens in training; kinds: different ones; depth: words of the longest context;
    keys, counts, values: of the frequent groups their counts (0 for more than one word) and values;
    rest: per depth the weights that the frequent retained contexts leave to their parents;
    bitmap: of the keys of all groups of more than one word that have a value.
    """

    total: int
    kinds: int
    depth: int
    keys: np.ndarray
    counts: np.ndarray
    values: np.ndarray
    rest: list[np.ndarray]
    bitmap: np.ndarray

    @cached_property
    def place(self) -> Lookup:
        return Lookup(self.keys, np.arange(len(self.keys), dtype=np.int32), -1)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.total + self.kinds + 1.0))


def _columns(df: DataFrame) -> dict[str, np.ndarray]:
    got = df.toArrow()
    return {c: got.column(c).to_numpy() for c in got.column_names}


def fit(docs: DataFrame, depth: int = 2, heavy: int | None = None) -> tuple[Model, DataFrame]:
    """The tree from column text: what tasks need, and the table of all groups of words that have a value.

    Its columns: key, of longer groups its complement; n, the count of a word, 0 for longer groups; value, log10 of what is added to the base.
    ``heavy`` prunes the tree.
    """
    with brief_shuffles(docs.sparkSession):
        return _fit(docs, depth, heavy)


def _fit(docs: DataFrame, depth: int, heavy: int | None) -> tuple[Model, DataFrame]:
    rows = docs.select("text")
    counts = written(rows.mapInArrow(_unigrams, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "unigrams")
    of = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).first()
    total, kinds = of["total"] or 0, of["kinds"]
    least, least_context = (max(2.0, total / heavy), LEAST_CONTEXT * total) if heavy else (2.0, 2.0)
    often = total / HEAVY  # groups of one size with so many occurrences are at most ``HEAVY``
    hot, buckets = _columns(counts.where(F.col("n") >= total / HOT).select("word"))["word"], math.ceil(total / PER_BUCKET)
    spread = docs.sparkSession.sparkContext.broadcast
    none = F.lit(0.0)
    # groups of one size: key, count, probability of the last word after the others, log10 of its gain over backing off
    groups = counts.select(F.col("word").alias("key"), "n", ((F.col("n") + 1.0) / (total + kinds + 1.0)).alias("p"), none.alias("gained"))
    rest: list[np.ndarray] = []
    tables, past = [], [counts]
    for level in range(1, (depth if total else 0) + 1):
        known = spread((_bitmap(groups.where(F.col("n") >= least).select("key")), hot))
        blocks = rows.mapInArrow(_groups(known, level, buckets), "bucket int, block binary")
        found = blocks.groupBy("bucket").applyInArrow(_counted(level, least), "older long, newer long, n long")
        parent = groups.select(F.col("key").alias("newer"), F.col("p").alias("before"))
        context = groups.where(F.col("n") >= least_context).select(F.col("key").alias("older"), F.col("n").alias("occurs"))
        found = written(found.join(parent, "newer").join(context, "older"), "successors")
        known.destroy()
        left = F.greatest(F.col("occurs") - F.col("seen"), F.lit(0)).cast("double")
        gain = F.col("gain") + left * F.log(F.greatest(left, F.lit(1e-12)) / F.col("occurs") / F.greatest(F.lit(1e-12), 1 - F.col("before")))
        sums = found.groupBy("older").agg(
            F.first("occurs").alias("occurs"),
            F.sum("n").alias("seen"),
            F.sum(F.col("n") * F.log(F.col("n") / F.col("occurs") / F.col("before"))).alias("gain"),
            F.sum("before").alias("before"),
            F.sum(F.col("n") - DISCOUNT).alias("taken"),
        )
        states = written(sums.where(gain >= DIVERGENCE).select("older", F.col("occurs").alias("times"), ((F.col("occurs") - F.col("taken")) / F.col("occurs")).alias("rest")), "states")
        rest.append(_columns(states.where(F.col("times") >= often).select("rest"))["rest"])
        lost = states.select(F.col("older").alias("key"), F.log10("rest").alias("lost"))
        tables.append(groups.join(lost, "key", "left").select("key", F.when(F.lit(level == 1), F.col("n")).otherwise(0).alias("n"), F.col("n").alias("times"), (F.col("gained") + F.coalesce("lost", none)).alias("value")))
        back = F.coalesce("rest", F.lit(1.0)) * F.col("before")
        p = F.when(F.col("rest").isNull(), F.col("before")).otherwise((F.col("n") - DISCOUNT) / F.col("occurs") + back)
        made = found.join(states.select("older", "rest"), "older", "left").select(_key(F.col("older"), F.col("newer"), level).alias("key"), "n", p.alias("p"), F.log10(p / back).alias("gained"))
        past += [states]
        if level < depth:
            groups = written(made, "groups")
            discard(found)
            past += [groups]
        else:
            groups, past = made, [*past, found]
    tables.append(groups.select("key", F.when(F.lit(not tables), F.col("n")).otherwise(0).alias("n"), F.col("n").alias("times"), F.col("gained").alias("value")))
    valued = tables[0]
    for more in tables[1:]:
        valued = valued.unionByName(more.where("value != 0").withColumn("key", F.bitwise_not("key")))  # no word has such a key
    valued = written(valued, "values")
    discard(*past)
    top = _columns(valued.where(F.col("times") >= often).drop("times"))
    bitmap = _bitmap(valued.where("key < 0").select(F.bitwise_not("key").alias("key")))
    return Model(total, kinds, depth, np.maximum(top["key"], ~top["key"]), top["n"], top["value"], rest, bitmap), valued.drop("times")


# -- scoring -----------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, groups: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of each row, n_tokens, n_known, base_score and score (log10). Clashing names are replaced."""
    new = ["n_tokens", "n_known", "base_score", "score"]
    fields = [f for f in docs.schema.fields if f.name in keep and f.name not in new]
    kept = [f.name for f in fields]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in new[:2]), *(T.StructField(n, T.DoubleType()) for n in new[2:])])
    spread = docs.sparkSession.sparkContext.broadcast(model)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("size")).first()["size"] or 0
    buckets = max(1, math.ceil(max(model.total, size // 5) / PER_BUCKET))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as places among the hashes of their words. The same rows of the same partition give the same chunk again."""
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                block, sink = _packed(*_tokens(part.column("text"))), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, (columns := part.select(kept)).schema) as to:
                    to.write_batch(columns)
                rows = sink.getvalue().to_pybytes()
                chunk = xxhash.xxh3_64_intdigest(rows + block, seed=TaskContext.get().partitionId()) >> 1
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([rows], pa.binary()), pa.array([block], pa.binary())], ["chunk", "kept", "block"])

    def walked(block: bytes) -> tuple:
        """A chunk's words, tokens and sizes; per size of groups: places, what is known (-1: to be asked for) and, of what is asked for, keys by bucket and which one each place has."""
        m: Model = spread.value
        hashes, tokens, sizes = _unpacked(block)
        places, levels = _places(sizes), []
        for level, keys in enumerate(_keys(hashes[tokens], m.depth)):
            if level:
                at = np.flatnonzero((places >= level) & _held(m.bitmap, keys))
                keys = keys[at]
            else:
                at, keys = np.arange(len(hashes)), hashes
            found = m.place.get(keys)
            keys = keys[found < 0]
            first, starts, order = _distinct(keys)
            same = np.empty(len(keys), np.int64)
            same[order] = np.repeat(np.arange(len(first)), np.diff(np.append(starts, len(keys))))
            levels.append((at, found, _bucket(keys[first], buckets), keys[first], same))
        return tokens, sizes, levels

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, block in zip(batch.column("chunk").to_pylist(), batch.column("block").to_pylist(), strict=True):
                levels = walked(block)[2]
                asked: dict[int, list] = {}
                for i, (_, _, bucket, keys, _) in enumerate(levels):
                    for b, start, end in _blocks(bucket, buckets):
                        asked.setdefault(b, [np.zeros(0, np.int64)] * len(levels))[i] = np.diff(keys[start:end], prepend=0)
                rows = [(b, _packed(*x)) for b, x in asked.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "chunk", "block"])
        give_back()

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys, counts and values by bucket, of words and of longer groups."""
        seen: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            key, n, value = (np.concatenate([b.column(c).to_numpy() for b in seen]) for c in ("key", "n", "value"))
            parts = []
            for chosen in (key >= 0, key < 0):
                some = np.flatnonzero(chosen)
                keys = np.maximum(key[some], ~key[some])
                order = np.argsort(keys)
                parts.append((_bucket(keys[order], buckets), keys[order], n[some][order], value[some][order]))
            blocks: dict[int, list] = {}
            for i, (bucket, *columns) in enumerate(parts):
                for b, start, end in _blocks(bucket, buckets):
                    keys, *rest = (c[start:end] for c in columns)
                    blocks.setdefault(b, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)] * 2)[3 * i : 3 * i + 3] = [np.diff(keys, prepend=0), *rest]
            return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([_packed(*x) for x in blocks.values()], pa.binary())], ["bucket", "values"])

        for batch in batches:
            seen.append(batch)
            if sum(b.num_rows for b in seen) > FLUSH:
                yield out()
                seen = []
        if sum(b.num_rows for b in seen):
            yield out()
        give_back()

    def answer(asked: pa.Table, values: pa.Table) -> pa.Table:
        parts = [_unpacked(block) for block in values.column("values").to_pylist()]
        known = []
        for i in (0, 3):
            key = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(p[i]) for p in parts)])
            n, value = (np.concatenate([np.zeros(0, kind), *(p[i + j] for p in parts)]) for j, kind in ((1, np.int64), (2, float)))
            order = np.argsort(key)
            known.append((key[order], np.append(n[order], 0), np.append(value[order], 0.0)))
        blocks = []
        for block in asked.column("block").to_pylist():
            out = []
            for level, keys in enumerate(_unpacked(block)):
                key, n, value = known[min(level, 1)]
                keys = np.cumsum(keys)
                at = np.searchsorted(key, keys)
                at[np.append(key, -1)[at] != keys] = len(key)
                out += [value[at]] if level else [n[at], value[at]]
            blocks.append(_packed(*out))
        give_back()
        return pa.table([asked.column("chunk"), asked.column("bucket"), pa.array(blocks, pa.binary())], ["chunk", "bucket", "answer"])

    def summed(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        m: Model = spread.value
        given = dict(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True))  # equal chunks got equal answers
        given = {b: _unpacked(block) for b, block in given.items()}
        made = []
        for kept_rows, block in zip(chunks.column("kept").to_pylist(), chunks.column("block").to_pylist(), strict=True):
            tokens, sizes, levels = walked(block)
            own = np.zeros(len(tokens))
            for level, (at, found, bucket, keys, same) in enumerate(levels):
                got = np.zeros(len(keys))
                n = np.zeros(len(keys), np.int64)
                for b, start, end in _blocks(bucket, buckets):
                    got[start:end] = given[b][level + 1]
                    if not level:
                        n[start:end] = given[b][0]
                value = np.append(m.values, 0.0)[found]
                value[found < 0] = got[same]
                if level:
                    own[at] += value
                else:
                    times = np.append(m.counts, 0)[found]
                    times[found < 0] = n[same]
                    base, seen = m.base(times)[tokens], (times > 0)[tokens]
                    own += value[tokens]
            starts = np.cumsum(sizes) - sizes
            columns = [pa.array(sizes), pa.array(np.add.reduceat(seen.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(base + own, starts))]
            made.append(pa.table([*pa.ipc.open_stream(kept_rows).read_all().columns, *columns], schema.names))
        give_back()
        return pa.concat_tables(made)

    texts = docs.select(*dict.fromkeys([*kept, "text"]))
    chunks = texts.mapInArrow(chunked, "chunk long, kept binary, block binary").repartition("chunk")
    asked = chunks.mapInArrow(asking, "bucket int, chunk long, block binary")
    values = groups.select("key", "n", "value").mapInArrow(valued, "bucket int, values binary")
    answers = asked.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(answer, "chunk long, bucket int, answer binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(summed, schema)
