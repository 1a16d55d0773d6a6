"""Removal of passages that occur twice or more, by windows of words and a count-min prefilter.

Documents are packed once in chunks of about ``SLICE_BYTES`` of text. Every chunk makes a sketch of its window
counts; all sketches together form one count-min sketch with ``DEPTH`` rows whose width grows with the corpus
(``WIDTH`` counters for ``PER_CELL`` windows), so its error is the same at every size. A sketch is kept sparse and
cut into cells; each cell of all chunks is merged in a task of its own, by adding counters that saturate at 2.
Nothing is broadcast: a chunk gets back one bit for each counter that it touched. Counters only overestimate, so
windows below 2 are certainly unique. The second pass groups the other ones exactly, by 96 bits of two independent
hashes of the window, dealt by hash; a chunk sends each different window once, with a mark if it has more of them,
so a passage in every document costs an entry per chunk. The third pass removes the covered words.

Cases: null and empty texts have no words; texts shorter than a window keep all; repeated rows and copies remove each
other; an empty table gives no rows. Columns of the input named like the results (in any case) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import slices, written
from tapeloom.llm.wordarrays import BASES, Stretches, lanes_of, mixed, words_of

#: Rows of the sketch, counters of a cell, windows that a cell is made for, entries that an exact cell is made for.
DEPTH, WIDTH, PER_CELL, PER_EXACT = 2, 1 << 24, 1 << 22, 1 << 20

CHUNKS = "chunk long, windows long, payload binary"
SKETCHES = "cell int, chunk long, slots binary, twice binary"
MASKS = "chunk long, cell int, mask binary"
ENTRIES = "cell int, chunk long, first binary, second binary, twice binary"


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def packed(values: np.ndarray) -> bytes:
    """Ascending 32-bit values as compressed differences, one plane for each byte."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    planes = steps.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = pa.decompress(data[4:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    steps = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)


def cells(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 64-bit hashes each is in."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


class Chunk:
    """Documents of a chunk with the hashes of their windows."""

    def __init__(self, payload: bytes, text: str, size: int):
        self.rows = pa.ipc.open_stream(payload).read_all()
        self.size = size
        self.words, self.offsets = words_of(self.rows.column(text).combine_chunks())
        ends = np.repeat(self.offsets[1:], np.diff(self.offsets))
        self.starts = np.flatnonzero(np.arange(len(self.words)) + size <= ends)
        self.hashes = [mixed(Stretches(lane, base).of(self.starts, size)) for lane, base in zip(lanes_of(self.words), BASES)]

    def counters(self, row: int, n: int, width: int) -> np.ndarray:
        """Counter of each window in a row of the sketch: cell, then place in the cell."""
        return (cells(self.hashes[row], n) << np.uint64(24)) | (self.hashes[row] & np.uint64(width - 1))

    def different(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different ones of some windows in order: two hashes, whether it is there twice, and each one's rank."""
        first, second = self.hashes[0][which], (self.hashes[1][which] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        return first[new], second[new], np.bincount(rank, minlength=int(new.sum())) > 1, rank


def runs(sorted_cells: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(cell, begin, end) of each stretch of equal cells."""
    cut = np.concatenate(([0], np.flatnonzero(sorted_cells[1:] != sorted_cells[:-1]) + 1, [len(sorted_cells)]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b > a:
            yield int(sorted_cells[a]), a, b


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def chunked(docs: DataFrame, text: str, size: int) -> DataFrame:
    """Rows packed in chunks, each with its number of windows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, text):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                n = np.diff(words_of(part.column(text))[1])
                yield batch_of([(at, int(np.maximum(n - size + 1, 0).sum()), sink.getvalue().to_pybytes())], CHUNKS)
                at += 1

    return docs.mapInArrow(pack, CHUNKS)


def sketched(chunks: DataFrame, text: str, size: int, n: int, width: int) -> DataFrame:
    """The sparse sketch of each chunk, cut in cells."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch["chunk"].to_pylist(), batch["payload"]):
                held = Chunk(payload.as_py(), text, size)
                for row in range(DEPTH):
                    touched, times = np.unique(held.counters(row, n, width), return_counts=True)
                    out = []
                    for cell, a, b in runs(touched >> np.uint64(24)):
                        out.append((row * n + cell, chunk, packed(touched[a:b] & np.uint64(width - 1)), bits(times[a:b] > 1)))
                    yield batch_of(out, SKETCHES)

    return chunks.select("chunk", "payload").mapInArrow(sketch, SKETCHES)


def merged(sketches: DataFrame, width: int) -> DataFrame:
    """For every chunk and cell, which of the counters that the chunk touched are 2 or more over all chunks."""

    def merge(cell: pa.Table) -> pa.Table:
        counters = np.zeros(width, np.uint8)
        rows = list(zip(cell["chunk"].to_pylist(), cell["cell"].to_pylist(), cell["slots"], cell["twice"]))
        for _, _, slots, twice in rows:
            at = unpacked(slots.as_py())
            counters[at] = np.minimum(counters[at] + flags(twice.as_py(), len(at)) + 1, 2)
        out = [(chunk, number, bits(counters[unpacked(slots.as_py())] > 1)) for chunk, number, slots, _ in rows]
        return pa.Table.from_batches([batch_of(out, MASKS)])

    return sketches.groupBy("cell").applyInArrow(merge, MASKS)


def gathered(masks: pa.Table, numbers: Iterator[tuple[int, int, int]], total: int) -> np.ndarray:
    """One array of the bits that came back for the given stretches; what did not come back is not set."""
    by_cell = dict(zip(masks["cell"].to_pylist(), masks["mask"].to_pylist()))
    out = np.zeros(total, bool)
    for cell, a, b in numbers:
        if cell in by_cell:
            out[a:b] = flags(by_cell[cell], b - a)
    return out


def suspected(chunks: DataFrame, masks: DataFrame, text: str, size: int, n: int, exact: int, width: int) -> DataFrame:
    """Windows whose every counter is 2 or more: entries dealt by hash, and in cell -1 the chunk's bits of them."""

    def select(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, held = left["chunk"][0].as_py(), Chunk(left["payload"][0].as_py(), text, size)
        kept = np.ones(len(held.starts), bool)
        for row in range(DEPTH):
            touched, place = np.unique(held.counters(row, n, width), return_inverse=True)
            numbers = ((row * n + cell, a, b) for cell, a, b in runs(touched >> np.uint64(24)))
            kept &= gathered(right, numbers, len(touched))[place]
        out = [(-1, chunk, bits(kept), None, None)]
        first, second, twice, _ = held.different(np.flatnonzero(kept))
        for cell, a, b in runs(cells(first, exact)):
            out.append((cell, chunk, first[a:b].tobytes(), second[a:b].tobytes(), bits(twice[a:b])))
        return pa.Table.from_batches([batch_of(out, ENTRIES)])

    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(select, ENTRIES)


def confirmed(entries: DataFrame) -> DataFrame:
    """For every chunk and cell, which of the entries that the chunk sent occur twice or more."""

    def group(cell: pa.Table) -> pa.Table:
        firsts, seconds = ([np.frombuffer(x.as_py(), kind) for x in cell[name]] for name, kind in (("first", np.uint64), ("second", np.uint32)))
        first, second = np.concatenate(firsts), np.concatenate(seconds)
        twice = np.concatenate([flags(x.as_py(), len(f)) for x, f in zip(cell["twice"], firsts)])
        order = np.lexsort((second, first))
        same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
        again = np.zeros(len(order), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        cut = np.cumsum([len(f) for f in firsts])[:-1]
        parts = zip(cell["chunk"].to_pylist(), cell["cell"].to_pylist(), np.split(again | twice, cut))
        return pa.Table.from_batches([batch_of([(chunk, number, bits(part)) for chunk, number, part in parts if part.any()], MASKS)])

    return entries.where("cell >= 0").groupBy("cell").applyInArrow(group, MASKS)


def without_repeats(docs: DataFrame, size: int = 35, text: str = "text", width: int = WIDTH) -> DataFrame:
    """Every row with ``n_words``, ``n_removed`` and ``kept``, its text without words in windows that occur again.

    ``width``, a power of 2 up to ``WIDTH``: counters of a cell; fewer of them pass more windows on to the exact pass.
    """
    added = T.StructType.fromDDL("n_words long, n_removed long, kept string")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added.names])
    schema = T.StructType([*docs.schema.fields, *added.fields])
    names = docs.columns

    chunks = written(chunked(docs, text, size), "chunks")
    total = chunks.agg(F.sum("windows")).first()[0] or 0
    n, exact = -(-total // PER_CELL) or 1, -(-total // PER_EXACT) or 1
    masks = written(merged(sketched(chunks, text, size, n, width), width), "masks")
    entries = written(suspected(chunks, masks, text, size, n, exact, width), "entries")
    bitmaps = entries.where("cell = -1").select("chunk", "cell", F.col("first").alias("mask"))
    found = bitmaps.unionByName(confirmed(entries))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        held = Chunk(left["payload"][0].as_py(), text, size)
        total = len(held.words)
        which = np.flatnonzero(gathered(right, iter([(-1, 0, len(held.starts))]), len(held.starts)))
        first, _, _, rank = held.different(which)
        again = gathered(right, runs(cells(first, exact)), len(first))[rank]
        edges = np.zeros(total + 1, np.int64)
        at = held.starts[which[again]]
        edges[at] += 1
        np.subtract.at(edges, at + size, 1)
        covered = np.cumsum(edges[:total]) > 0
        before = np.concatenate(([0], np.cumsum(covered)))
        removed = np.diff(before[held.offsets])
        kept = pa.ListArray.from_arrays(pa.array((held.offsets - before[held.offsets]).astype(np.int32)), held.words.filter(pa.array(~covered)))
        out = held.rows.select(names)
        columns = [*out.columns, pa.array(np.diff(held.offsets)), pa.array(removed), pc.binary_join(kept, " ")]
        return pa.Table.from_arrays(columns, names=schema.names)

    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(remove, schema)
