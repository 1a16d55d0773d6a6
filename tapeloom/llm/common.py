"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.runtime import brief_shuffles, discard, written  # noqa: F401

# Bytes of text that one step of a Python task handles at a time; bounds its memory.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text has that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def bounded(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """A sample of at most about ``rows`` rows by the hash of ``key``: the same rows on any partitioning."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def give_back() -> None:
    """Return freed memory to the system; else a task's process keeps the most that it ever held while the JVM grows."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``most`` bytes of text, or one row."""
    lengths = batch.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(lengths), 0))
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size + 64
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back()


def byte_texts(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if t is None else t for t in array.cast(pa.binary()).to_pylist()]


def lists(parts: Iterable[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One Arrow list for each array."""
    parts = list(parts)
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
