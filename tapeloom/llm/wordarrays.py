"""Words of many texts as flat arrays, and hashes of any stretch of them in constant time."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd bases of the two hash lanes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` in a row, and where each text's begin; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat = lists.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0  # text that begins or ends with blanks gives empty parts
    before = np.concatenate(([0], np.cumsum(real)))
    offsets = np.asarray(lists.offsets)
    return flat.filter(pa.array(real)), before[offsets - offsets[0]]


def lanes_of(words: pa.Array) -> np.ndarray:
    """Two 64-bit hashes of each word, as rows of a (2, n) array."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    digests = b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist())
    table = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return np.ascontiguousarray(table[np.asarray(coded.indices)].T) if len(words) else np.zeros((2, 0), np.uint64)


@functools.lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))))


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    return _powers(base, max(1, 1 << (n - 1).bit_length()))[:n]


class Stretches:
    """Hashes of stretches of a sequence of 64-bit values: equal stretches have equal hashes."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]

    def every(self, length: int) -> np.ndarray:
        """Hashes of all stretches of that length, by start."""
        n = max(0, len(self.sums) - length)
        return (self.sums[length : length + n] - self.sums[:n]) * self.back[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """The same hashes with every bit depending on all others."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))
