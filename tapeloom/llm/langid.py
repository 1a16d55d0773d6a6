"""Language identification by bit-sliced Bloom filters of letter n-grams.

One slot of the filter holds a bit for each language, so one look-up per hash and a bitwise AND give
the mask of all languages that contain an n-gram. For each text the masks' bits are counted per
language, the counts are corrected for each filter's rate of false positives, and the language with
the most n-grams left wins; ties and texts without any known n-gram go to the language with more
training texts, then to the smaller name.

N-grams are the three-letter windows of each word, lower-cased and padded with a space on both sides;
whatever is no letter parts words, and a run of over a million letters is cut. A language contains an
n-gram if a thousandth of its training texts hold it and no other language displaces it, so a stray
foreign line teaches nothing. What counts is the n-gram's rate, its part of a text's n-grams as a mean
over the language's training texts, whatever their number and length: a rate in another language
displaces it if less than a quarter of it (`RATIO`) is reached. Before that the other rate is taken
times n / (n + `FEW`), n being the texts that hold the n-gram, so few texts displace nothing common.
Of each language the ``GRAMS`` n-grams found in most texts are kept. All training texts are counted.

Null texts and texts without a letter are ``und`` with score 0. Rows with a null language are not
learned from. Without anything to learn from every text is ``und``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import slices

SPACE = 32
GRAMS = 8_192
LEAST, RATIO, FEW = 0.001, 0.25, 20
WHOLE = 1 << 32  # rates are summed as whole numbers, so that no order of the texts changes them
PIECE = 1 << 20
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    out = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and (c := chr(i)).isalpha():
            out[i] = ord(c.lower()[0])
    return out


def pieces(text: str) -> Iterator[str]:
    """A long text in parts that end between words."""
    letters, at = _letters(), 0
    while len(text) - at > PIECE:
        part = letters[np.frombuffer(text[at : at + PIECE].encode("utf-32-le"), np.uint32)]
        gaps = np.flatnonzero(part == SPACE)
        stop = int(gaps[-1]) + 1 if len(gaps) else PIECE
        yield text[at : at + stop]
        at += stop
    yield text[at:]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts, and the number of the text that each is from."""
    codes = np.frombuffer(" ".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + (i + 1 < len(texts)) for i, t in enumerate(texts)])
    folded = _letters()[codes]
    kept = np.ones(len(folded), bool)
    kept[1:] = (folded[1:] != SPACE) | (folded[:-1] != SPACE)
    folded, owner = folded[kept], owner[kept]
    folded = np.concatenate(([SPACE], folded, [SPACE])).astype(np.uint64)
    middle = np.flatnonzero(folded[1:-1] != SPACE)
    found = folded[middle] | folded[middle + 1] << np.uint64(21) | folded[middle + 2] << np.uint64(42)
    return found, owner[middle]


@dataclass
class Languages:
    """names: most training texts first. slots: size x words of 64 languages; wrong: rate of false positives."""

    names: list[str]
    slots: np.ndarray
    wrong: np.ndarray
    hashes: int

    @staticmethod
    def _places(found: np.ndarray, hashes: int, size: int) -> Iterator[np.ndarray]:
        x = found.copy()
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)[:hashes]:  # odd multipliers
            x = (x ^ (x >> np.uint64(31))) * np.uint64(seed)
            yield (x >> np.uint64(40)).astype(np.int64) & (size - 1)

    @classmethod
    def build(cls, names: list[str], known: list[np.ndarray], hashes: int = 3) -> Languages:
        most = max((len(k) for k in known), default=0)
        size = 1 << max(10, (32 * most).bit_length())
        size = min(size, 1 << 22)
        slots = np.zeros((size, max(1, -(-len(names) // 64))), np.uint64)
        for i, some in enumerate(known):
            for at in cls._places(some, hashes, size):
                slots[at, i // 64] |= np.uint64(1 << i % 64)
        full = np.array([np.mean(slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(names))])
        return cls(names, slots, full**hashes, hashes)

    def masks(self, found: np.ndarray) -> np.ndarray:
        """All languages that contain each n-gram, as bits."""
        out = None
        for at in self._places(found, self.hashes, len(self.slots)):
            out = self.slots[at] if out is None else out & self.slots[at]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: n-grams of each language, and n-grams in all."""
        found, owner = grams(texts)
        masks = self.masks(found)
        by = [np.bincount(owner[(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=len(texts)) for i in range(len(self.names))]
        return np.stack(by, 1).reshape(len(texts), -1), np.bincount(owner, minlength=len(texts))

    def predict(self, counts: np.ndarray, total: np.ndarray) -> tuple[list[str], np.ndarray]:
        real = np.clip((counts - total[:, None] * self.wrong) / np.maximum(1e-9, 1 - self.wrong), 0, None)
        best, score = real.argmax(1), real.max(1) / np.maximum(1e-9, real.sum(1))
        score = np.where(total > 0, score, 0.0)
        return [self.names[b] if n else UNKNOWN for b, n in zip(best.tolist(), total.tolist())], score


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            langs = np.array(part.column("lang").to_pylist(), object)
            texts = part.column("text").to_pylist()
            for lang in sorted(set(langs)):
                seen: list[np.ndarray] = []
                rates: list[np.ndarray] = []
                for text in (t for t, of in zip(texts, langs) if of == lang):
                    own, times = zip(*(np.unique(grams([p])[0], return_counts=True) for p in pieces(text)))
                    found, where = np.unique(np.concatenate(own), return_inverse=True)
                    times = np.bincount(where, np.concatenate(times), len(found))
                    seen.append(found)
                    rates.append(np.floor(times * (WHOLE / max(1.0, times.sum()))))
                found, where, n = np.unique(np.concatenate(seen), return_inverse=True, return_counts=True)
                rate = np.bincount(where, np.concatenate(rates), len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n), pa.array(rate)], ["lang", "gram", "n", "rate"])


def train(rows: DataFrame, grams_kept: int = GRAMS) -> Languages:
    """Filters from columns text and lang."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Languages.build([], [])
    counted = rows.mapInArrow(_count, "lang string, gram long, n long, rate long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("rate").alias("rate"))
    of = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, float(n))])[F.col("lang")]
    rates = counted.where(F.col("n") / of >= LEAST).withColumn("rate", F.col("rate") / of)
    sure = F.col("rate") * F.col("n") / (F.col("n") + FEW)
    rates = rates.withColumn("most", F.max(sure).over(Window.partitionBy("gram"))).where(F.col("rate") >= RATIO * F.col("most"))
    ranked = F.slice(F.sort_array(F.collect_list(F.struct(-F.col("n"), "gram"))), 1, grams_kept)["gram"]
    kept = rates.groupBy("lang").agg(ranked.alias("grams"))  # n-grams that are frequent in a language are few
    found = {r["lang"]: np.array(r["grams"], np.int64).astype(np.uint64) for r in kept.collect()}
    names = sorted(sizes, key=lambda x: (-sizes[x], x))
    return Languages.build(names, [found.get(x, np.zeros(0, np.uint64)) for x in names])


def identify(df: DataFrame, model: Languages, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` (else all), and lang_pred and score, which replace columns of these names."""
    fields = [f for f in df.schema.fields if f.name in (keep or df.columns) and f.name not in ("lang_pred", "score")]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    kept = [f.name for f in fields]
    spread = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        for batch in batches:
            for part in slices(batch, text, PIECE):
                texts = [t or "" for t in part.column(text).to_pylist()]
                if not m.names:
                    counts = total = np.zeros(0)
                    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                elif len(texts) == 1:
                    counts, total = (sum(x) for x in zip(*(m.counts([p]) for p in pieces(texts[0]))))
                    names, score = m.predict(counts, total)
                else:
                    names, score = m.predict(*m.counts(texts))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.array(names, pa.string()), pa.array(score, pa.float64())], schema.names)

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)
