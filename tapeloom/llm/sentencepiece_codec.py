"""SentencePiece encoding that keeps the way back to the source bytes, and decoding.

Normalisation replaces, from left to right, the longest prefix that the model's compiled character
map holds, and records for every normalised byte how many source bytes were consumed before it.
Pieces are found on the normalised text; their ends are projected through that record, so each piece
gets its span of bytes in the source.

No piece of a vocabulary may join a non-space to a following space mark, and characters that occur
in no longer piece never merge. Where the vocabulary obeys this (checked when it is loaded), the
normalised text is cut there, and merges, which are local to such parts, are looked up per part.
The merges themselves are those of the model's own BPE or unigram search.

Null texts count as empty and give no pieces.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import lists, slices

SPACE = "▁"
# Fixed values of the model format: the kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
# Parts whose pieces a task remembers.
CACHED_PARTS = 200_000
# Bytes of text handled at a time: a task holds a few dozen times as much.
STEP = 1 << 20


def character_map(blob: bytes) -> dict[str, str]:
    """The replacements of a compiled character map: the keys of its double array, and their texts."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob, "<u4", size // 4, 4)
    texts = blob[4 + size :]

    def child_base(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    found, labels = {}, np.arange(1, 256, dtype=np.int64)
    todo = [(b"", child_base(int(units[0])))]
    while todo:
        key, base = todo.pop()
        at = base ^ labels
        inside = at < len(units)
        got = units[at[inside]]
        for label, unit in zip(labels[inside][(got & 0x800000FF) == labels[inside]].tolist(), got[(got & 0x800000FF) == labels[inside]].tolist()):
            below, longer = (base ^ label) ^ child_base(unit), key + bytes([label])
            if unit & 0x100:
                start = int(units[below]) & 0x7FFFFFFF
                found[longer.decode()] = texts[start : texts.index(b"\0", start)].decode()
            todo.append((longer, below))
    return found


class Codec:
    """A loaded model: normalise, encode with spans, decode."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.unknown_text = proto.trainer_spec.unk_surface.encode()
        self.map = character_map(spec.precompiled_charsmap)
        self.longest = max(map(len, self.map), default=0)
        self.starts = re.compile("[" + "".join(map(re.escape, sorted({k[0] for k in self.map}))) + "]") if self.map else None
        self.kinds = [p.type for p in proto.pieces]
        self.is_byte = [k == BYTE for k in self.kinds]
        self.unknown = self.kinds.index(UNKNOWN)
        # Of each piece: its text when decoded, its width in normalised bytes; of a byte piece: its byte, else -1.
        self.surface, self.width, self.byte = [], np.zeros(len(self.kinds), np.int32), np.full(len(self.kinds), -1)
        for i, p in enumerate(proto.pieces):
            raw = p.piece.encode()
            self.width[i] = len(raw)
            if p.type == BYTE:
                self.byte[i] = int(p.piece[1:-1], 16)
                raw = bytes([self.byte[i]])
            elif p.type == CONTROL:
                raw = b""
            elif p.type == UNKNOWN:
                raw = self.unknown_text
            else:
                raw = raw.replace(SPACE.encode(), b" ")
            self.surface.append(raw)
        self.led = [p.type not in (BYTE, CONTROL, UNKNOWN) and p.piece.startswith(SPACE) for p in proto.pieces]
        # The merges work on text that is normalised already.
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
        proto.denormalizer_spec.Clear()
        self.merge = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.cuts = self._cuts([p.piece for p in proto.pieces if p.type not in (BYTE, CONTROL, UNKNOWN)], proto.trainer_spec.model_type)
        self.cache: dict[str, bytes] = {}

    def _cuts(self, pieces: list[str], model_type: int) -> re.Pattern | None:
        """Where normalised text may be cut without touching a merge; None: nowhere."""
        merged = set("".join(p for p in pieces if len(p) > 1)) | {SPACE}
        lone = [c for c in map(chr, range(1, 128)) if c not in merged and c != " "]
        if USER_DEFINED in self.kinds or model_type != 2 or any(SPACE in p.lstrip(SPACE) for p in pieces) or not lone:
            return None
        self.lone = set(lone)
        self.between = lone[0]
        alone = "".join(map(re.escape, lone))
        return re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+|[{alone}]")

    # -- normalisation -------------------------------------------------------------------------

    def _replaced(self, text: str) -> Iterator[tuple[str, str | None]]:
        """The text in order as (source, replacement); None: kept as it is."""
        at = 0
        while self.starts is not None and (m := self.starts.search(text, at)):
            i = m.start()
            n = next((n for n in range(min(self.longest, len(text) - i), 0, -1) if text[i : i + n] in self.map), 0)
            if not n:  # a first character without a match here
                yield text[at : i + 1], None
                at = i + 1
                continue
            if i > at:
                yield text[at:i], None
            yield text[i : i + n], self.map[text[i : i + n]]
            at = i + n
        if at < len(text):
            yield text[at:], None

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source bytes consumed before."""
        parts, origin = [], []
        mark, consumed, fresh = SPACE if self.escape else " ", 0, True
        width = len(mark.encode())

        def put(out: str, aligned: np.ndarray) -> None:
            """Replace the spaces of ``out``; aligned: source position of each byte."""
            raw = np.frombuffer(out.encode(), np.uint8)
            parts.append(out.replace(" ", mark))
            origin.append(np.repeat(aligned, np.where(raw == 32, width, 1)) if width > 1 else aligned)

        if self.prefix and not self.suffix and (text if not self.trim else self._visible(text)):
            first = self._leading(text) if self.trim else 0
            parts.append(mark)
            origin.append(np.full(width, first, np.int32))
        for source, out in self._replaced(text):
            size = len(source.encode())
            if out is None:
                raw = np.frombuffer(source.encode(), np.uint8)
                starts = (raw & 0xC0) != 0x80
                aligned = consumed + np.maximum.accumulate(np.where(starts, np.arange(size), 0)).astype(np.int32)
                kept = source
                if self.trim:
                    space = raw == 32
                    before = np.concatenate(([fresh], space[:-1]))
                    keep = ~(space & before)
                    aligned, kept = aligned[keep], raw[keep].tobytes().decode()
                    fresh = bool(space[-1])
            else:
                kept = out
                if self.trim:
                    kept = out.lstrip(" ") if fresh else out
                    fresh = kept.endswith(" ") if kept else fresh
                aligned = np.full(len(kept.encode()), consumed, np.int32)
            if kept:
                put(kept, aligned)
            consumed += size
        done, steps = "".join(parts), np.concatenate(origin) if origin else np.zeros(0, np.int32)
        if self.trim:
            while done.endswith(mark):
                consumed = int(steps[len(steps) - width])
                done, steps = done[:-1], steps[: len(steps) - width]
        if self.prefix and self.suffix and done:
            done, steps = done + mark, np.concatenate((steps, np.full(width, consumed, np.int32)))
        return done, np.concatenate((steps, [consumed])).astype(np.int32)

    def _leading(self, text: str) -> int:
        """Source bytes of the spaces before the first thing that is kept."""
        used = 0
        for source, out in self._replaced(text):
            body = source if out is None else out
            left = body.lstrip(" ")
            if left:
                return used + (len(body) - len(left) if out is None else 0)
            used += len(source.encode())
        return used

    def _visible(self, text: str) -> bool:
        return any((source if out is None else out).strip(" ") for source, out in self._replaced(text))

    # -- encoding and decoding -----------------------------------------------------------------

    def _learn(self, parts: list[str]) -> None:
        """Put the pieces of these parts in the cache."""
        cache = self.cache
        for part in self.lone.intersection(parts):
            cache[part] = np.array(self.merge.encode(part), np.int32).tobytes()
        longer = [p for p in parts if p not in self.lone]
        between = self.merge.encode(self.between)[0]
        for at in range(0, len(longer), 256):  # many in one text, with a character between that never merges
            some = longer[at : at + 256]
            ids = np.array(self.merge.encode(self.between.join(some)), np.int32)
            raw, stops = ids.tobytes(), (4 * np.flatnonzero(ids == between)).tolist()
            for part, start, stop in zip(some, [0, *(x + 4 for x in stops)], [*stops, len(raw)]):
                cache[part] = raw[start:stop]

    def _merged(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of the pieces of normalised texts."""
        if self.cuts is None:
            return [np.array(x, np.int32) for x in self.merge.encode(texts, num_threads=1)]
        parts, cache = list(map(self.cuts.findall, texts)), self.cache
        some = set().union(*parts)
        if len(some) > CACHED_PARTS:  # one very long text
            return [np.array(x, np.int32) for x in self.merge.encode(texts, num_threads=1)]
        missing = some.difference(cache)
        if len(cache) + len(missing) > CACHED_PARTS:
            cache.clear()
            missing = some
        self._learn(list(missing))
        return [np.frombuffer(b"".join([cache[p] for p in x]), np.int32) for x in parts]

    def _widths(self, done: str, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes of each piece. The last byte piece of a character has all of its bytes, those before none."""
        widths, byte = self.width[ids], self.byte[ids]
        if (lead := np.flatnonzero(byte >= 0)).size:
            widths[lead] = 0
            lead = lead[(byte[lead] & 0xC0) != 0x80]
            value = byte[lead]
            size = 1 + (value >= 0xC0) + (value >= 0xE0) + (value >= 0xF0)
            widths[lead + size - 1] = size
        if (ids == self.unknown).any():
            raw, at = done.encode(), 0
            for k in range(len(ids)):  # an unknown piece goes on to the next piece that is known
                if ids[k] == self.unknown:
                    following = self.surface[ids[k + 1]].replace(b" ", SPACE.encode()) if k + 1 < len(ids) else b""
                    widths[k] = (raw.index(following, at + 1) if following else len(raw)) - at
                at += int(widths[k])
        return widths

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: ids, and the begin and end of each piece's span in the bytes of the text."""
        done = list(map(self.normalise, texts))
        out = []
        for (text, origin), ids in zip(done, self._merged([text for text, _ in done])):
            widths = self._widths(text, ids)
            ends = np.cumsum(widths)
            out.append((ids, origin[ends - widths], origin[ends]))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the pieces; bytes that form no character become U+FFFD each."""
        if not len(ids):
            return ""
        surface = self.surface
        if not self.trim and self.kinds[ids[0]] == NORMAL:
            raw = b"".join([surface[i] for i in ids])
            if self.prefix and self.led[ids[0]]:
                raw = raw[1:]
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        out, run, at_start, dropped = [], b"", True, False
        for i in ids:
            if self.is_byte[i]:
                run += surface[i]
                continue
            if run:
                out.append(_characters(run))
                run = b""
            if dropped or any(out):
                at_start = False
            text, dropped = surface[i].decode(), False
            if at_start and (self.prefix or self.trim) and self.led[i]:
                text, dropped = text[1:], not self.trim
            out.append(text)
        return "".join(out) + _characters(run)


def _characters(run: bytes) -> str:
    out = []
    while run:
        try:
            out.append(run.decode())
            break
        except UnicodeDecodeError as e:
            out.append(run[: e.start].decode() + "�")
            run = run[e.start + 1 :]
    return "".join(out)


@functools.lru_cache(maxsize=4)
def codec(model: bytes) -> Codec:
    return Codec(model)


def model_bytes(path: str) -> bytes:
    """The model file, read where the job is planned; tasks get its bytes, at most a few MB."""
    with open(path, "rb") as f:
        return f.read()


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + list(fields))


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", begins: str = "begins", ends: str = "ends", decoded: str | None = None) -> DataFrame:
    """Add the pieces of ``text``: ids, and each one's span in the bytes of the text.

    decoded: name of a column for the text that the ids stand for, made in the same pass. Columns of
    ``df`` with the new names are replaced. Null and empty texts get empty lists.
    """
    number = T.ArrayType(T.IntegerType(), False)
    back = [T.StructField(decoded, T.StringType())] if decoded else []
    schema = _with(df.schema, T.StructField(ids, number), T.StructField(begins, number), T.StructField(ends, number), *back)
    kept = schema.names[: -3 - len(back)]
    # the text may be one of the columns that are replaced
    rows = df.withColumn("_source", F.col(text)).select(*kept, "_source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for part in slices(batch, "_source", STEP):
                done = c.encode([t or "" for t in part.column("_source").to_pylist()])
                made = [lists(x, pa.int32()) for x in zip(*done)]
                if decoded:
                    made.append(pa.array([c.decode(x.tolist()) for x, _, _ in done], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + made, schema.names)

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for; null ids give null. A column with the new name is replaced."""
    schema = _with(df.schema, T.StructField(text, T.StringType()))
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                done = [None if x is None else c.decode(x) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.array(done, pa.string())], kept + [text])

    return df.mapInArrow(run, schema)


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
