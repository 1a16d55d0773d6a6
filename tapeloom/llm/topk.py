"""Exact top-k by inner product with a vector-approximation file.

The file holds the vectors in blocks: each dimension is cut into equal cells (`CELLS`), a byte a value
tells the cell. From the cells alone every score has a lower and an upper bound: with q the query and
l the cells' lower ends, ``q . l + w * sum(min(q, 0)) <= score <= q . l + w * sum(max(q, 0))``, w being
the cells' width less one (per dimension).

1. All cells are scanned; the k-th largest lower bound of each query becomes its threshold.
2. The cells are scanned again; vectors whose upper bound reaches the threshold are read, in order of
   falling upper bound, until the k-th best score read is certain: it is above all bounds still to
   come. Only then the blocks' answers are merged.

Queries and vectors meet in blocks: each block of vectors goes to each block of queries once, so a
task holds one block of each. Equal vectors in a block are looked at once, and answer with the k + 1
smallest ids, so a vector that fills a third of all rows costs no more than another.

Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without
an id. Rows are told apart by id: rows with the query's id are its own; an id that occurs more than
once is answered once, with its best score, and asked once, with its smallest vector. Queries meet
vectors of their own length only. Ties go to the smaller id. Scores are exact 64-bit integers, of
components of any size that a long holds (a block stores them in 32 bits where these hold them all).
Where sums might leave 62 bits, blocks are read without bounds and summed in Python's integers; scores
beyond a long are cut at its ends, and tie there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import written

BLOCK = 4_096
QUERY_BLOCK = 1_024
CELLS = 64
# Components from here on have no cells.
WIDE = 2.0**60
# Blocks of vectors that a task compares with a block of queries.
DEAL = 8
FILE = "dim int, block long, ids binary, cells binary, low binary, width binary, exact binary"


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    made = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when((F.size(vector) > 0) & sound, made)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def approximate(vectors: DataFrame) -> DataFrame:
    """The file: blocks of ids, cells and exact vectors, from columns id and vector. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pa.compute.list_value_length(batch.column("vector")))
            for dim in np.unique(size).tolist():
                mine = batch.filter(pa.array(size == dim))
                for at in range(0, mine.num_rows, BLOCK):
                    part = mine.slice(at, BLOCK)
                    x, ids = _matrix(part.column("vector"), dim), part.column("id").to_numpy()
                    low, most = x.min(0), float(np.abs(x.astype(np.float64)).max())
                    if most < WIDE:
                        width = np.maximum(1, -(-(x.max(0) - low + 1) // CELLS))
                        cells = ((x - low) // width).astype(np.uint8)
                    else:
                        width, cells = np.zeros(dim, np.int64), np.zeros(x.shape, np.uint8)  # no cell holds it
                    exact = x.astype(np.int32) if most < 1 << 31 else x
                    row = [[dim], [int(ids[0])], [ids.tobytes()], [cells.tobytes()], [low.tobytes()], [width.tobytes()], [exact.tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), *[pa.binary()] * 5))], ["dim", "block", "ids", "cells", "low", "width", "exact"])

    return vectors.mapInArrow(run, FILE)


def _size(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a . b' of integers: in doubles where these hold every sum, else in longs, else cut at a long's ends."""
    most = _size(a) * _size(b) * a.shape[1]
    if most < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return np.einsum("ik,jk->ij", a, b)
    ends = np.iinfo(np.int64)
    sums = a.astype(object) @ b.astype(object).T
    return np.clip(sums, ends.min, ends.max).astype(np.int64)


def _bounds(row: dict, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of each query and vector the score of the cells' lower ends; of each query what to add for the bounds.

    None where these might leave 62 bits.
    """
    low, width = (np.frombuffer(row[c], np.int64) for c in ("low", "width"))
    most = max(_size(low), _size(low) + CELLS * _size(width)) * max(_size(q), 1.0) * len(low)
    if most >= 2.0**61 or not width.all():
        return None
    ends = low + width * np.frombuffer(row["cells"], np.uint8).reshape(-1, len(low)).astype(np.int64)
    return _dot(q, ends), np.minimum(q, 0) @ (width - 1), np.maximum(q, 0) @ (width - 1)


def _pairs(file: DataFrame, asked: DataFrame, columns: list[str]) -> DataFrame:
    """Each block of vectors with each block of queries of its length, dealt out evenly."""
    deals = max(1, file.count() // DEAL)
    parts = F.broadcast(asked.groupBy("dim").agg(F.max("parts").alias("parts")))  # a row for each length
    blocks = file.select("dim", *columns, F.pmod(F.xxhash64("block", "ids"), F.lit(deals)).alias("deal")).join(parts, "dim")
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return blocks.join(asked.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).drop("parts"), ["dim", "part", "deal"])


def _asked(queries: DataFrame, threshold: DataFrame | None = None) -> DataFrame:
    """Blocks of queries: ids, vectors, and thresholds if there are any."""
    rows = queries.join(threshold, "id", "left") if threshold is not None else queries.withColumn("least", F.lit(None).cast("long"))
    rows = rows.select("id", "vector", "least", F.size("vector").alias("dim"))
    count = F.broadcast(queries.groupBy(F.size("vector").alias("dim")).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts")))  # a row for each length
    rows = rows.join(count, "dim").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return rows.groupBy("dim", "part", "parts").agg(F.collect_list(F.struct("id", "vector", "least")).alias("asked"))


def _scan(pairs: DataFrame, k: int) -> DataFrame:
    """Per block the k largest lower bounds of each query: query_id, vec_id, low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.array([a["id"] for a in row["asked"]], np.int64)
                q = np.array([a["vector"] for a in row["asked"]], np.int64)
                ids = np.frombuffer(row["ids"], np.int64)
                bounds = _bounds(row, q)
                if bounds is None:
                    continue  # no bounds, so all of the block is read
                mid, below, _ = bounds
                mid[own[:, None] == ids] = np.iinfo(np.int64).min // 2
                first = _first_rows(ids)
                mid = mid[:, first]
                n = min(k, mid.shape[1])
                at = np.argpartition(-mid, n - 1, 1)[:, :n]
                best = np.take_along_axis(mid, at, 1)
                kept = best > np.iinfo(np.int64).min // 4
                low = (best + below[:, None])[kept]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, kept.sum(1))), pa.array(ids[first][at][kept]), pa.array(low)], ["query_id", "vec_id", "low"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, low long")


def _first_rows(ids: np.ndarray) -> np.ndarray:
    """One row of each id: repeated ids must not count twice for a threshold."""
    return np.unique(ids, return_index=True)[1]


def _read(pairs: DataFrame, k: int) -> DataFrame:
    """Per block the k best of each query: query_id, vec_id, score, and how many vectors were read for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = _read_block(row, k)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score", "n_read"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long, n_read long")


def _read_block(row: dict, k: int) -> tuple[list, list, list, list]:
    ids = np.frombuffer(row["ids"], np.int64)
    kind = np.int32 if len(row["exact"]) == 4 * row["dim"] * len(ids) else np.int64
    exact = np.frombuffer(row["exact"], kind).reshape(len(ids), -1).astype(np.int64)
    q = np.array([a["vector"] for a in row["asked"]], np.int64)
    bounds = _bounds(row, q)
    order = np.lexsort((ids, *exact.T))
    new = np.ones(len(ids), bool)
    new[1:] = (exact[order[1:]] != exact[order[:-1]]).any(1)
    start = np.append(np.flatnonzero(new), len(ids))  # equal vectors: order[start[g]:start[g + 1]], by id
    lead = order[start[:-1]]
    out: tuple[list, list, list, list] = ([], [], [], [])
    for i, a in enumerate(row["asked"]):
        upper = bounds[0][i, lead] + bounds[2][i] if bounds else np.full(len(lead), np.iinfo(np.int64).max)
        todo = np.flatnonzero(upper >= a["least"]) if a["least"] is not None else np.arange(len(lead))
        todo = todo[np.argsort(-upper[todo], kind="stable")]
        found, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4 * k
        while at < len(todo):
            if len(found) >= k and scores[k - 1] > upper[todo[at]]:
                break  # no vector still to come can reach the k-th score
            some = todo[at : at + step]
            got = _dot(q[i : i + 1], exact[lead[some]])[0]
            members = [order[start[g] : start[g + 1]] for g in some]
            new_ids = [_smallest(ids[m], a["id"], k) for m in members]
            found = np.concatenate([found, *new_ids])
            scores = np.concatenate([scores, np.repeat(got, [len(x) for x in new_ids])])
            best = np.lexsort((found, -scores))
            first = np.sort(np.unique(found[best], return_index=True)[1])[:k]  # each id once, with its best score
            found, scores = found[best][first], scores[best][first]
            at, step = at + step, step * 2
        if len(found):
            for to, x in zip(out, (np.full(len(found), a["id"]), found, scores, np.full(len(found), min(at, len(todo))))):
                to.append(x)
    return out


def _smallest(ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """The k smallest different ids of a sorted list, without ``own``."""
    if len(ids) == 1:
        return ids if ids[0] != own else ids[:0]
    kept = np.unique(ids)
    return kept[kept != own][:k]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """For each query row its k best rows of ``vectors``: query_id, rank, vec_id, score, n_read.

    n_read: exact vectors that the row's block read for the query.
    """

    def made(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_column).cast("long").alias("id"), integers(F.col(vector), scale).alias("vector")).where("id is not null and vector is not null")

    file = written(approximate(made(vectors)), "approximation")
    asked = written(made(queries).groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    bounds = _scan(_pairs(file, _asked(asked), ["ids", "cells", "low", "width"]), k).groupBy("query_id", "vec_id").agg(F.max("low").alias("low"))
    # Only the k best of each block come here, so a query's rows are blocks times k.
    nth = Window.partitionBy("query_id").orderBy(F.desc("low"))
    threshold = bounds.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") == k).select(F.col("query_id").alias("id"), F.col("low").alias("least"))
    found = _read(_pairs(file, _asked(asked, threshold), ["ids", "cells", "low", "width", "exact"]), k)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("n_read").alias("n_read"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "n_read")
