"""N-gram Jaccard join in the metric space of word-shingle sets, exact.

Two documents link when ``den * |A and B| >= num * |A or B|`` for their sets of word shingles. With
t = 1 - num / den that is a Jaccard distance of at most t, and Jaccard distance is a metric.

Unrelated texts are nearly all at distance 1 of each other and of every pivot, where the triangle
inequality tells nothing. So the space is cut in two ways:

1. First regions. Linked sets differ in at most D shingles, D following from their sizes. The shingles
   are dealt by hash into D + 1 + slack classes, so linked sets agree exactly in one class that is not
   empty (`Classes`). Two sets that agree in a class may still be far apart; the difference of their
   histograms over hash buckets (`sketch`) is at most the number of shingles they differ in, so it
   tells most such pairs apart for certain. Sets that agree and may link are put into one region, a
   component of such agreements. Sets that agree with no other have no link.
2. Within a region pivots create Voronoi regions: each set belongs to its nearest pivot, and is
   replicated to every pivot that is at most 2t farther (and at most t beyond the farthest set that
   belongs there), as the triangle inequality puts all its links into those. The regions are joined
   recursively until they are small, or pivots no longer part them; those are compared as a whole by
   counting common shingles.

A region that fits one task is joined there (`join_region`). A larger one is parted by the same rule
over the cluster, round by round, pivots being picked by hash (`_assigned`); a region that its pivots
don't part is dealt out as pairs of blocks (`_dealt`).

Equal sets are one node, however many documents have it. Shingles and sets are told apart by 64-bit
hashes. Documents without words link with nothing, texts with fewer words than a shingle are one
shingle. Rows are kept one to one: repeated ids and null ids are rows like others; the component's id
is the smallest id that is not null, null if there is none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import byte_texts, slices, unused, written

STEP = 1 << 20
#: Sets, and shingles in them, that one task joins at a time.
TASK_SETS, TASK_SHINGLES = 4_096, 4_000_000
LEAF = 192
PIVOTS = 8
ROUNDS = 4
HELD = 1_000_000
#: Agreeing sets that are looked at pair by pair; a larger group is one region without a look.
GROUP_SETS, LOCAL_SETS = 2_048, 256
#: Fewest hash buckets of a sketch; larger sets have a quarter to a half of their size.
BUCKETS = 128


# -- sets --------------------------------------------------------------------------------------


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Words()
ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, size: int) -> np.ndarray:
    """The set of a text as sorted hashes."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        total = total * ODD[k % 5] + _mixed(words[k : k + len(total)] + np.uint64(k))
    return np.unique(_mixed(total))


def node_of(members: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes()))))


def sketch(members: np.ndarray) -> bytes:
    """Shingles in each hash bucket, 255 at most; the buckets are a power of two that follows the size."""
    buckets = max(BUCKETS, 1 << (len(members) // 4).bit_length())
    return np.minimum(np.bincount((members >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets), 255).astype(np.uint8).tobytes()


def histograms(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows, larger ones folded to the buckets of the smallest."""
    buckets = min(map(len, sketches))
    return np.stack([np.frombuffer(x, np.uint8).astype(np.int32).reshape(-1, buckets).sum(0) for x in sketches])


@dataclass(frozen=True)
class Classes:
    """How sets of each size are dealt into classes.

    Band k holds the sizes from starts[k] up to the next start. A pair counts for the band of its
    smaller set; ``differ(k)`` bounds the shingles in which such a pair differs. With
    differ + 1 + slack classes some class that both agree in is not empty, unless a set has more than
    ``slack`` empty classes; sets with so many give their empty classes too.
    """

    num: int
    den: int

    @functools.cached_property
    def starts(self) -> list[int]:
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, out[-1] * self.den // self.num))
        return out

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def differ(self, band: int) -> int:
        small = self.starts[band + 1] - 1
        return (small + small * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    @functools.cache
    def bounds(self, band: int) -> tuple[np.ndarray, np.ndarray, int]:
        slack = 1 + self.differ(band) // 16
        classes = self.differ(band) + 1 + slack
        cuts = np.array([(i << 64) // classes for i in range(1, classes)], np.uint64)
        return cuts, _mixed(np.arange(classes, dtype=np.uint64) + np.uint64(band << 32)), slack

    def signatures(self, members: np.ndarray) -> np.ndarray:
        """A hash of each class's content, for the set's band and those of its smaller partners."""
        size = len(members)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(members + np.uint64(1)), dtype=np.uint64)))
        out = []
        for band in range(self.band(-(-size * self.num // self.den)), self.band(size) + 1):
            if not self.differ(band):
                continue  # only equal sets link here
            cuts, salt, slack = self.bounds(band)
            ends = np.concatenate(([0], np.searchsorted(members, cuts), [size]))
            content = _mixed((sums[ends[1:]] - sums[ends[:-1]]) ^ salt)
            filled = ends[1:] > ends[:-1]
            out.append(content[filled] if len(filled) - filled.sum() <= slack else content)
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


# -- first regions -----------------------------------------------------------------------------

PARTS = "kind int, deal int, a long, b long, n long, key string, body binary"
DOCUMENT, AGREEMENTS, EDGE, GROUP = 0, 1, 2, 3


def _batch(kind: int, deal: list, a=None, b=None, n=None, key=None, body=None) -> pa.RecordBatch:
    rows = len(deal)
    fill = lambda x, t: pa.nulls(rows, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * rows, pa.int32()), pa.array(deal, pa.int32()), fill(a, pa.int64()), fill(b, pa.int64()), fill(n, pa.int64()), fill(key, pa.string()), fill(body, pa.binary())],
        ["kind", "deal", "a", "b", "n", "key", "body"],
    )


def _grouped(signature: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (signature, node) in order; of signatures with over ``most`` nodes the smallest only.

    Also the edges from the other nodes of those signatures to the smallest.
    """
    order = np.lexsort((node, signature))
    signature, node = signature[order], node[order]
    new = np.ones(len(node), bool)
    new[1:] = (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])
    signature, node = signature[new], node[new]
    first = np.ones(len(node), bool)
    first[1:] = signature[1:] != signature[:-1]
    group = np.cumsum(first) - 1
    over = (np.bincount(group) > most)[group]
    far = over & ~first
    edges = np.unique(np.stack((node[far], node[first][group[far]]), 1), axis=0)
    return signature[~far], node[~far], edges[:, 0], edges[:, 1]


def _describe(size: int, classes: Classes, deals: int):
    """Rows of documents, and what their signatures are, dealt out by signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # nodes whose signatures this task has given already
        signature: list[np.ndarray] = []
        node: list[np.ndarray] = []
        held = passed = 0

        def out() -> Iterator[pa.RecordBatch]:
            sig, own, a, b = _grouped(np.concatenate(signature), np.concatenate(node), LOCAL_SETS)
            to = ((sig >> np.uint64(32)) * np.uint64(deals) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(to, np.arange(deals + 1))
            full = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            yield _batch(AGREEMENTS, full, body=[sig[cuts[i] : cuts[i + 1]].tobytes() + own[cuts[i] : cuts[i + 1]].tobytes() for i in full])
            if len(a):
                yield _batch(EDGE, [i % deals for i in range(len(a))], a, b)

        for batch in batches:
            for part in slices(batch, "text", STEP):
                nodes, sizes, sketches = [], [], []
                for text in byte_texts(part.column("text")):
                    members = shingles(text, size)
                    sizes.append(len(members))
                    nodes.append(node_of(members) if len(members) else None)
                    sketches.append(None if nodes[-1] is None or nodes[-1] in done else sketch(members))  # once a task
                    if nodes[-1] is not None and nodes[-1] not in done:
                        if len(done) > HELD:
                            done.clear()
                        done.add(nodes[-1])
                        if len(made := classes.signatures(members)):
                            signature.append(made)
                            node.append(np.full(len(made), nodes[-1], np.int64))
                            held += len(made)
                keys = part.column("key").to_pylist()
                deal = [(int(k[:8], 16) + passed + i) % deals for i, k in enumerate(keys)]  # copies, also of whole rows, go to different parts
                passed += len(keys)
                yield _batch(DOCUMENT, deal, part.column("doc_id").to_pylist(), nodes, sizes, keys, sketches)
                if held > HELD:
                    yield from out()
                    signature, node, held = [], [], 0
        if held:
            yield from out()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one part of the signatures those that several nodes have; other rows pass."""
    signature, node = [], []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (other := kind != AGREEMENTS).any():
            yield batch.filter(pa.array(other))
        for body in batch.filter(pa.array(~other)).column("body").to_pylist():
            half = len(body) // 2
            signature.append(np.frombuffer(body[:half], np.uint64))
            node.append(np.frombuffer(body[half:], np.int64))
    if signature:
        sig, own, a, b = _grouped(np.concatenate(signature), np.concatenate(node), GROUP_SETS)
        for at in range(0, len(a), 100_000):
            yield _batch(EDGE, [0] * len(a[at : at + 100_000]), a[at : at + 100_000], b[at : at + 100_000])
        same = sig[1:] == sig[:-1]
        shared = np.zeros(len(sig), bool)
        shared[1:] |= same
        shared[:-1] |= same
        sig, own = sig[shared].view(np.int64), own[shared]
        for at in range(0, len(sig), 100_000):
            yield _batch(GROUP, [0] * len(sig[at : at + 100_000]), sig[at : at + 100_000], own[at : at + 100_000])


def _alike(num: int, den: int):
    """Edges of sets that share a signature and whose sketches don't rule out a link; rows come by signature."""

    def may_link(n: np.ndarray, hist: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.abs(hist - other).sum(-1) * (den + num) <= (n + m) * (den - num)

    def edges(sig: np.ndarray, node: np.ndarray, n: np.ndarray, sketches: list[bytes]) -> np.ndarray:
        start = np.append(np.flatnonzero(np.append(True, sig[1:] != sig[:-1])), len(sig)).tolist()
        out = [np.zeros((0, 2), np.int64)]
        for at, stop in zip(start, start[1:]):
            hist, size, todo = histograms(sketches[at:stop]), n[at:stop], np.arange(stop - at)
            while len(todo) > 1:  # a component of sets that may link, from its first set on
                front, todo, component = todo[:1], todo[1:], [int(todo[0])]
                while len(front) and len(todo):
                    near = np.zeros(len(todo), bool)
                    for i in front:
                        near |= may_link(size[i], hist[i], size[todo], hist[todo])
                    front, todo = todo[near], todo[~near]
                    component += front.tolist()
                if len(component) > 1:
                    members = node[at:stop][component]
                    out.append(np.stack((members[1:], np.full(len(members) - 1, members[0])), 1))
        return np.unique(np.concatenate(out), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches_with_end(batches):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                if held.nbytes < 4 * STEP:
                    continue
            if held is None or not held.num_rows:
                continue
            sig = held.column("sig").to_numpy()
            stop = int(np.searchsorted(sig, sig[-1])) if batch is not None else len(sig)  # the last signature may go on
            if stop:
                part = held.slice(0, stop)
                found = edges(part.column("sig").to_numpy(), part.column("node").to_numpy(), part.column("n").to_numpy(), part.column("sketch").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
                held = held.slice(stop).combine_chunks()

    return run


def batches_with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b); the root is the smallest node of the component.

    Alternating stars: every node's larger neighbours are hung on its smallest one, then its smaller
    neighbours, until nothing changes.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        of = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if of == state or not of[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = of
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(hung.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")


# -- regions -----------------------------------------------------------------------------------


class Region:
    """Sets that are compared with each other, as one numbered array of shingles."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.t = num, den, 1 - num / den + 1e-9
        self.size = np.array([len(s) for s in sets])
        self.start = np.cumsum(self.size) - self.size
        self.kinds, self.number = np.unique(np.concatenate(sets), return_inverse=True)
        self.root = np.arange(len(sets))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def members(self, i: int) -> np.ndarray:
        return self.number[self.start[i] : self.start[i] + self.size[i]]

    def distance(self, pivot: int, some: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(self.kinds) + 1, np.int64)
        mark[self.members(pivot)] = 1
        held = np.concatenate(([0], np.cumsum(mark[self.number])))
        common = held[self.start[some] + self.size[some]] - held[self.start[some]]
        return 1 - common / (self.size[some] + self.size[pivot] - common)

    def linked(self, home: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Which of ``home`` links with which of ``others``; equal rows do."""
        union = np.union1d(home, others)
        rows = np.repeat(np.arange(len(union)), self.size[union])
        numbers = np.concatenate([self.members(i) for i in union])
        kinds, column, n = np.unique(numbers, return_inverse=True, return_counts=True)
        shared = np.cumsum(n > 1) - 1
        kept = n[column] > 1
        rows, column = rows[kept], shared[column[kept]]
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        common = np.zeros((len(home), len(others)), np.float32)
        a, b = np.searchsorted(union, home), np.searchsorted(union, others)
        width = 1_024
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            low, high = np.searchsorted(column, (at, at + width))
            grid = np.zeros((len(union), width), np.float32)
            grid[rows[low:high], column[low:high] - at] = 1
            common += grid[a] @ grid[b].T
        out = np.zeros(common.shape, bool)
        for i in range(len(home)):
            shared = common[i].astype(np.int64)
            out[i] = self.den * shared >= self.num * (self.size[home[i]] + self.size[others] - shared)
        return out


def join_region(sets: list[np.ndarray], home: np.ndarray, inner: bool, weight: np.ndarray, num: int, den: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Join the sets that are at home with each other (if ``inner``) and with the guests.

    Returns for each set the first set it is connected with, and for those at home the documents that
    they link with (``weight``: documents of a set).
    """
    region, links = Region(sets, num, den), np.zeros(len(sets), np.int64)
    todo = [(np.flatnonzero(home), np.flatnonzero(~home), 0)]
    while todo:
        at_home, guests, depth = todo.pop()
        others = np.concatenate((at_home, guests)) if inner else guests
        if not len(at_home) or not len(others):
            continue
        if len(at_home) + len(guests) > leaf and depth < 12:
            parts = _voronoi(region, at_home, guests, inner)
            if sum(len(h) * (len(h) * inner + len(g)) for h, g in parts) < 0.7 * len(at_home) * len(others):
                todo += [(h, g, depth + 1) for h, g in parts]
                continue
        linked = region.linked(at_home, others)
        linked &= at_home[:, None] != others[None, :]
        links[at_home] += linked @ weight[others]
        for i in np.flatnonzero(linked.any(1)):
            a = region.find(at_home[i])
            for j in np.unique(region.root[others[linked[i]]]):
                b = region.find(j)
                if a != b:
                    region.root[max(a, b)] = min(a, b)
                    a = min(a, b)
    return np.array([region.find(i) for i in range(len(sets))]), links


def _voronoi(region: Region, home: np.ndarray, guests: np.ndarray, inner: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Part the sets at home by their nearest pivot; with each part go the sets that may link into it."""
    every = np.concatenate((home, guests))
    pivots, far = [], np.full(len(home), np.inf)
    distances = []
    for _ in range(PIVOTS):  # each next pivot is the set farthest from those before
        pivot = int(far.argmax())
        if pivots and far[pivot] <= 0:
            break
        pivots.append(pivot)
        distances.append(region.distance(int(home[pivot]), every))
        far = np.minimum(far, distances[-1][: len(home)])
    d = np.stack(distances, 1)
    nearest = d[: len(home)].argmin(1)
    window = d.min(1) + 2 * region.t
    out = []
    for p in range(len(pivots)):
        mine = nearest == p
        if mine.any():
            reach = d[: len(home), p][mine].max() + region.t
            near = (d[:, p] <= window) & (d[:, p] <= reach)
            near[: len(home)] &= ~mine & inner
            out.append((home[mine], every[near]))
    return out


MEMBERS = "region long, node long, n long, weight long, members binary, home boolean, inner boolean"


def _joined(num: int, den: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["home", "node"], ascending=[False, True]).drop_duplicates("node")
        node = group["node"].to_numpy()
        if len(node) < 2:
            return pd.DataFrame({"node": node, "root": node, "links": np.zeros(len(node), np.int64)})
        sets = [np.frombuffer(x, np.uint64) for x in group["members"]]
        root, links = join_region(sets, group["home"].to_numpy(bool), bool(group["inner"].iloc[0]), group["weight"].to_numpy(np.int64), num, den)
        return pd.DataFrame({"node": node, "root": node[root], "links": links})

    return run


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("region").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))


def _assigned(rows: DataFrame, num: int, den: int, turn: int) -> DataFrame:
    """One round of Voronoi regions over the cluster: (parent, node, region, home), a row for each region a set goes to."""
    slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2 * PIVOTS))
    picked = rows.where("home").groupBy("region", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("node", F.lit(-turn)).alias("by"), "node", "members")).alias("p"))
    pivots = picked.groupBy("region").agg(F.collect_list("p.members").alias("pivots"))  # 2 * PIVOTS at most
    t = 1 - num / den + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = np.frombuffer(row["members"], np.uint64)
                d = []
                for p in row["pivots"]:
                    other = np.frombuffer(p, np.uint64)
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    d.append(1 - common / (len(own) + len(other) - common))
                least = min(range(len(d)), key=d.__getitem__)
                for k, x in enumerate(d):
                    if x <= d[least] + 2 * t:
                        region = int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(f"{row['region']}/{turn}/{k}"))))
                        out.append({"parent": row["region"], "node": row["node"], "n": row["n"], "region": region, "home": row["home"] and k == least})
            yield pa.RecordBatch.from_pylist(out, ASSIGNED)

    return rows.join(pivots, "region").select("region", "node", "n", "members", "home", "pivots").mapInArrow(run, "parent long, node long, n long, region long, home boolean")


ASSIGNED = pa.schema([("parent", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("region", pa.int64()), ("home", pa.bool_())])
SCHEMA = pa.schema([("region", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("weight", pa.int64()), ("members", pa.binary()), ("home", pa.bool_()), ("inner", pa.bool_())])


def _dealt(rows: DataFrame, sizes: DataFrame, sets: int, shingles_: int) -> DataFrame:
    """Pairs of blocks of the regions that pivots don't part: a set is at home with each block, and each block's guest."""
    blocks = sizes.select("region", F.greatest(F.ceil(2 * F.col("sets") / sets), F.ceil(2 * F.col("shingles") / shingles_)).cast("int").alias("blocks"))
    rows = rows.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    task = lambda a, b: F.xxhash64("region", a, b)
    as_home = rows.where("home").withColumn("with", others).withColumns({"inner": F.col("with") == F.col("block"), "region": task("block", "with")})
    as_guest = rows.withColumn("with", others).where(~F.col("home") | (F.col("with") != F.col("block"))).withColumns({"inner": F.col("with") == F.col("block"), "home": F.lit(False), "region": task("with", "block")})
    columns = ["region", "node", "n", "weight", "members", "home", "inner"]
    return as_home.select(*columns).union(as_guest.select(*columns))


def _join_regions(rows: DataFrame, num: int, den: int, sets: int, shingles_: int) -> tuple[DataFrame, bool]:
    """(node, root, links) of all regions, and whether some were parted over the cluster."""
    rows = written(rows, "regions")
    large = (F.col("sets") > sets) | (F.col("shingles") > shingles_)
    sizes = written(_sizes(rows), "sizes")
    over = sizes.where(large)
    done = [rows.join(over, "region", "left_anti")]
    parted = not over.isEmpty()
    for turn in range(1, ROUNDS + 1):
        if over.isEmpty():
            break
        rows = rows.join(over.select("region"), "region", "left_semi")
        to = written(_assigned(rows, num, den, turn), "assigned")
        inside = _sizes(to)
        work = to.select("region", "parent").distinct().join(inside, "region").groupBy("parent").agg(F.sum(F.col("sets") * F.col("sets")).alias("work"))
        # a round pays if the pairs left inside the new regions are clearly fewer than before
        parts = over.join(work.withColumnRenamed("parent", "region"), "region").withColumn("pays", (F.col("work") < 0.5 * F.col("sets") * F.col("sets")) & F.lit(turn < ROUNDS))
        parts = written(parts, "sizes")
        stuck = parts.where(~F.col("pays")).select("region", "sets", "shingles")
        done.append(_dealt(rows.join(stuck.select("region"), "region", "left_semi"), stuck, sets, shingles_))
        moved = to.join(parts.where("pays").select(F.col("region").alias("parent")), "parent", "left_semi").drop("n")
        held = rows.select(F.col("region").alias("parent"), "node", "n", "weight", "members", "inner")
        rows = written(moved.join(held, ["parent", "node"]).drop("parent"), "regions")
        over = written(_sizes(rows).where(large), "sizes")
        done.append(rows.join(over, "region", "left_anti"))
    columns = ["region", "node", "n", "weight", "members", "home", "inner"]
    every = functools.reduce(DataFrame.union, [d.select(*columns) for d in done])
    return every.groupBy("region").applyInPandas(_joined(num, den), "node long, root long, links long"), parted


# -- the join ----------------------------------------------------------------------------------


def key_of(doc_id: str, text: str):
    """Names a row by its id and text."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(" "), F.coalesce(F.col(text), F.lit(""))))


def components(
    docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text", task_sets: int = TASK_SETS, task_shingles: int = TASK_SHINGLES
) -> DataFrame:
    """A row for each document: doc_id, key (see `key_of`), n_shingles, component_id, n_links, root.

    n_links: other documents whose sets are alike enough, copies included; 0 for empty sets.
    root: names the component, null for empty sets.
    """
    spark = docs.sparkSession
    deals = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key_of(doc_id, text).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(_describe(size, Classes(num, den), deals), PARTS)
    parts = written(found.repartition(deals // 4, "deal").mapInArrow(_meet, PARTS).drop("deal"), "agreements")
    listed = parts.where(F.col("kind") == DOCUMENT).select(F.col("a").alias("doc_id"), "key", F.col("b").alias("node"), F.col("n").alias("n_shingles"))
    described = parts.where((F.col("kind") == DOCUMENT) & F.col("b").isNotNull()).withColumnRenamed("b", "node")
    kinds = described.groupBy("node").agg(F.min("a").alias("first"), F.count("*").alias("weight"), F.max("n").alias("n"), F.min("key").alias("key"), F.min("body").alias("sketch"))
    kinds = written(kinds, "sets")
    groups = parts.where(F.col("kind") == GROUP).select(F.col("a").alias("sig"), F.col("b").alias("node")).join(kinds.select("node", "n", "sketch"), "node")
    alike = groups.repartition(deals // 4, "sig").sortWithinPartitions("sig", "node").select("sig", "node", "n", "sketch").mapInArrow(_alike(num, den), "a long, b long")
    regions = connected(parts.where(F.col("kind") == EDGE).select("a", "b").union(alike))
    regions = regions.union(regions.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "region")
    wanted = kinds.join(regions, "node").select("key", "node", "n", "weight", "region")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            node = batch.column("node").to_pylist()
            fresh = [n not in done and not done.add(n) for n in node]  # repeated rows give their set once
            for part in slices(batch.filter(pa.array(fresh, pa.bool_())), "text", STEP):
                made = pa.array([shingles(t, size).tobytes() for t in byte_texts(part.column("text"))], pa.binary())
                yes = pa.array([True] * part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("region", "node", "n", "weight")), made, yes, yes], SCHEMA.names)

    members = rows.select("key", "text").join(wanted.hint("shuffle_hash"), "key")
    joined, parted = _join_regions(members.select("region", "node", "n", "weight", "text").mapInArrow(sets, MEMBERS), num, den, task_sets, task_shingles)
    joined = written(joined, "links")
    links = joined.groupBy("node").agg(F.max("links").alias("most"), F.sum("links").alias("links"))
    roots = connected(joined.select(F.col("node").alias("a"), F.col("root").alias("b"))) if parted else joined.where("node <> root").select("node", "root")
    rooted = kinds.join(roots, "node", "left").join(links.select("node", "links"), "node", "left").select("node", "first", "weight", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    whole = rooted.join(least, "root").select("node", "root", "component_id", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    out = listed.join(whole, "node", "left")
    return out.select("doc_id", "key", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "root")


def deduplicated(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that are alike another: of each component the smallest id stays.

    Rows without words all stay. Of rows with the same id and text one stays.
    """
    found = components(docs, size, num, den, doc_id, text)
    alike = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("x")).select("x.key", F.lit(True).alias("_alike"))
    alone = found.where("root is null").select("key", F.lit(False).alias("_alike")).distinct()
    key, yes, once = (unused(docs, name) for name in ("key", "alike", "once"))
    kept = alike.union(alone).withColumnsRenamed({"key": key, "_alike": yes})
    rows = docs.withColumn(key, key_of(doc_id, text)).join(kept.hint("shuffle_hash"), key)
    rows = rows.withColumn(once, F.when(F.col(yes), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id()))
    return rows.dropDuplicates([key, once]).select(*docs.columns)


