import hashlib
import random
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import jaccard
from tapeloom.llm.queries import QUERIES


def brute(rows, size, num, den):
    """(doc_id, n_shingles, component_id, n_links) of each row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * den >= num * max(len(a), len(b)):
                common = len(a & b)
                if den * common >= num * (len(a) + len(b) - common):
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i)), n) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links))), key=str)


def found(spark, rows, size, num, den, **limits):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.components(cases.clashing(df), size, num, den, **limits)
    return sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str)


def families(seed, groups, copies, words, edits):
    """Near copies of a few texts, each with some words replaced, some of them chained."""
    r, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(*words))]
        for c in range(copies):
            text = list(base)
            for _ in range(r.randint(0, edits)):
                text[r.randrange(len(text))] = f"new{r.randint(0, 10**6)}"
            out.append((len(out) + 1, " ".join(text)))
            if c % 5 == 0:
                base = text
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_like_brute_force(spark, size, num, den):
    rows = families(1, 8, 25, (30, 90), 4) + [(1000 + i, f"short {i % 4}") for i in range(12)] + families(2, 3, 10, (2, 12), 2)
    rows += [(None, rows[0][1]), (None, None), (7, ""), (8, " \n"), (9, rows[3][1]), (9, rows[3][1]), (3000, "One TWO"), (3001, "one two"), (3002, "one\u00a0two")]
    assert found(spark, rows, size, num, den) == brute(rows, size, num, den)


def test_regions_that_are_parted_over_the_cluster(spark):
    rows = families(3, 2, 60, (60, 60), 5) + families(4, 4, 10, (40, 60), 3)
    want = brute(rows, 3, 80, 100)
    assert found(spark, rows, 3, 80, 100) == want
    assert found(spark, rows, 3, 80, 100, task_sets=12) == want
    assert found(spark, rows, 3, 80, 100, task_shingles=900) == want


def test_region_join_recurses_exactly():
    r = np.random.default_rng(5)
    centres = [r.choice(5000, 60, replace=False) for _ in range(12)]
    sets = []
    for i in range(400):
        some = set(centres[i % 12].tolist())
        for _ in range(int(r.integers(0, 9))):
            some.discard(int(r.choice(list(some))))
            some.add(int(r.integers(5000, 10**6)))
        sets.append(np.array(sorted(some), np.uint64))
    root, links = jaccard.join_region(sets, np.ones(400, bool), True, np.ones(400, np.int64), 80, 100, leaf=16)
    whole = [set(s.tolist()) for s in sets]
    linked = np.array([[100 * len(a & b) >= 80 * len(a | b) for b in whole] for a in whole]) & ~np.eye(400, dtype=bool)
    assert links.tolist() == linked.sum(1).tolist()
    reach = np.linalg.matrix_power((linked | np.eye(400, dtype=bool)).astype(float), 1)
    for _ in range(9):
        reach = (reach @ reach > 0).astype(float)
    assert ((root[:, None] == root[None, :]) == (reach > 0)).all()


def test_linked_sets_agree_in_a_class():
    r = np.random.default_rng(6)
    for num in (80, 90):
        classes = jaccard.Classes(num, 100)
        for _ in range(400):
            n = int(r.integers(5, 400))
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            drop = int(r.integers(0, max(1, n * (100 - num) // 100 + 1)))
            b = np.unique(np.concatenate((a[drop // 2 :], r.integers(0, 2**63, drop - drop // 2).astype(np.uint64))))
            common = len(np.intersect1d(a, b))
            if 100 * common >= num * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                assert np.intersect1d(classes.signatures(a), classes.signatures(b)).size


def test_odd_rows(spark):
    assert jaccard.components(cases.empty(spark)).count() == 0
    assert jaccard.components(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2
    rows = [(i, t) for i, t, *_ in cases.rows()]
    assert found(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_deduplicated_keeps_one_of_each(spark):
    df = cases.clashing(cases.documents(spark))
    got = jaccard.deduplicated(df)
    assert got.columns == df.columns
    ids = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert [i for i, t in ids if t and "x" * 50 not in t and i not in (6, 7, 11, 12, 14)].count(1) == 1
    assert {i for i, _ in ids} >= {3, 4, 5, 6, 7, 10, 11, 12, 14, None} and not {2, 13} & {i for i, _ in ids}
    assert (8 in {i for i, _ in ids}) and (9 not in {i for i, _ in ids})
    assert jaccard.deduplicated(cases.empty(spark)).count() == 0


def test_query(spark, sf):
    rows = [(d, t) for d, t, *_ in cases.table(sf, "documents")]
    got = sorted((tuple(r) for r in QUERIES["op3_jaccard_join"](spark, sf).collect()), key=str)
    assert got == brute(rows, 3, 90, 100)


def test_groups_of_agreeing_sets():
    signature = np.array([5, 5, 5, 5, 9, 9, 7, 7, 7], np.uint64)
    node = np.array([4, 3, 2, 2, 8, 8, 6, 1, 5], np.int64)
    sig, own, a, b = jaccard._grouped(signature, node, most=9)
    assert list(zip(sig.tolist(), own.tolist())) == [(5, 2), (5, 3), (5, 4), (7, 1), (7, 5), (7, 6), (9, 8)] and not len(a)
    sig, own, a, b = jaccard._grouped(signature, node, most=2)  # larger groups are hung on their smallest node
    assert list(zip(sig.tolist(), own.tolist())) == [(5, 2), (7, 1), (9, 8)]
    assert sorted(zip(a.tolist(), b.tolist())) == [(3, 2), (4, 2), (5, 1), (6, 1)]


def test_sketches_never_rule_out_a_link():
    r = np.random.default_rng(7)
    for _ in range(200):
        n = int(r.integers(5, 3000))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        drop = int(r.integers(0, max(1, n // 4)))
        b = np.unique(np.concatenate((a[drop // 2 :], r.integers(0, 2**63, drop - drop // 2).astype(np.uint64))))
        differ = len(np.setxor1d(a, b))
        x, y = jaccard.histograms([jaccard.sketch(a), jaccard.sketch(b)])
        assert np.abs(x - y).sum() <= differ
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            assert np.abs(x - y).sum() * 180 <= (len(a) + len(b)) * 20


def test_connected(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = dict(map(tuple, jaccard.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in root if find(x) != x}
    assert jaccard.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_of_equal_texts_are_dealt_evenly():
    text = cases.prose(1, 60)
    texts = [text] * 300 + [""] * 300
    keys = [hashlib.md5(f"{i // 3} {t}".encode()).hexdigest() for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "key": keys, "text": texts})
    rows = [r for b in jaccard._describe(3, jaccard.Classes(90, 100), 8)(iter([batch])) for r in b.to_pylist() if r["kind"] == jaccard.DOCUMENT]
    assert [(r["a"], r["key"]) for r in rows] == list(zip(range(600), keys)) and len({r["b"] for r in rows}) == 2
    for some in (rows[:300], rows[300:]):
        assert max(Counter(r["deal"] for r in some).values()) < 100
    assert [r["body"] is not None for r in rows] == [True] + [False] * 599
