import math
import random

import cases

from tapeloom.llm import topk
from tapeloom.llm.queries import ORACLES, QUERIES


def brute(rows, queries, k):
    made = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in queries:
        if (mine := [w for j, w in made if j == i and w == [math.floor(256 * float(x)) for x in v or [] if x is not None and math.isfinite(x)]]) and v:
            asked[i] = min([asked[i], mine[0]]) if i in asked else mine[0]
    out = []
    for q, v in asked.items():
        best = {}
        for i, w in made:
            if i != q and len(w) == len(v):
                best[i] = max(best.get(i, -(10**18)), sum(a * b for a, b in zip(v, w)))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(ranked)]
    return sorted(out)


def found(spark, rows, queries, k=5):
    schema = "vec_id long, embedding array<float>, score string"
    frame = lambda x: spark.createDataFrame([(i, v, "mine") for i, v in x], schema)
    return sorted(tuple(r)[:4] for r in topk.search(frame(rows), frame(queries), k).collect())


def vectors(n, dim, seed):
    r = random.Random(seed)
    return [[r.randint(-64, 64) / 64 for _ in range(dim)] for _ in range(n)]


def test_like_brute_force_with_odd_rows(spark, monkeypatch):
    rows = list(enumerate(vectors(300, 6, 1)))
    rows += [(1000 + i, [0.5, 0.25, 0.0, 1.0, -1.0, 0.5]) for i in range(200)]  # one vector, many times
    rows += [(5, rows[9][1]), (5, rows[5][1]), (7, rows[7][1])]  # an id twice, a row twice
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (None, [0.1] * 6)]
    rows += [(3000 + i, v) for i, v in enumerate(vectors(3, 2, 3))]  # another length, fewer rows than k
    queries = [(i, v) for i, v in rows if i is not None and i % 10 == 0]
    assert found(spark, rows, queries) == brute(rows, queries, 5)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "DEAL", 3)
    assert found(spark, rows, queries, 3) == brute(rows, queries, 3)


def test_large_components_and_empty_tables(spark):
    rows = [(i, [float(2**20 + i), float(-(2**20)), float(i)]) for i in range(50)]
    assert found(spark, rows, rows[::10]) == brute(rows, rows[::10], 5)
    assert found(spark, [], []) == [] and found(spark, rows, []) == []


def test_components_beyond_32_bits(spark):
    """floor(256 * x) past 2 ** 31, and sums past 2 ** 62, where there are no bounds."""
    rows = [(0, [1e7, 0.0]), (1, [9e6, 0.0]), (2, [1.1e7, 0.0]), (3, [-1e7, 5.0]), (4, [0.5, -0.5]), (5, [1e7, 1.0])]
    double = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    answers = lambda rows, queries: sorted(tuple(r)[:4] for r in topk.search(double(rows), double(queries), 5).collect())
    product = lambda v: sum(int(256 * x) * int(256 * y) for x, y in zip([1e7, 0.0], v))
    assert [(v, score) for _, _, v, score in answers(rows, rows[:1])] == sorted(((i, product(v)) for i, v in rows[1:]), key=lambda x: -x[1])
    assert [v for _, _, v, _ in answers(rows, rows[:1])][:3] == [2, 5, 1]
    far = [(0, [1e8, 1e8]), (1, [1e8, 0.0]), (2, [-1e8, 1e8]), (3, [1.0, 1e8]), (4, [1e16, 1e16]), (5, [1e16, 2e16]), (6, [-1e16, -1.0])]
    most = 2**63
    want = sorted((-max(-most, min(most - 1, sum(int(256 * x) * int(256 * y) for x, y in zip(far[0][1], v)))), i) for i, v in far[1:])[:5]
    assert [(-score, v) for _, _, v, score in answers(far, far[:1])] == want


def test_query_like_its_sql(spark, sf):
    got = cases.same(spark, QUERIES["op2_exact_top_k"], ORACLES["op2_exact_top_k"], sf)
    assert len(got) == 50


def test_bounds_spare_vectors(spark):
    """Most exact vectors are never read."""
    rows = [(i, v) for i, v in enumerate(vectors(4000, 8, 5))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    out = topk.search(frame, frame.where("vec_id % 400 = 0")).collect()
    assert max(r["n_read"] for r in out) < 2000
