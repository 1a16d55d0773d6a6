import hashlib
import random
import zlib
from fractions import Fraction

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import periodic_runs as pr
from tapeloom.llm.queries import QUERIES


def brute(w, least=0):
    """Maximal runs (start, length, period) by trying every period at every place."""
    out = []
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            s = w[i : j + p]
            if j > i and len(s) >= max(least, 3 * p) and not any(p % q == 0 and s[q:] == s[:-q] for q in range(1, p)):
                out.append((i, len(s), p))
            i = max(i + 1, j)
    return sorted(out)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def sequences(r):
    n = r.randint(0, 150)
    yield [r.randint(0, 1) for _ in range(n)]
    yield [r.randint(0, 2) for _ in range(n)]
    yield fibonacci(n)
    unit = [r.randint(0, 3) for _ in range(r.randint(1, 40))]
    yield ([9] * r.randint(0, 5) + (unit * 8)[: r.randint(0, 6 * len(unit))] + [8] * r.randint(0, 4)) * r.randint(1, 3)
    for unit in ([1] * r.randint(1, 60) + [r.randint(0, 2) for _ in range(r.randint(1, 6))], [0, 1] * r.randint(2, 15) + [5] * r.randint(0, 3)):
        a = r.randint(0, len(unit))  # periods that are mostly periodic themselves, begun anywhere
        yield (unit * 6)[a : a + r.randint(2 * len(unit), 4 * len(unit))]


@pytest.mark.parametrize("seed", range(8))
def test_like_every_period_at_every_place(seed):
    r = random.Random(seed)
    docs = [s for _ in range(40) for s in sequences(r)]
    offsets = np.cumsum([0] + [len(d) for d in docs])
    got = pr.all_runs(np.array([x for d in docs for x in d], np.int64), offsets)
    assert sorted(map(tuple, got.tolist())) == sorted((i, *x) for i, d in enumerate(docs) for x in brute(d))


def test_long_periods():
    r = random.Random(1)
    for period in (255, 256, 257, 384, 1000):
        unit = [r.randint(0, 50) for _ in range(period)]
        text = [r.randint(0, 50) for _ in range(100)] + [99] + (unit * 4)[: 3 * period + r.randint(0, 9)] + [98, 97]
        got = pr.all_runs(np.array(text), np.array([0, len(text)]))
        assert [0, 101, len(text) - 103, period] in got.tolist()


def circled(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def expected(doc_id, text):
    w = circled(doc_id, text)
    runs = brute(w, 24)
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *tail, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in dropped))


def test_query_like_brute_force(spark, tmp_path):
    r = random.Random(9)
    rows = [row for row in cases.rows() if row[0] not in (8, 9)]  # the long ones are for the next test: brute force is quadratic
    rows += [(100 + i, " ".join(f"w{x}" for x in s), "en", "z", 0) for i, s in enumerate(s for _ in range(40) for s in sequences(r))]
    rows += [(i, cases.prose(i, r.randint(0, 90)), "en", "z", 0) for i in range(1000, 1200)] + [(2000, "a  b " * 30, None, None, None), (2001, "A " * 24, "en", "", 1)]
    spark.createDataFrame(rows, cases.SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    made = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert made.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted(map(tuple, made.collect()), key=repr) == sorted((expected(row[0], row[1]) for row in rows), key=repr)


def test_cases_and_clashing_names(spark):
    df = cases.documents(spark).withColumns({"Runs": F.lit("mine"), "_source": F.lit("kept"), "start": F.lit(1)})
    made = pr.collapsed(df)
    assert made.columns == [*cases.documents(spark).columns, "_source", "start", "runs", "collapsed"]
    rows = made.collect()
    assert len(rows) == len(cases.rows()) and all(r["_source"] == "kept" for r in rows)
    long = [r for r in rows if r.text and len(r.text) > 100_000]
    assert long and all(r.runs == [] and r.collapsed == " ".join(r.text.split()) for r in long)
    again = pr.collapsed(made.drop("runs"), text="collapsed")
    assert {r.collapsed for r in again.collect()} == {r.collapsed for r in rows}
    assert pr.collapsed(cases.empty(spark)).count() == 0
