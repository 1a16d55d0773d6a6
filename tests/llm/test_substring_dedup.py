import random
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import substring_dedup as sd
from tapeloom.llm.queries import ORACLES, QUERIES
from tapeloom.llm.wordarrays import words_of


def brute(texts, size):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    for w in words:
        covered = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                covered.update(range(i, i + size))
        yield len(w), len(covered), b" ".join(x for i, x in enumerate(w) if i not in covered).decode()


def passages(seed, n):
    """Texts of few words with shared passages, some of them just as long as a window or one word shorter."""
    r = random.Random(seed)
    shared = [[r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(k)] for k in (4, 5, 5, 6, 12, 40)]
    out = [None, "", " \n", "one two", "x " * 30]
    for _ in range(n):
        text = []
        for _ in range(r.randint(0, 6)):
            text += r.choice(shared) if r.random() < 0.5 else [f"u{r.randint(0, 10**6)}" for _ in range(r.randint(0, 9))]
        out.append(r.choice([" ", "\t", " \x0b\n"]).join(text))
    return out + out[-40:]


@pytest.mark.parametrize("width", [sd.WIDTH, 1 << 6, 1])
def test_loses_none_however_narrow(spark, monkeypatch, width):
    monkeypatch.setattr(sd, "PER_CELL", 500)
    monkeypatch.setattr(sd, "PER_EXACT", 300)
    texts = passages(5, 600)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(7)
    made = sd.without_repeats(df, size=5, width=width).orderBy("id").collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in made] == list(brute(texts, 5))


def test_cases_and_clashing_names(spark):
    df = cases.documents(spark).withColumns({"N_Words": F.lit("mine"), "chunk": F.lit(3), "payload": F.lit("p"), "cell": F.lit(1)})
    made = sd.without_repeats(df)
    assert made.columns == [*cases.documents(spark).columns, "chunk", "payload", "cell", "n_words", "n_removed", "kept"]
    got = sorted((r.text or "", r.n_words, r.n_removed, r.kept) for r in made.collect())
    texts = [row[1] for row in cases.rows()]
    assert got == sorted((t or "", *b) for t, b in zip(texts, brute(texts, 35)))
    empty = sd.without_repeats(cases.empty(spark))
    assert empty.count() == 0 and empty.columns[-1] == "kept"


def test_query_like_its_sql(spark, sf):
    got = cases.same(spark, QUERIES["op12_substring_dedup"], ORACLES["op12_substring_dedup"], sf)
    assert got.n_removed.sum() > 0


def test_packing():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        v = np.unique(r.integers(0, 1 << 24, n))
        assert (sd.unpacked(sd.packed(v)) == v).all()
    words, offsets = words_of(pa.array(["  a  b ", None, "", "x\x1cy z\xa0w\x0b\x0cq\t\n"]).slice(1, 3))
    assert words.to_pylist() == ["x\x1cy", "z\xa0w", "q"] and offsets.tolist() == [0, 0, 0, 3]
