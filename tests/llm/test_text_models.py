"""Benchmark decontamination, the suffix-tree model, preference formatting and the pipeline."""

import math
import os
import random
import zlib
from collections import Counter
from urllib.parse import urlparse

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import decontaminate as dc
from tapeloom.llm import preference, suffix_lm
from tapeloom.llm.queries import ORACLES, QUERIES
from tapeloom.runtime import shared_dir

# -- decontamination ---------------------------------------------------------------------------


def least_distance(pattern, text):
    """Least edit distance of the pattern to any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_like_the_full_table():
    r = random.Random(1)
    for _ in range(400):
        pattern, text = ("".join(r.choices("abc", k=r.randint(a, b))) for a, b in ((1, 70), (0, 90)))
        got, want = dc.myers(pattern, text, len(pattern) - 1), least_distance(pattern, text)
        assert (got[0] if got else len(pattern)) == want
        if got:
            assert least_distance(pattern, text[: got[1]]) == want


def edited(text, edits, r):
    text = list(text)
    for _ in range(edits):
        at = r.randrange(len(text))
        kind = r.randrange(3)
        if kind == 0:
            text[at] = r.choice("qxz")
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, r.choice("qxz"))
    return "".join(text)


def test_matches_like_brute_force(spark):
    r = random.Random(2)
    items = [(i, cases.prose(100 + i, 14)) for i in range(8)] + [(50, cases.prose(100, 14).upper()), (51, None), (52, "!!"), (53, "Hi"), (None, cases.prose(300, 12))]
    docs = []
    for i in range(60):
        inside = edited(r.choice(items[:8])[1], r.randint(0, 9), r) if i % 3 else cases.prose(i, 10)
        docs.append((i, f"{cases.prose(1000 + i, 20)}, {inside} -- {cases.prose(2000 + i, 15)}"))
    docs += [(None, items[0][1]), (100, None), (101, ""), (102, "say HI! now"), (103, "high"), (104, cases.prose(300, 12)), (104, cases.prose(300, 12))]
    df = cases.clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc_id, text in docs:
        for item_id, item in items:
            a, b = dc.plain(item or ""), dc.plain(text or "")
            if a and b and (d := least_distance(a, b)) <= dc.budget(len(a), dc.RATE):
                want.append((doc_id, item_id, d))
    got = [(x["doc_id"], x["item_id"], x["distance"]) for x in dc.matches(df, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({d for *_, d in want}) > 2
    assert dc.matches(df, bench.limit(0)).count() == 0 and dc.matches(cases.empty(spark), bench).count() == 0
    assert dc.flagged(df, bench).filter("score = 'mine'").count() == len(docs)


def test_batches_of_items(spark, monkeypatch):
    docs = spark.createDataFrame([(i, cases.prose(i, 30)) for i in range(6)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, cases.prose(i, 20)) for i in range(6)], "item_id long, text string")
    monkeypatch.setattr(dc, "BATCH_CHARS", 200)
    assert len(list(dc.batches_of(bench, "item_id", "text"))) > 3
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.matches(docs, bench).collect()) == [(i, i) for i in range(6)]


def test_decontamination_query(spark, sf):
    items = [(i, dc.plain(t)) for i, t in cases.table(sf, "benchmark")]
    docs = [(d, dc.plain(t or "")) for d, t, *_ in cases.table(sf, "documents")]
    got = QUERIES["op9_decontamination"](spark, sf).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["distance"] == 0} == {(d, i) for d, t in docs for i, x in items if x in t}
    text = dict(docs)
    for r in got:
        assert least_distance(dict(items)[r["item_id"]], text[r["doc_id"]][r["begin"] : r["end"]]) == r["distance"]


# -- the suffix tree ---------------------------------------------------------------------------


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def plain_model(texts, heavy):
    """The tree in dictionaries, straight from its definition."""
    seqs = [tokens(t) for t in texts]
    count = Counter(w for s in seqs for w in s)
    total, kinds = sum(count.values()), len(count)
    share = total / heavy
    frequent = {w for w in count if count[w] >= share}
    base = lambda w: (count[w] + 1) / (total + kinds + 1)
    contexts, rest, own = {(): total}, {}, {}

    def p(context, w):
        if not context:
            return base(w)
        below = p(context[1:], w)
        return own.get((context, w), 0.0) + rest[context] * below if context in rest else below

    for depth in (1, 2):
        level = Counter()
        pairs = Counter()
        for s in seqs:
            for i in range(depth, len(s)):
                context = tuple(s[i - depth : i])
                if all(w in frequent for w in context) and (depth == 1 or context[1:] in contexts):
                    level[context] += 1
                    pairs[context, s[i]] += 1
        level = {c: n for c, n in level.items() if n >= suffix_lm.LEAST_CONTEXT * total}
        contexts.update(level)
        for context, n in level.items():
            next_words = {w: k for (c, w), k in pairs.items() if c == context and w in frequent and k >= max(2, share)}
            before = {w: p(context[1:], w) for w in next_words}
            gain = sum(k * math.log(k / n / before[w]) for w, k in next_words.items())
            left = max(n - sum(next_words.values()), 0)
            gain += left * math.log(max(left, 1e-12) / n / max(1e-12, 1 - sum(before.values())))
            if gain >= suffix_lm.DIVERGENCE:
                for w, k in next_words.items():
                    own[context, w] = max(k - suffix_lm.DISCOUNT, 0) / n
                rest[context] = 1 - sum(own[context, w] for w in next_words)
    return count, total, kinds, p, rest


@pytest.mark.parametrize("heavy", [suffix_lm.HEAVY, 60])
def test_like_a_plain_tree(spark, heavy):
    r = random.Random(3)
    chains = ["the cat sat on the mat", "a dog ran to the old house", "on the hill the cat slept", "rare words here"]
    texts = [" ".join(r.choice(chains) for _ in range(r.randint(0, 12))) + f" id{i}" for i in range(300)] + [None, "", "THE cat", "ünï the cat"]
    fresh = ["the cat unseen mat", None, "", "a dog ran to the old mat on the hill", "x" * 30_000 + " the cat", texts[0], texts[0]]
    frame = lambda x: spark.createDataFrame([(i if i % 4 else None, t, "mine") for i, t in enumerate(x)], "doc_id long, text string, n_tokens string")
    model, counts = suffix_lm.fit(frame(texts), heavy=heavy)
    count, total, kinds, p, rest = plain_model(texts, heavy)
    assert (model.total, model.kinds) == (total, kinds) and any(len(c) == 2 for c in rest)
    assert sum(int((x != 1.0).sum()) for x in model.rest) == len(rest)
    got = suffix_lm.score(frame(texts + fresh), model, counts, ["doc_id", "text"]).collect()
    assert len(got) == len(texts + fresh)
    for row in got:
        seq = tokens(row["text"])
        assert row["n_tokens"] == len(seq) and row["n_known"] == sum(count[w] > 0 for w in seq)
        assert math.isclose(row["base_score"], sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in seq), rel_tol=1e-9)
        assert math.isclose(row["score"], sum(math.log10(p(tuple(seq[max(0, i - 2) : i]), w)) for i, w in enumerate(seq)), rel_tol=1e-9), row["text"]


@pytest.mark.parametrize("often", [suffix_lm.HEAVY, 60])
def test_tree_does_not_shrink_as_its_corpus_grows(spark, monkeypatch, often):
    r = random.Random(4)
    chains = ["the cat sat on the mat", "a dog ran to the old house", "on the hill the cat slept"]
    texts = [" ".join(r.choice(chains) for _ in range(r.randint(0, 6))) for _ in range(60)] + ["a seldom pair met on the hill", "an odd pair left"] * 40 + ["filler " * 600_000, None]
    monkeypatch.setattr(suffix_lm, "LEAST_CONTEXT", 0.0)
    count, total, kinds, p, rest = plain_model(texts, 1 << 40)
    monkeypatch.undo()
    monkeypatch.setattr(suffix_lm, "HEAVY", often)
    model, groups = suffix_lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {(b"seldom",), (b"seldom", b"pair")} <= set(rest)
    fresh = ["a seldom pair met the cat", "seldom pair", "the old house seldom pair met", "unseen seldom pair unseen", "filler filler cat", None]
    for row in suffix_lm.score(spark.createDataFrame([(t,) for t in fresh], "text string"), model, groups, ["text"]).collect():
        seq = tokens(row["text"])
        assert row["n_known"] == sum(count[w] > 0 for w in seq)
        assert math.isclose(row["score"], sum(math.log10(p(tuple(seq[max(0, i - 2) : i]), w)) for i, w in enumerate(seq)), rel_tol=1e-9), row["text"]


def test_tree_leaves_no_table_but_its_values(spark):
    folder = urlparse(shared_dir(spark)).path
    texts = ["the cat sat on the mat"] * 30 + ["a dog ran to the old house", None, ""] * 10
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    before = set(os.listdir(folder))
    model, groups = suffix_lm.fit(frame)
    got = suffix_lm.score(frame.repartition(7), model, groups, ["doc_id", "text"]).collect()
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["values"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == spark.newSession().conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    count, total, kinds, p, _ = plain_model(texts, 1 << 40)
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for row in got:  # equal texts lie in many partitions
        seq = tokens(row["text"])
        assert row["n_known"] == len(seq) == row["n_tokens"]
        assert math.isclose(row["base_score"], sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in seq), rel_tol=1e-9)


def test_groups_and_values_travel_packed(spark, monkeypatch):
    r = random.Random(5)
    texts = [" ".join(f"word{min(int(r.paretovariate(0.7)), 9000)}" for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["a word of more than sixteen bytes: abcdefghijklmnopqrstuvwxyz", "  Blanks\tat\x0bboth\x0cends \r\n", "nul\x00 nul", None, ""] * 6
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    every = np.full(suffix_lm.BITS >> 6, -1, np.int64).view(np.uint64)
    blocks = frame.select("text").coalesce(1).mapInArrow(suffix_lm._groups(spark.sparkContext.broadcast((every, np.zeros(0, np.int64))), 1, 3), "bucket int, block binary").collect()
    pairs = Counter(p for t in texts for p in zip(tokens(t), tokens(t)[1:], strict=False))
    counts = np.concatenate([suffix_lm._unpacked(b["block"])[-1] for b in blocks])
    assert {b["bucket"] for b in blocks} == {0, 1, 2} and sorted(counts.tolist()) == sorted(pairs.values())
    assert sum(len(b["block"]) for b in blocks) < 8 * len(pairs)  # three whole numbers are 24 bytes
    monkeypatch.setattr(suffix_lm, "HEAVY", 50)  # so most values are asked for
    monkeypatch.setattr(suffix_lm, "HOT", 100)
    monkeypatch.setattr(suffix_lm, "LEAST_CONTEXT", 0.0)
    monkeypatch.setattr(suffix_lm, "PER_BUCKET", 1 << 12)
    model, groups = suffix_lm.fit(frame)
    got = suffix_lm.score(frame.repartition(3), model, groups, ["doc_id", "text"]).collect()
    count, total, kinds, p, rest = plain_model(texts, 1 << 40)
    assert rest and sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for row in got:
        seq = tokens(row["text"])
        assert row["n_known"] == len(seq) == row["n_tokens"]
        assert math.isclose(row["score"], sum(math.log10(p(tuple(seq[max(0, i - 2) : i]), w)) for i, w in enumerate(seq)), rel_tol=1e-9), row["text"]


def test_distributions_sum_to_one(spark):
    texts = ["a b a b a c"] * 40 + ["b a c c"] * 30
    count, total, kinds, p, _ = plain_model(texts, suffix_lm.HEAVY)
    for context in [(), (b"a",), (b"b",), (b"a", b"b")]:
        assert math.isclose(sum(p(context, w) for w in [*count, b"unseen"]), 1.0)


def test_lookup_holds_all_keys():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 40, 5000))
    table = suffix_lm.Lookup(keys, np.arange(len(keys)), -1)
    assert (table.get(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(r.integers(0, 1 << 40, 5000), keys)
    assert (table.get(others) == -1).all() and len(suffix_lm.Lookup(keys[:0], keys[:0], -1).get(keys)) == len(keys)


def test_lm_on_empty_tables(spark):
    model, counts = suffix_lm.fit(cases.empty(spark))
    assert suffix_lm.score(cases.empty(spark), model, counts, ["doc_id"]).count() == 0
    got = suffix_lm.score(cases.documents(spark), model, counts, ["doc_id"]).collect()
    assert all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in got)


def test_lm_query_beats_its_base_on_texts_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op10_suffix_tree_lm"](spark, sf).collect()}
    docs = [(d, tokens(t)) for d, t, *_ in cases.table(sf, "documents")]
    count = Counter(w for d, s in docs if zlib.crc32(str(d).encode()) % 7 != 2 for w in s)
    total, kinds = sum(count.values()), len(count)
    assert len(got) == len(docs) and all(got[d]["train_tokens"] == total for d, _ in docs)
    for d, s in docs:
        assert got[d]["n_tokens"] == len(s) and got[d]["n_known"] == sum(count[w] > 0 for w in s)
        assert math.isclose(got[d]["base_score"], sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in s), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# -- preferences -------------------------------------------------------------------------------


def turns_of(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, set()).add((turn, role, text))
    low = lambda x: (x is not None, x)
    return {c: sorted(t, key=lambda x: tuple(map(low, x))) for c, t in out.items()}


def formatted(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
        n += 1

    def render(turns):
        text, spans = "", []
        for _, role, said in turns:
            text += f"<|{role or ''}|>\n"
            start = len(text)
            text += f"{said or ''}<|end|>\n"
            if role == "assistant":
                spans.append((start, len(text)))
        return text, spans

    return n, render(a[:n])[0], render(a[n:]), render(b[n:])


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes 😀"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", "why"), (2, 3, "assistant", "so"), (3, 0, "user", "alone"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "yes 😀"), (4, 1, "assistant", "yes 😀"), (None, 0, "user", "hi"), (5, None, None, None), (6, 0, None, "x"), (6, 0, "user", None), (7, 2, "user", "hi"), (7, 2, "assistant", ""),
]


def test_pairs_like_brute_force(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("mine"))
    ids = [(1, 2), (2, 1), (1, 4), (3, None), (None, 3), (1, 99), (5, 6), (7, 1), (6, 6)]
    pairs = spark.createDataFrame(ids, "chosen_id long, rejected_id long").withColumn("prompt", F.lit("mine"))
    got = {(r["chosen_id"], r["rejected_id"]): r for r in preference.format_pairs(pairs, df).collect()}
    known = turns_of(TURNS)
    assert len(got) == len(ids)
    for a, b in ids:
        n, prompt, (chosen, a_mask), (rejected, b_mask) = formatted(known.get(a, []), known.get(b, []))
        r = got[a, b]
        assert (r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) == (n, prompt, chosen, rejected)
        assert [tuple(x) for x in r["chosen_mask"]] == a_mask and [tuple(x) for x in r["rejected_mask"]] == b_mask
    assert preference.format_pairs(pairs.limit(0), df).count() == 0
    assert preference.pairs_formatted(preference.same_start_pairs(df.limit(0))).count() == 0


def test_a_null_role_is_not_a_null_text(spark, tmp_path):
    rows = [(1, 0, None, "user"), (1, 1, "assistant", "a"), (2, 0, "user", None), (2, 1, "assistant", "b"), (3, 0, None, "user"), (3, 1, "assistant", "c"), (4, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["chosen_id"]: r["rejected_id"] for r in QUERIES["op7_preference_format"](spark, str(tmp_path)).collect()}
    assert got == {1: 3, 3: 1, 2: -1, 4: -1}


def test_preference_query_like_its_sql(spark, sf):
    got = cases.same(spark, QUERIES["op7_preference_format"], ORACLES["op7_preference_format"], sf)
    known = turns_of(cases.table(sf, "conversations"))
    assert sorted(got["chosen_id"]) == sorted(known)


# -- the pipeline ------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert after.columns == columns, name
        if name == "secrets":
            assert after.count() == sizes[-1]
        docs = after
        sizes.append(after.count())
    assert sizes[0] > sizes[1] > sizes[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, last.select("doc_id", "n_tokens").collect()))
    items = [dc.plain(t) for _, t in cases.table(sf, "benchmark")]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any(x in dc.plain(t or "") for x in items for t in texts.values())


def test_stages_leave_other_columns_alone(spark, sf):
    """Columns named like the stages' own, in any case, and rows that repeat."""
    names = "score _score Hits _hits spans _spans key _key once _once alike root node statistics decoded _source".split()
    docs = cases.documents(spark).withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    docs = docs.union(docs.where("doc_id in (2, 13)"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert rows and all(r[n] == f"{n}{'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names), name
        if name == "near_duplicates":
            assert len({(r["doc_id"], r["text"]) for r in rows}) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).columns == ["doc_id", "lang", "source", "n_tokens", "ids", "begins", "ends"]


def test_pipeline_keeps_odd_rows(spark, sf):
    docs = cases.documents(spark)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, sf)
    assert docs.where("n_tokens = 0").count() == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, cases.empty(spark), sf).count() == 0
