"""Language identification, URL verdicts and quality."""

import random
import zlib

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import langid, quality, urlfilter
from tapeloom.llm.queries import QUERIES, URL_RULES


# -- languages ---------------------------------------------------------------------------------


def windows(text):
    """Three-letter windows of padded words, one by one."""
    folded = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    return sorted(w[i : i + 3] for w in (f" {x} " for x in folded.split()) for i in range(len(w) - 2))


def test_windows():
    for text in ["", "a", "Hello, wörld! 12x", "日本 語", "  a  b", "İstanbul ß"]:
        found, owner = langid.grams([text])
        mask = (1 << 21) - 1
        assert sorted("".join(chr(int(g) >> s & mask) for s in (0, 21, 42)) for g in found) == windows(text)
    a, b = langid.grams(["ab cd", "", "cd"])
    assert np.bincount(b, minlength=3).tolist() == [4, 0, 2]


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 50)
    text = cases.prose(1, 400)
    parts = list(langid.pieces(text))
    assert "".join(parts) == text and len(parts) > 20
    assert sorted(np.concatenate([langid.grams([p])[0] for p in parts])) == sorted(langid.grams([text])[0])


def test_filters_return_all_languages_of_an_ngram():
    known = [np.arange(i, 3000, i + 1).astype(np.uint64) for i in range(70)]  # more languages than a word has bits
    model = langid.Languages.build([str(i) for i in range(70)], known)
    some = np.arange(3000).astype(np.uint64)
    masks = model.masks(some)
    for i, own in enumerate(known):
        bit = (masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
        assert bit[own.astype(int)].all()
        assert abs((bit.sum() - len(own)) / 3000 - model.wrong[i]) < 0.02


def test_language_rows(spark):
    df = cases.documents(spark)
    model = langid.train(df)
    got = {r["doc_id"]: r for r in langid.identify(cases.clashing(df), model).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5, 11)] == ["und"] * 4 and got[3]["score"] == 0
    assert got[12]["lang_pred"] == "ja" and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1]["region"] == "mine"
    untrained = langid.train(cases.empty(spark))
    assert {r["lang_pred"] for r in langid.identify(df, untrained).collect()} == {"und"}
    assert langid.identify(cases.empty(spark), model).count() == 0


def test_few_long_texts_take_no_ngrams_from_a_language(spark):
    r = random.Random(1)
    vocabulary = ["".join(r.choices("etaoinshrdlu", k=r.randint(3, 9))) for _ in range(1500)]
    some = lambda n: " ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(1500)], k=n))
    other = " ".join("".join(r.choices("bcfgkmpvwxyz", k=5)) for _ in range(30))
    rows = [(some(30), "en") for _ in range(3000)] + [(some(8000), "xx")] + [(other, "yy")]
    model = langid.train(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string"))
    fresh = [(some(30), "en") for _ in range(100)] + [(other, "yy")]
    got = langid.identify(spark.createDataFrame(fresh, "text string, lang string"), model).collect()
    # 'xx' is the same language, so a text may still hold a rare n-gram that only its long text has
    assert sum(x["lang_pred"] == x["lang"] for x in got) >= 95 and got[-1]["lang_pred"] == "yy"


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op5_language_id"](spark, sf).collect()}
    docs = cases.table(sf, "documents")
    assert len(got) == len(docs)
    held = [(got[d]["lang_pred"], lang) for d, _, lang, *_ in docs if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in docs)
    assert sum(a == b for a, b in held) / len(held) >= 0.98


# -- URLs --------------------------------------------------------------------------------------


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[n:]
    m = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), path[:m]


def rule_of(host, path):
    fits = [(len(r), len(r.split("/")[0]), r, v) for v, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[2:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "://x", "HTTP://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net?x=/en/", "http://net/", "http://x.net/", "http://xnet/",
    "https://example.com/de/1", "https://sub.example.com/de", "http://a.org/fr/", "http://org/fr/#", "http://a.b/c://d", "http://é.ORG/fr/ü", "x://y//z", "http://example.net/en/#a", "a://b://c/d",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    host, path = urlfilter.parts(F.col("url"))
    got = df.select("url", host.alias("host"), path.alias("path")).withColumns(dict(zip(("rule", "verdict"), urlfilter.matched(F.col("host"), F.col("path"), URL_RULES)))).collect()
    for row in got:
        assert (row["host"], row["path"]) == host_path(row["url"]), row["url"]
        assert (row["rule"], row["verdict"]) == rule_of(row["host"], row["path"])
    assert df.select(urlfilter.matched(host, path, [])[0]).distinct().first()[0] is None


def test_regression_learns_from_ngrams():
    hosts = [f"shop{i}.casino{i % 7}.com" for i in range(60)] + [f"www.library{i}.edu" for i in range(60)]
    paths = [f"/win/{i}" for i in range(60)] + [f"/catalog/{i}" for i in range(60)]
    y = np.array([1.0] * 60 + [0.0] * 60)
    model = urlfilter.regress(hosts[::2], paths[::2], y[::2])
    assert ((model.score(hosts[1::2], paths[1::2]) >= 0.5) == y[1::2]).all()
    assert urlfilter.regress([], [], np.zeros(0)).score([""], [""]).tolist() == [0.5]
    assert urlfilter.regress(["a"], ["/"], np.ones(1)).score(["b", ""], ["/c", ""]).min() > 0.5


def test_copies_of_a_url_are_one_row_of_the_table(spark, monkeypatch):
    urls = spark.createDataFrame([(f"h{i}.net", f"/{i}", "block" if i % 2 else "allow") for i in range(500)], "host string, path string, verdict string")
    first = urls.orderBy(F.pmod(F.xxhash64(F.concat("host", "path")), F.lit(1 << 30))).limit(1)  # is drawn before all others
    learned = []
    monkeypatch.setattr(urlfilter, "regress", lambda hosts, paths, y, weight: learned.append((hosts, weight)))
    urlfilter.fit(urls.unionByName(first.crossJoin(spark.range(2000)).drop("id")), rows=100)
    hosts, weight = learned[0]
    assert 50 < len(hosts) == len(set(hosts)) < 150 and sorted(weight) == [1.0] * (len(hosts) - 1) + [2001.0]


def test_weights_like_copies():
    hosts, paths, y = ["a.net", "b.org", "c.net"], ["/x", "/y", "/z"], np.array([1.0, 0.0, 0.0])
    few = urlfilter.regress(hosts, paths, y, weight=np.array([3.0, 1.0, 2.0]))
    at = [0, 0, 0, 1, 2, 2]
    many = urlfilter.regress([hosts[i] for i in at], [paths[i] for i in at], y[at])
    assert np.allclose(few.weights, many.weights) and np.isclose(few.bias, many.bias)


def test_url_query(spark, sf):
    got = QUERIES["op6_url_filter"](spark, sf).collect()
    pages = {p: u for p, u, _ in cases.table(sf, "pages")}
    assert len(got) == len(pages)
    for row in got:
        assert (row["host"], row["path"]) == host_path(pages[row["page_id"]])
        rule, verdict = rule_of(row["host"], row["path"])
        assert row["rule"] == rule and row["verdict"] == (verdict or ("block" if row["score"] >= 0.5 else "allow"))


def test_model_agrees_with_rules_it_did_not_see(spark):
    sf = "/root/testdata/sf0.01"
    host, path = urlfilter.parts(F.col("url"))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = urlfilter.matched(F.col("host"), F.col("path"), URL_RULES)
    known = pages.withColumns({"rule": rule, "verdict": verdict}).where("verdict is not null").cache()
    model = urlfilter.fit(known.where("page_id % 2 = 0"))
    rest = known.where("page_id % 2 = 1").toPandas()
    said = np.where(model.score(rest["host"].tolist(), rest["path"].tolist()) >= 0.5, "block", "allow")
    assert (said == rest["verdict"]).mean() > 0.95


# -- quality -----------------------------------------------------------------------------------


def walk(model, row):
    """One row through all trees, node by node."""
    total = model.base
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_flattened_trees_like_a_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.grow(x, y, trees=40)
    assert np.allclose(model.score(x), [walk(model, row) for row in x])
    fresh = r.normal(size=(500, 5))
    assert ((model.score(fresh) >= 0.5) == ((fresh[:, 0] > 0) ^ (fresh[:, 1] > 0.5))).mean() > 0.9
    assert quality.grow(np.zeros((0, 5)), np.zeros(0)).score(fresh).tolist() == [0.5] * 500
    assert len(set(quality.grow(x, np.ones(500)).score(fresh))) == 1


def test_quality_rows(spark):
    df = cases.clashing(cases.documents(spark))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (8, 0, 0), (None, 1, 0), (9, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(quality.statistics_of(df, ["doc_id"]), labels, F.lit(True))
    got = quality.scored(df, model).collect()
    assert len(got) == len(cases.rows()) and all(0 <= r["score"] <= 1 for r in got) and got[0]["key"] == "mine"
    assert {r["score"] for r in got if not r["text"]}.__len__() == 1
    assert quality.scored(cases.empty(spark), model).count() == 0
    assert quality.fit(quality.statistics_of(cases.empty(spark), ["doc_id"]), labels, F.lit(True)).score(np.zeros((1, 20)))[0] == 0.5


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op8_quality"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == 10_000 and (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.index]).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    labels = {d: q for d, q, _ in cases.table(sf, "labels")}
    held = [(got.at[d, "predicted"], got.at[d, "score"], q) for d, q in labels.items() if got.at[d, "held_out"]]
    assert sum(p == q for p, _, q in held) / len(held) > 0.97
    low, high = [s for _, s, q in held if q == 0], [s for _, s, q in held if q == 1]
    assert np.mean([a < b for a in low for b in high]) > 0.97


@pytest.mark.parametrize("name", ["op5_language_id", "op8_quality"])
def test_whole_table(spark, sf, name):
    assert QUERIES[name](spark, sf).count() == len(cases.table(sf, "documents"))
