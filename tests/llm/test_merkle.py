import hashlib
import random
import zlib

import cases
import pytest

from tapeloom.llm import merkle
from tapeloom.llm.queries import ORACLES, QUERIES

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Root, and for each node its siblings as (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for path, i in zip(paths, at):
            run = runs[i // 16]
            path.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at = [i // 16 for i in at]
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append((row, leaf(row, row["text"])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        trees[s] = tree([x[1] for x in groups[s]])
    root, tops = tree([trees[s][0] for s in order]) if order else (None, [])
    for s, upper in zip(order, tops):
        for (row, node), path in zip(groups[s], trees[s][1]):
            path = path + upper
            at = node
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                at = leaf(row, row["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"]))
            for a, b in path:
                at = h(a, at, b)
            yield row["doc_id"], node, trees[s][0], root, h(*[a + b for a, b in path]), at, at == root


def query(spark, rows, folder):
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{folder}/documents.parquet")
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    return [tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, str(folder)).select(names).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_like_a_plain_tree(spark, tmp_path):
    r = random.Random(11)
    rows = list(cases.rows())
    rows += [(i, f"Text {r.random()} É", "en", "hot", i % 7) for i in range(600)]  # several rounds
    rows += [(i, "Only one" if i % 2 else "only one", None, f"s{i}", None) for i in range(300)]  # more groups than a block
    rows += [(5, "same", "en", "copies", 4)] * 40 + [(i, "x", "en", "", 1) for i in range(16)] + [(i, "x", "en", "seventeen", 1) for i in range(17)]
    r.shuffle(rows)
    got = query(spark, rows, tmp_path)
    want = list(brute([dict(zip("doc_id text lang source n_chars".split(), row)) for row in rows]))
    assert ordered(got) == ordered(want)
    assert 0 < sum(not row[-1] for row in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 256, 257])
def test_sizes(spark, tmp_path, n):
    rows = [(i, f"T{i}", "en", "a", 2) for i in range(n)]
    want = list(brute([dict(zip("doc_id text lang source n_chars".split(), row)) for row in rows]))
    assert ordered(query(spark, rows, tmp_path)) == ordered(want)


def test_query_like_its_sql(spark, sf):
    got = cases.same(spark, QUERIES["op11_merkle_manifest"], ORACLES["op11_merkle_manifest"], sf)
    assert got.root.nunique() == 1


def test_other_columns_and_keys(spark):
    df = cases.clashing(cases.documents(spark)).withColumnRenamed("source", "group")
    leaves = df.select("group", "doc_id", merkle.leaf(df["doc_id"], df["text"]).alias("leaf"), "score", "node")
    made = merkle.manifest(leaves, "group", ["doc_id"], ["doc_id", "score", "node"])
    assert made.columns == ["doc_id", "score", "node", "leaf", "path", "subroot", "root"]
    rows = made.select(merkle.folded(made["leaf"], made["path"]).alias("f"), "root").collect()
    assert len(rows) == len(cases.rows()) and all(r["f"] == r["root"] for r in rows)
