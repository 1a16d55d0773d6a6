import hashlib
import random

import cases
import pytest
import sentencepiece

from tapeloom.llm import sentencepiece_codec as sc
from tapeloom.llm.queries import QUERIES, piece_model


@pytest.fixture(scope="module")
def model():
    return piece_model()


def byte_ends(text):
    out = [0]
    for c in text:
        out.append(out[-1] + len(c.encode()))
    return out


def test_random_texts_like_the_library(model):
    codec, library, r = sc.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(2)
    alphabet = [*"ab  \n\t é▁漢\x00😀‍ﬁ", "</s>", "<s>", "<0x1e>", "the ", "▁", "12"]
    for _ in range(1500):
        text = "".join(r.choices(alphabet, k=r.randint(0, 30)))
        (ids, begins, ends), proto, at = codec.encode([text])[0], library.encode(text, return_type="proto"), byte_ends(text)
        assert ids.tolist() == [p.id for p in proto.pieces]
        assert codec.decode(ids.tolist()) == library.decode(ids.tolist())
        spans = [(p.begin, p.end) for p in proto.pieces]
        assert list(zip(begins.tolist(), ends.tolist())) in (spans, [(at[a], at[b]) for a, b in spans if b < len(at)])
        some = r.choices(range(32000), k=5) + r.choices(range(300), k=8)
        r.shuffle(some)
        assert codec.decode(some) == library.decode(some)


def test_spans_cover_the_text(model):
    text = "Hello  Straße 漢字\n😀 end"
    (ids, begins, ends) = sc.Codec(model).encode([text])[0]
    assert begins[0] == 0 and ends[-1] == len(text.encode())
    assert all(a <= b for a, b in zip(begins, ends)) and all(ends[:-1] == begins[1:])
    raw = text.encode()
    assert raw[begins[-1] : ends[-1]].decode().strip() == "end"


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf", "nfkc_cf"])
@pytest.mark.parametrize("trim", [True, False])
def test_character_map_like_the_library(model, rule, trim):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.normalizer_spec.precompiled_charsmap = _map_of(rule)
    proto.normalizer_spec.name = rule
    proto.normalizer_spec.remove_extra_whitespaces = trim
    changed = proto.SerializeToString()
    codec, library, r = sc.Codec(changed), sentencepiece.SentencePieceProcessor(model_proto=changed), random.Random(3)
    assert len(codec.map) > 1000
    alphabet = [*"ab  \t\nÉéﬁ①㍿ｱﾞＡ½​　가́é", "  "]
    for _ in range(600):
        text = "".join(r.choices(alphabet, k=r.randint(0, 16)))
        (ids, begins, ends), proto_out, at = codec.encode([text])[0], library.encode(text, return_type="proto"), byte_ends(text)
        assert ids.tolist() == [p.id for p in proto_out.pieces], text
        spans = [(p.begin, p.end) for p in proto_out.pieces]
        assert list(zip(begins.tolist(), ends.tolist())) in (spans, [(at[a], at[b]) for a, b in spans if b < len(at)]), text


def _map_of(rule):
    from sentencepiece import sentencepiece_model_pb2 as pb

    raw = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    proto = pb.ModelProto()
    proto.ParseFromString(raw)
    return proto.normalizer_spec.precompiled_charsmap


def test_rows_of_every_kind(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = cases.clashing(cases.documents(spark))
    out = sc.encode(rows, model, decoded="decoded")
    got = out.collect()
    assert len(got) == len(cases.rows()) and out.columns.count("ids") == 1 and got[0]["score"] == "mine"
    for row in got:
        assert row["ids"] == library.encode(row["text"] or "")
        assert row["decoded"] == library.decode(row["ids"])
    assert sc.decode(out.drop("decoded"), model).select("decoded").collect() == out.select("decoded").collect()
    assert sc.encode(cases.empty(spark), model).count() == 0


def test_query(spark, sf, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = {r["doc_id"]: r for r in QUERIES["op1_sentencepiece"](spark, sf).collect()}
    docs = cases.table(sf, "documents")
    assert len(got) == len(docs)
    for doc_id, text, *_ in docs:
        ids = library.encode(text or "")
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_query_on_texts_without_pieces(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, "a b"), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op1_sentencepiece"](spark, str(tmp_path)).collect()}
    assert {k: (r["n_tokens"], r["covered_bytes"]) for k, r in got.items()} == {1: (0, 0), 2: (0, 0), 3: (2, 3), None: (0, 0)}
    empty = hashlib.sha256(b"").hexdigest()
    assert all((got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (empty, empty) for k in (1, 2, None))
