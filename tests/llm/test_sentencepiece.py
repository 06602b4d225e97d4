import hashlib

import pytest

from helpers import SMALL
from lakewright.llm import sentencepiece_codec as sc
from lakewright.llm.queries import model_path, queries

ODD = ["", " ", "  ", "a", " a", "a ", "a  ", "  a  b", "▁a", "a▁", "a▁ b", "▁", "<s>x</s>", "\n", "\n\n a", "日本 é\x00x", "\U0001f600 ok", "\t", "a\tb", "x" * 5000, "é" * 300 + " " * 40 + "z", "\xa0\xa0a", "ﬁ ½ ²", "Straße\r\nmit"]


@pytest.fixture(scope="module")
def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def test_ids_are_the_librarys(lib, edge_rows):
    codec = sc.ChunkCodec(model_path())
    assert codec.splits
    texts = ODD + [r[1] for r in edge_rows]
    packed = codec.encode(texts)
    for t, p, back in zip(texts, packed, codec.decode(packed)):
        want = lib.encode(t or "", add_bos=True, add_eos=True)
        assert sc.unpack(p) == want
        assert back == lib.decode(want)


def test_random_texts(lib):
    import random

    r = random.Random(9)
    codec = sc.ChunkCodec(model_path())
    texts = ["".join(r.choice("ab c ▁\n.é日") for _ in range(r.randint(0, 60))) for _ in range(500)]
    assert [sc.unpack(p) for p in codec.encode(texts)] == [lib.encode(t, add_bos=True, add_eos=True) for t in texts]


def test_small_table_and_whole_texts(lib, monkeypatch):
    monkeypatch.setattr(sc, "REMEMBER", 5)
    codec = sc.ChunkCodec(model_path())
    texts = ["one two three four five six seven", "eight nine one two", "z " * 30]
    want = [lib.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert [sc.unpack(p) for p in codec.encode(texts)] == want
    codec.splits = False
    assert [sc.unpack(p) for p in codec.encode(texts)] == want


def test_query(spark, small, lib):
    got = {r.doc_id: r for r in queries()["op8_sentencepiece"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d.text or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_edges(edge, empty):
    got = sc.tokenize(edge, model_path(), ids="score", decoded="shard")
    assert set(got.columns) == set(edge.columns) and got.count() == 12
    assert sc.decode(got, model_path(), ids="score", decoded="again").where("again <> shard").count() == 0
    assert sc.digests(empty, model_path()).count() == 0
