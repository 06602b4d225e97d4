import random

import numpy as np
import pytest

from helpers import SMALL
from lakewright.llm import quality_classifier as qc


def texts(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    out = []
    for k in range(n):
        w = [r.choice(words) for _ in range(r.randint(30, 120))]
        junk = k % 4
        if junk == 1:
            w = [x + r.choice(["***", "%%%", "!!"]) for x in w]
        elif junk == 2:
            w = [x for x in w[:20] for _ in range(6)]
        out.append((" ".join(w) + ".", int(junk not in (1, 2))))
    return out


def score(w, t):
    f = qc.features(t)
    return 1 / (1 + np.exp(-(w[qc.BIAS] + qc.SCALE / max(1, len(f)) * w[f].sum())))


def test_learns_and_holds_out():
    w = qc.train(texts(400, 1))
    held = texts(200, 2)
    assert np.mean([(score(w, t) >= 0.5) == bool(y) for t, y in held]) > 0.97
    assert (w == qc.train(list(reversed(texts(400, 1))))).all()


def test_update_matches_the_published_rule():
    state, at, x = qc.Ftrl.empty(), np.array([5, 9]), np.array([1.0, 2.0])
    z, n = np.zeros(2), np.zeros(2)
    for label in (1, 0, 1):
        w = np.array([0 if abs(a) <= qc.L1 else -(a - np.sign(a) * qc.L1) / ((qc.BETA + b**0.5) / qc.ALPHA + qc.L2) for a, b in zip(z, n)])
        g = (1 / (1 + np.exp(-(w @ x))) - label) * x
        sigma = (np.sqrt(n + g**2) - np.sqrt(n)) / qc.ALPHA
        z, n = z + g - sigma * w, n + g**2
        state.update(at, x, label)
    assert np.allclose(state.z[at], z) and np.allclose(state.n[at], n)


def test_features_are_whole_and_blockwise(monkeypatch):
    t = "one two, three " * 50
    whole = qc.features(t)
    assert len(whole) > 200 and (whole == qc.AGAIN).sum() > 100
    monkeypatch.setattr(qc, "BLOCK", 64)
    assert len(qc.features("a" * 1000)) >= 1
    assert len(qc.features(None)) == 0 and len(qc.features("")) == 0


def test_edges(edge, empty):
    w = qc.train(texts(80, 3))
    got = qc.predict(edge, w)
    assert got.columns == [c for c in edge.columns if c != "score"] + ["score"]
    rows = got.collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert qc.predict(empty, w).count() == 0


def test_no_labels(spark, edge):
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    w = qc.fit(qc.labelled_sample(edge, labels))
    assert not w.any() and {r.score for r in qc.predict(edge, w).collect()} == {0.5}


def test_query(spark, small):
    from lakewright.llm.queries import queries
    import zlib

    got = queries()["op1_quality"](spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in got)
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [r for r in got if r.held_out and r.doc_id in good]
    assert held and np.mean([r.predicted == good[r.doc_id] for r in held]) >= 0.9


@pytest.mark.parametrize("other", ["lang", "source"])
def test_only_the_text_counts(edge, other):
    from pyspark.sql import functions as F

    w = qc.train(texts(80, 3))
    a = {r.text: r.score for r in qc.predict(edge, w).collect()}
    b = {r.text: r.score for r in qc.predict(edge.withColumn(other, F.lit("z")), w).collect()}
    assert a == b


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_blocks_change_nothing(monkeypatch, block):
    t = ["one two, three " * 50, "a" * 1000, "é日本 x!!" * 40, " lead and trail  ", "###" * 100 + "abc" * 100 + " z"]
    want = [qc.features(x) for x in t]
    monkeypatch.setattr(qc, "BLOCK", block)
    assert all((qc.features(x) == y).all() for x, y in zip(t, want))


def test_three_mebibytes_in_one_piece(monkeypatch):
    t = " ".join(f"wörd{k % 5000}," for k in range(300_000))
    assert len(t.encode()) > 3 << 20
    got = qc.features(t)
    monkeypatch.setattr(qc, "BLOCK", 1 << 30)
    assert (got == qc.features(t)).all()


M64 = 2**64 - 1


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def plain_features(text):
    """Places and their counts, token by token."""
    import re
    from collections import Counter

    kinds = rb"[0-9A-Za-z\x80-\xff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+"
    tokens = []
    for m in re.finditer(kinds, (text or "").encode()):
        h = 0
        for c in reversed(m[0]):
            h = (h * qc._BASE + int(qc._BYTE[c])) & M64
        tokens.append(plain_mix(h))
    pairs = [plain_mix((3 * a + b) & M64) for a, b in zip(tokens, tokens[1:])]
    found = Counter(max(2, h >> 46) for h in tokens + pairs)
    if len(pairs) > len(set(pairs)):
        found[qc.AGAIN] += len(pairs) - len(set(pairs))
    return found


def test_query_against_brute_force(spark, small):
    """Features, sample, training and scores in plain Python over the whole small table."""
    import math
    import zlib

    from lakewright.llm.queries import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in docs:
            labels[r.doc_id] = min(r.quality, labels.get(r.doc_id, r.quality))
    assert len(labels) <= qc.SAMPLE  # so all of them are learned from
    made = []
    for text, label in sorted((docs[i] or "", y) for i, y in labels.items()):
        f = plain_features(text)
        x = {k: float(np.float32(n * (qc.SCALE / max(1, sum(f.values()))))) for k, n in f.items()}
        made.append((x | {qc.BIAS: 1.0}, label))
    z, n = {}, {}

    def weight(k):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= qc.L1 else (math.copysign(qc.L1, v) - v) / ((qc.BETA + math.sqrt(n.get(k, 0.0))) / qc.ALPHA + qc.L2)

    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(qc.EPOCHS):
        for at in order.permutation(len(made)):
            x, label = made[at]
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g, before = (p - label) * v, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / qc.ALPHA * w[k]
                n[k] = before + g * g
    for r in queries()["op1_quality"](spark, SMALL).collect():
        f = plain_features(docs[r.doc_id])
        total = weight(qc.BIAS) + qc.SCALE / max(1, sum(f.values())) * sum(weight(k) * c for k, c in f.items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5), r.doc_id
