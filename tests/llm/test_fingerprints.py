import hashlib
import random

import numpy as np
import pytest

from helpers import SMALL
from lakewright.llm import fingerprints as fp
from lakewright.llm.queries import queries


def plain_hash(text, p, base):
    h = 0
    for j, c in enumerate(text):
        h = (h + (ord(c) + 1) * pow(base, j, p)) % p
    return h


def test_spans_and_extensions():
    r = random.Random(2)
    a = "".join(r.choice("abé\U0001f600") for _ in range(400))
    b = a[:150] + "Z" + a[151:]
    x, y = fp.PrefixHashes(a), fp.PrefixHashes(b)
    for _ in range(300):
        i, j, n = r.randrange(400), r.randrange(400), r.randrange(1, 60)
        if i + n <= 400 and j + n <= 400:
            assert bool(fp.equal_spans(x, i, y, j, n)) == (a[i : i + n] == b[j : j + n])
    assert fp.common_extension(x, 0, y, 0, 400)[0] == 150
    assert fp.common_extension(x, 400, y, 400, 400, back=True)[0] == 249
    assert x.fingerprint() == f"{400:x}-" + "".join(f"{plain_hash(a, p, q):08x}" for p, q in zip(fp.PRIMES, fp.BASES))


def plain_likeness(a, b):
    """The docstring's definition, character by character."""
    if not a or not b:
        return float(a == b)
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    if head == max(n, m):
        return 1.0
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    left, right, b_left, b_right = head, n - tail, head, m - tail
    found, w = head + tail, fp.BLOCK
    if right - left >= w and b_right - b_left >= w:
        blocks = []
        for i in range(left, right - w + 1, w):
            j = b[b_left:b_right].find(a[i : i + w])
            if j >= 0:
                blocks.append((i, j + b_left))
        found += len(blocks) * w
        for k, (i, j) in enumerate(blocks):
            if k == 0 or i - blocks[k - 1][0] != w:
                most, e = min(w - 1, i - left, j - b_left), 0
                while e < most and a[i - 1 - e] == b[j - 1 - e]:
                    e += 1
                found += e
            if k == len(blocks) - 1 or blocks[k + 1][0] - i != w:
                gap = (blocks[k + 1][0] if k + 1 < len(blocks) else right) - i - w
                most, e = min(w - 1, gap // 2, b_right - j - w), 0
                while e < most and a[i + w + e] == b[j + w + e]:
                    e += 1
                found += e
    return min(1.0, found / max(n, m))


def test_likeness_against_plain():
    r = random.Random(3)
    for _ in range(80):
        a = "".join(r.choice("abcdefghij ") for _ in range(r.randint(0, 400)))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 40)] = "".join(r.choice("xyz") for _ in range(r.randint(0, 30)))
        b = "".join(b)
        assert fp.likeness(fp.PrefixHashes(a), fp.PrefixHashes(b)) == pytest.approx(plain_likeness(a, b))
    same = "abc" * 50
    assert fp.likeness(fp.PrefixHashes(same), fp.PrefixHashes(same)) == 1.0
    assert fp.likeness(fp.PrefixHashes(""), fp.PrefixHashes("")) == 1.0 and fp.likeness(fp.PrefixHashes(""), fp.PrefixHashes("a")) == 0.0
    near = fp.likeness(fp.PrefixHashes(same + "q" * 150), fp.PrefixHashes(same + "r" * 150))
    assert 0.5 <= near < 0.6


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), e, t, after))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_query(spark, small, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: r for r in queries()["op5_fingerprints"](spark, SMALL).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert len(got) == len(docs)
    for i, n, sha, e, t, after in plain(docs):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        hashes = fp.PrefixHashes(t)
        assert r.fingerprint == hashes.fingerprint() and r.edited_fingerprint == fp.PrefixHashes(e).fingerprint()
        if i % 10 == 0:
            assert r.near_edited == pytest.approx(plain_likeness(t, e)) and r.near_next == pytest.approx(plain_likeness(t, after))
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


def test_edges(spark, edge, empty):
    rows = fp.against_next(edge).collect()
    assert len(rows) == 12 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    want = sorted((x[1], x[2]) for x in plain([(r.doc_id, r.text) for r in edge.collect()]))
    assert sorted((r.n_chars, r.edited_sha256) for r in rows) == want
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert fp.against_next(empty).count() == 0
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert fp.against_next(one).first().near_next == 1.0


def test_rows_without_an_id_are_split(spark):
    """A third of the rows have no id: they fall into several tasks, and the order stays whole."""
    rows = [(None, f"text {k} " * 5) for k in range(200)] + [(k, f"doc {k} " * 4) for k in range(400)] + [(7, None)] * 3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        got = fp.against_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    want = {i: sha for i, _, sha, *_ in plain([r for r in rows if r[0] is not None and r[0] != 7]) if i not in (6, 399)}
    assert {r.doc_id: r.edited_sha256 for r in got if r.doc_id in want} == want
    own = {fp.PrefixHashes(t).fingerprint() for i, t in rows if i is None}
    assert {r.fingerprint for r in got if r.doc_id is None} == own


def test_scalar_extension():
    r = random.Random(5)
    for _ in range(200):
        a = "".join(r.choice("ab") for _ in range(r.randint(1, 60)))
        b = a[: r.randint(0, len(a))] + "".join(r.choice("ab") for _ in range(r.randint(1, 20)))
        x, y = fp.PrefixHashes(a), fp.PrefixHashes(b)
        most = min(len(a), len(b))
        assert fp._extension(x, 0, y, 0, most) == fp.common_extension(x, 0, y, 0, most)[0]
        assert fp._extension(x, len(a), y, len(b), most, back=True) == fp.common_extension(x, len(a), y, len(b), most, back=True)[0]
