import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SMALL
from lakewright.llm import language_id as li
from lakewright.llm.queries import learned_languages, model_path, queries


def plain_forward(word, pieces, p):
    f = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            if word[i:j] in pieces:
                f[j] += f[i] * p[pieces[word[i:j]]]
            elif j == i + 1:
                f[j] += f[i] * li.RARE
    return math.log(f[-1])


def test_forward_sums_all_segmentations():
    r = random.Random(1)
    pieces = {p: k for k, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "c", "abc", "bc"])}
    table = np.array([[r.random() / 10 for _ in range(3)] for _ in pieces])
    words = ["", "a", "ab", "abc", "abab", "zab", "éa", "bcabc" * 3] + ["".join(r.choice("abcz") for _ in range(r.randint(1, 30))) for _ in range(60)]
    got = li.forward(words, li.Trie(pieces), table)
    for w, row in zip(words, got):
        for k in range(3):
            assert row[k] == pytest.approx(plain_forward(li.MARK + w, pieces, table[:, k]), rel=1e-9)


def test_long_words_stay_finite():
    got = li.forward(["ab" * 4000], li.Trie({"▁": 0, "a": 1, "b": 2, "ab": 3}), np.full((4, 2), [1e-4, 2e-4]))
    assert np.isfinite(got).all() and got[0, 1] > got[0, 0]


def test_learns(spark, edge, empty):
    model = li.fit(edge, model_path())
    assert model.languages == ("de", "en", "fr")
    got = li.predict(edge, model, score="score").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 12 and by[1].lang_pred == "fr" and by[6].lang_pred == "en" and by[10].lang_pred == "de"
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (3, 4, 5, 8))
    assert all(0 <= r.score <= 1 for r in got)
    assert li.predict(empty, model).count() == 0
    none = li.fit(empty, model_path())
    assert {r.lang_pred for r in li.predict(edge, none).collect()} == {"und"}


def test_digits_are_no_letters(edge):
    model = li.fit(edge, model_path())
    assert li.Scorer(model).predict(["² ½ _ 12", "²a"])[0][0] == "und" and li.Scorer(model).predict(["²a"])[0][0] != "und"


def test_memory_limit_changes_nothing(spark, edge, monkeypatch):
    model = li.fit(edge, model_path())
    texts = [r.text for r in edge.collect()]
    want = li.Scorer(model).predict(texts)
    monkeypatch.setattr(li, "REMEMBER", 3)
    assert li.Scorer(model).predict(texts) == want


def many(docs, times=30):
    """The rows under further ids: enough texts to outweigh the smoothing."""
    return docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("doc_id", F.col("doc_id") + 10_000 * F.col("k")).drop("k")


def test_open_set(spark, small):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = learned_languages(many(docs))
    open_, closed = li.Scorer(li.open_set(model)), li.Scorer(model)
    texts = [r.text for r in docs.collect()]
    assert open_.predict(texts)[0] == closed.predict(texts)[0]  # what has a language keeps it
    assert closed.model.priors is None
    r = random.Random(5)
    junk = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(n)) for n in (20, 100, 400)]
    none = junk + ["Быстрая коричневая лиса прыгает через ленивую собаку и бежит в лес", "快速的棕色狐狸跳过懒狗"]
    langs, scores = open_.predict(none)
    assert langs == ["und"] * 5 and all(0.5 <= x <= 1 for x in scores)
    assert "und" not in closed.predict(none)[0]
    empty = li.Model(model.model_path, (), np.zeros((len(model.probabilities), 0)))
    assert li.open_set(empty) is empty


def test_query(spark, small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries()["op9_language_id"](spark, SMALL).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.95


def test_held_out_rows_teach_nothing(spark, small):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "zz").otherwise(F.col("lang")))
    assert (learned_languages(docs).probabilities == learned_languages(changed).probabilities).all()


def test_query_against_brute_force(spark, small):
    """Counts, forward passes and scores in plain Python over the whole small table."""
    import re
    from collections import Counter, defaultdict
    from functools import lru_cache

    import sentencepiece

    docs = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    learn = {i: (t, x) for i, (t, x) in docs.items() if zlib.crc32(str(i).encode()) % 5 != 0 and t is not None and x is not None}
    assert max(Counter(x for _, x in learn.values()).values()) <= li.DOCS_PER_LANG  # so all of them are learned from
    lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
    counts = defaultdict(Counter)
    for t, x in learn.values():
        counts[x].update(lib.encode(t.lower(), add_bos=True, add_eos=True))
    size = lib.vocab_size()
    total = {x: sum(c.values()) + li.SMOOTHING * size for x, c in counts.items()}
    pieces = {lib.id_to_piece(i): i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
    p = lambda x, i: (counts[x][i] + li.SMOOTHING) / total[x]
    longest = max(map(len, pieces))

    @lru_cache(None)
    def word_log(word, x):
        f, shift = [1.0], 0.0
        for j in range(1, len(word) + 1):
            f.append(sum(f[i] * (p(x, pieces[word[i:j]]) if word[i:j] in pieces else li.RARE if i == j - 1 else 0.0) for i in range(max(0, j - longest), j)))
            if j % 10 == 0 and f[j] > 0:  # keep long words in range
                shift += math.log(f[j])
                f = [v / f[j] for v in f]
        return math.log(f[-1]) + shift

    for r in queries()["op9_language_id"](spark, SMALL).collect():
        text = docs[r.doc_id][0]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = {x: sum(word_log(li.MARK + w, x) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())) for x in counts}
        best = max(sorted(logs), key=logs.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-6), r.doc_id
