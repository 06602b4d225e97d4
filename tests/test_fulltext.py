import math
import random
import re

from pyspark.sql import functions as F

from helpers import SMALL
from lakewright.functions.bags import numbered, with_places
from lakewright.functions.stemming import STOP, lexeme_of
from lakewright.operators import fulltext as ft, retrieval
from lakewright.plans import base, catalogue

TEXTS = ["the widow of a farmer needs a pension", "pensions for farmers, pension schemes", "widows and the widowed", "nothing here", "", None, "pension " * 400, "farmer " + "x " * 150 + "widow"]


def plain(texts, question):
    """key -> (all, any) by the published formula, on whole lists."""
    out = {}
    every, some = ft.every_term(question), ft.some_terms(question)
    for k, t in enumerate(texts):
        at = {}
        for i, w in enumerate(re.findall(r"[^\W_]+", (t or "").lower()), 1):
            if (s := lexeme_of(w)) is not None:
                at.setdefault(s, []).append(min(i, 16383))
        at = {s: p[:255] for s, p in at.items()}
        any_ = lambda terms: sum(0.1 * sum(1 / (j * j) for j in range(1, len(at.get(s, [])) + 1)) / 1.64493406685 for s in terms) / max(1, len(terms))
        has_all, left = bool(every) and all(s in at for s in every), 1.0
        if has_all and len(every) > 1:
            for i in range(len(every)):
                for j in range(i):
                    for x in at[every[i]]:
                        for y in at[every[j]]:
                            d = abs(x - y)
                            if d:
                                left *= 1 - math.sqrt(0.01 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
        if any(s in at for s in every + some):
            out[k] = (has_all, any(s in at for s in some), (1 - left if len(every) > 1 else any_(every)) if has_all else None, any_(some))
    return out


def index(spark):
    rows = spark.createDataFrame([(k, t, (t or "")[:20]) for k, t in enumerate(TEXTS)], "k long, t string, title string")
    return ft.describe(rows, "k", F.col("t"), "title")


def test_ranks_against_plain(spark, tmp_path):
    made = index(spark)
    ft.write(made, str(tmp_path / "index"))
    for held in (made, ft.read(spark, str(tmp_path / "index"), "bigint")):
        for q in ("a widow farmer", "the farmers' pensions", "pension", "the of a", "unseen words", "widow widows widowed"):
            want = plain(TEXTS, q)
            got = {r.key: r for r in ft.ranked(held, q).collect()}
            assert set(got) == set(want), q
            for k, (has_all, has_any, all_score, any_score) in want.items():
                r = got[k]
                assert (r.has_all, r.has_any) == (has_all, has_any) and abs(r.any_score - any_score) < 1e-12
                assert (r.all_score is None) == (all_score is None) and (all_score is None or abs(r.all_score - all_score) < 1e-9)


def test_many_forms_are_joined(spark, monkeypatch):
    want = {tuple(r) for r in ft.ranked(index(spark), "widow pension").collect()}
    monkeypatch.setattr(ft, "MOST_FORMS", 1)
    assert {tuple(r) for r in ft.ranked(index(spark), "widow pension").collect()} == want


def test_questions():
    assert ft.every_term("Is the widow of the farmers here?") == ["widow", "farmer"] and "here" in STOP
    assert ft.some_terms("I am a widow in Punjab, what pension can I get?") == ["widow", "punjab", "pension"]
    assert ft.every_term("the of") == [] and ft.some_terms("") == []


def test_forms_of_the_question_are_all_there(spark, small):
    assert ft.every_term(catalogue.QUESTION) == ft.some_terms(catalogue.QUESTION) == list(catalogue.FORMS)
    words = {r.term: r.stem for r in base.text_index(spark, SMALL).vocabulary.where(F.col("stem").isin(list(catalogue.FORMS))).collect()}
    assert words and all(w in catalogue.FORMS[s] for w, s in words.items())
    assert all(lexeme_of(w) == s for s, ws in catalogue.FORMS.items() for w in ws)


def test_index_follows_its_files(spark, small):
    assert base.text_index(spark, SMALL) is base.text_index(spark, SMALL)


def test_ranking_and_retrieval(spark):
    rows = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0)], "slug string, score double")
    assert [tuple(r) for r in retrieval.ranking(rows, 2, F.desc("score"), "slug").collect()] == [("a", 2.0, 0), ("b", 2.0, 1)]
    assert retrieval.ranking(rows.limit(0), 5, "slug").count() == 0
    held = spark.createDataFrame([("a", "widow pension", "widow pension"), ("b", "farm", "a widow"), ("c", "none", "x")], "slug string, title string, description string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "slug string, embedding array<float>")
    got = retrieval.retrieve(held, vectors, vectors.limit(0), "the widow's pension", [1.0, 0.0], F.concat_ws(" ", "title", "description")).collect()
    assert [r.slug for r in got] == ["a", "b", "c"] and [r.position for r in got] == [0, 1, 2]
    again = retrieval.retrieve(held, vectors, vectors, "widow", [1.0, 0.0], F.concat_ws(" ", "title", "description"), reranked=True).collect()
    assert again[0].slug in "ab"


def test_places_and_bags(spark):
    r = random.Random(3)
    lists = [[r.choice("abcde") for _ in range(r.randint(0, 30))] for _ in range(40)] + [[], None]
    rows = with_places(spark.createDataFrame([(k, w) for k, w in enumerate(lists)], "k int, w array<string>"), "w", "x")
    for row in rows.select("k", "x", numbered(F.col("x")).alias("n")).collect():
        words = lists[row.k]
        if words is None:
            assert row.x is None
            continue
        assert {g.term: g.places for g in row.x} == {w: [i for i, y in enumerate(words) if y == w] for w in words}
        assert len(set(row.n)) == len(words)
