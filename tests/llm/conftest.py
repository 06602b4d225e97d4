import random

import pytest

LANGS = {"en": "the of and that with from house street water light".split(), "fr": "le de la que dans maison rue été lumière forêt".split(), "de": "der und das nicht straße haus wasser über licht wald".split()}


def prose(r, lang, n, end="."):
    words = [r.choice(LANGS[lang]) + r.choice(["", "", "s", "er", str(r.randint(0, 99))]) for _ in range(n)]
    return " ".join(words) + end


@pytest.fixture(scope="session")
def edge_rows():
    """Rows with nulls anywhere, empty and very long texts, repeated rows; two columns clash with results."""
    r = random.Random(1)
    long = " ".join(prose(r, "en", 12) for _ in range(2000))
    same = prose(r, "fr", 80)
    rows = [
        (1, same, "fr", "a", len(same)),
        (2, same, "fr", "a", len(same)),
        (2, same, "fr", "a", len(same)),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \n\t ", "en", "b", 4),
        (6, long, "en", None, len(long)),
        (7, "x" * 50_000, "en", "b", 50_000),
        (8, "12 34 !!", "en", "b", 8),
        (9, "日本語 text ▁ mark é\x00 \U0001f600", None, "c", 10),
        (10, prose(r, "de", 60) + "\n" + prose(r, "de", 70), "de", "c", 1),
        (None, "no id " + same, "fr", "c", 1),
    ]
    return [(*row, 0.5, "own") for row in rows]


DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string"


@pytest.fixture
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DDL).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DDL)
