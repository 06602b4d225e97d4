"""Extra columns with the names that operators and stages use inside: their values pass through."""

import pytest
from pyspark.sql import functions as F

from helpers import SMALL
from lakewright.llm import common, fingerprints, host_rules, html_extraction, jaccard_join, language_id, mixing, quality_classifier, sentencepiece_codec, sharding, substring_dedup
from lakewright.llm.queries import model_path

INSIDE = """__id __lines __version __spans __drop __gone __source __weight __whole __extra __copy __slot __lang __score __host __body __text
whole extra_blocks weight source_tokens epochs id h k m n a b kind gid own other comp lines spans starts ends version rejected host known
n_lines held edge part bucket rep last name token ids hits""".split()


@pytest.fixture
def crowded(spark):
    """Documents with a column for each inner name, which holds the row's number."""
    rows = [(k, f"{'la maison de la rue ' * 12}{k % 4} ###", "fr", f"s{k % 2}", 1) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.col("doc_id").alias(x) for x in INSIDE])


def kept(out, names=INSIDE):
    rows = out.collect()
    assert rows and all(r[x] == r["doc_id"] for r in rows for x in names)
    return rows


def test_jaccard_join(crowded):
    assert len(jaccard_join.components(crowded).collect()) == 8
    assert len(kept(jaccard_join.keep_one(crowded))) < 8


def test_substring_dedup(crowded):
    kept(substring_dedup.deduplicate(crowded, removed="removed_lines"))


def test_mixing(crowded):
    rest = [x for x in INSIDE if x != "weight"]
    mixed = mixing.mix(crowded, mixing.Target(repeats=2.0))
    kept(mixed, rest)
    kept(mixing.repeat(mixed, ["doc_id", *rest]), rest)


def test_sharding(crowded):
    kept(sharding.place(crowded))


def test_host_rules(crowded):
    kept(host_rules.judge(crowded, keep=("doc_id", *INSIDE)))


def test_maps(crowded):
    import numpy as np

    kept(quality_classifier.predict(crowded, np.zeros(1 << quality_classifier.BITS, np.float32)))
    kept(language_id.predict(crowded, language_id.fit(crowded, model_path())))
    kept(sentencepiece_codec.tokenize(crowded, model_path(), ids="packed", decoded="back"))
    kept(html_extraction.extract(crowded.withColumnRenamed("text", "html")))
    assert len(fingerprints.against_next(crowded).collect()) == 8


@pytest.mark.parametrize("stage", range(4))
def test_stages(spark, crowded, stage):
    import corpus_pipeline as cp

    out = cp.STAGES[stage][1](spark, crowded, SMALL)
    assert out.columns == crowded.columns
    kept(out)


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_written_tables_go(spark, tmp_path):
    import os

    mark = common.written()
    a, b = common.cut(spark.range(3)), common.cut(spark.range(4))
    common.drop(a)
    assert not os.path.exists(a._cut_path.removeprefix("file:")) and b.count() == 4
    common.clear(spark, mark, b)
    assert b.count() == 4
    common.clear(spark, mark)
    assert common.written() == mark
