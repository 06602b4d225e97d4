import collections

from helpers import SMALL
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lakewright.llm import mixing, sentencepiece_codec as sc
from lakewright.llm.common import cut
from lakewright.llm.queries import model_path
from test_language_id import many
from test_near import brute, plain_dedup, plain_passages


def test_stages_against_brute_force(spark, small):
    import sentencepiece

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    stages = dict(cp.STAGES)
    assert list(stages) == ["language_id", "jaccard_join", "substring_dedup", "mixing", "sentencepiece"]

    docs = cut(stages["language_id"](spark, docs, SMALL))
    assert docs.columns == columns and docs.count() == len(rows)  # every document has a language here

    comp = brute(rows)
    docs = cut(stages["jaccard_join"](spark, docs, SMALL))
    rows = {k: t for k, t in rows.items() if comp[k][1] == k}
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == set(rows)

    gone = plain_dedup(rows)
    docs = cut(stages["substring_dedup"](spark, docs, SMALL))
    rows = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in rows.items()}
    # Passages go after the lines: the words left are those of brute force, a text without passages is as it was.
    cut_words = plain_passages(rows)
    touched = {k for k, _ in cut_words}
    left = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert docs.columns == columns and {k: v for k, v in left.items() if k not in touched} == {k: (t, len(t)) for k, t in rows.items() if k not in touched}
    assert touched and all(left[k][0].split() == [w for i, w in enumerate(rows[k].split()) if (k, i) not in cut_words] and left[k][1] == len(left[k][0]) for k in touched)
    rows = {k: t for k, (t, _) in left.items()}

    want = {r.doc_id: r.n_copies for r in mixing.mix(docs, cp.MIX_TARGET, seed=cp.MIX_SEED).collect()}
    docs = cut(stages["mixing"](spark, docs, SMALL))
    assert docs.columns == columns and collections.Counter(r.doc_id for r in docs.collect()) == want and min(want.values()) >= 1

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
    out = stages["sentencepiece"](spark, docs, SMALL).collect()
    assert len(out) == sum(want.values())
    for r in out[:200]:
        assert sc.unpack(r.ids) == lib.encode(rows[r.doc_id], add_bos=True, add_eos=True) and r.n_tokens == len(r.ids) // 4


def test_run_is_the_stages(spark, small):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for number, (_, stage) in enumerate(cp.STAGES, 1):
        docs = cut(stage(spark, docs, SMALL))
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, cp.run(spark, SMALL).collect()))


def test_rejects_what_has_no_language(edge, spark):
    kept = cp.keep_known_language(spark, edge, SMALL)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5, 8})


def test_rejects_other_languages(spark, small):
    docs = many(spark.read.parquet(f"{SMALL}/documents.parquet"))
    other = {10**6: "Быстрая коричневая лиса прыгает через ленивую собаку и бежит в лес", 10**6 + 5: "wtv viludh lzd kxfng tbh mdztz sho hseiz wljblq wfpugiv nrnztb ovb tuweouj"}
    first = docs.limit(1)
    rows = [first.withColumn("doc_id", F.lit(k).cast("long")).withColumn("text", F.lit(t)).withColumn("lang", F.lit(None).cast("string")) for k, t in other.items()]
    kept = cp.keep_known_language(spark, docs.unionByName(rows[0]).unionByName(rows[1]), SMALL)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_empty(empty, spark):
    docs = empty
    for _, stage in cp.STAGES:
        docs = cut(stage(spark, docs, SMALL))
    assert docs.count() == 0


def test_last_stage_decodes(edge, spark):
    import hashlib

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
    out = cp.encode(spark, edge, SMALL).collect()
    assert len(out) == 12
    for r in out:
        assert r.decoded_md5 == hashlib.md5(lib.decode(sc.unpack(r.ids)).encode()).hexdigest(), r.doc_id
