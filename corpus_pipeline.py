"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; its result is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of their input.  A stage is judged by its own input and reads no other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewright.llm import jaccard_join, language_id, mixing, sentencepiece_codec, substring_dedup
from lakewright.llm.common import clear, cut, own_name, table, written
from lakewright.llm.queries import MIX_SEED, MIX_TARGET, learned_languages, model_path

#: Documents whose language is unknown or less likely than this are rejected.
MIN_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language: no letters, or likelier in none than in any learned one."""
    lang, score = own_name(docs, "lang"), own_name(docs, "score")
    found = language_id.predict(docs, language_id.open_set(learned_languages(docs)), lang_pred=lang, score=score)
    return found.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of least id stays."""
    return jaccard_join.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut paragraphs, and passages of 50 words or more wherever they stand, that occur before; n_chars follows the text."""
    left = substring_dedup.deduplicate(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that source shares meet the target; none is dropped."""
    names = tuple(own_name(docs, c) for c in mixing.NEW)
    return mixing.repeat(mixing.mix(docs, MIX_TARGET, seed=MIX_SEED, names=names), docs.columns, names[-1])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with begin and end, packed as little-endian unsigned 32-bit integers, and the md5 of the text they decode to."""
    coded = sentencepiece_codec.tokenize(docs.select("doc_id", "source", "text"), model_path(), decoded="decoded")
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.md5("decoded").alias("decoded_md5"))


STAGES = [
    ("language_id", keep_known_language),
    ("jaccard_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL cannot express a learned language model or MinHash; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), written()
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs)
            clear(spark, mark, docs)  # what the stage wrote on its way, and its input
    return docs
