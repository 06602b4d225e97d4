"""English full text: an index of postings and stems, and the ranks that read it.

An index has three tables.  Postings hold each word of each document with its places,
in buckets of files by word; they are grouped inside the row, so building them shuffles
finished rows once.  The vocabulary holds each word once with its stem (none for a stop
word): stems are made for distinct words only.  Titles hold what a listing shows.

A question's words become stems, a stem's words are looked up in the vocabulary, and
only their buckets and rows are read: the texts are not.  Titles keep their trigrams
beside them, so a likeness is one intersection.  The two ranks are those of a
text search without weights, written from their published formula.
"""

from __future__ import annotations

import math
import re
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.bags import with_places
from ..functions.stemming import STOP, lexeme, lexeme_of
from ..functions.text import DOUBLE, NOISE, lexemes, trigrams

# --- Fixed values: the weight of a word without a label, the limit of the sum of inverse squares, what is kept of a word's places. ---
PLAIN, ZETA2 = 0.1, 1.64493406685
MOST_PLACES, LAST_PLACE = 255, 16_383
# --- End of fixed values. ---
#: Folders of postings; inside one, files are sorted by word and split by size.
BUCKETS = 32
#: Words of the stems asked for that are named to the scan one by one; more are joined.
MOST_FORMS = 2000


class Index(NamedTuple):
    postings: DataFrame  #: bucket, term, key, places (from 1)
    vocabulary: DataFrame  #: term, stem
    titles: DataFrame  #: key, title, grams (its distinct three-character pieces)


def postings(documents: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, key, places): every word of every document with its places from 0."""
    words = documents.select(F.col(f"`{key}`").alias("key"), lexemes(text).alias("words"))
    # explode() would have the optimizer filter on the size of `found` at the scan, where its steps are made again for every word.
    placed = with_places(words, "words", "found").select("key", F.explode_outer("found").alias("x")).where("x is not null")
    return placed.select("x.term", F.col("key").alias(key), "x.places")


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def describe(documents: DataFrame, key: str, text: Column, title: str) -> Index:
    """The index of a frame as a plan: nothing is written, every question computes it again."""
    placed = postings(documents, key, text).withColumnRenamed(key, "key")
    # A place beyond the last counts as the last; of a word's places the first ones are kept.
    kept = F.slice(F.transform("places", lambda p: F.least(p + 1, F.lit(LAST_PLACE))), 1, MOST_PLACES)
    rows = placed.select((F.crc32("term") % BUCKETS).cast("int").alias("bucket"), "term", "key", kept.alias("places"))
    words = rows.select("term").distinct().select("term", lexeme(F.col("term")).alias("stem"))
    return Index(rows, words, documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{title}`").alias("title"), trigrams(F.col(f"`{title}`")).alias("grams")))


def write(index: Index, path: str) -> None:
    """Postings in folders by bucket, sorted by word; words sorted by stem; titles."""
    spark = index.postings.sparkSession
    rows = index.postings.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term")
    rows.write.partitionBy("bucket").parquet(f"{path}/postings")
    held = _postings(spark, path, index.postings.schema["key"].dataType.simpleString())
    words = held.select("term").distinct().select("term", lexeme(F.col("term")).alias("stem"))
    words.repartition("stem").sortWithinPartitions("stem").write.parquet(f"{path}/vocabulary")
    index.titles.write.parquet(f"{path}/titles")


def _postings(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.schema(f"term string, key {key}, places array<int>, bucket int").parquet(f"{path}/postings")


def read(spark: SparkSession, path: str, key: str = "string") -> Index:
    """An index that write() has left, whose key has the type given."""
    vocabulary = spark.read.schema("term string, stem string").parquet(f"{path}/vocabulary")
    titles = spark.read.schema(f"key {key}, title string, grams array<string>").parquet(f"{path}/titles")
    return Index(_postings(spark, path, key), vocabulary, titles)


def every_term(question: str) -> list[str]:
    """Distinct stems of a question's words, stop words left out."""
    return [s for s in dict.fromkeys(map(lexeme_of, re.findall(r"[^\W_]+", question.lower()))) if s]


def some_terms(question: str, limit: int = 12) -> list[str]:
    """Distinct stems of its meaningful words: letters only, longer than two, no noise words, the first `limit`."""
    words = [w for w in re.findall(r"[^\W\d_]+", question.lower()) if len(w) > 2 and w not in NOISE]
    return [s for s in dict.fromkeys(map(lexeme_of, list(dict.fromkeys(words))[:limit])) if s]


def hits(index: Index, stems: list[str]) -> DataFrame:
    """(key, found): for each document with any of the stems, structs (stem, places), one a word."""
    forms = index.vocabulary.where(F.col("stem").isin(stems))
    named = forms.limit(MOST_FORMS + 1).collect() if stems else []
    if len(named) <= MOST_FORMS:
        of = {r.term: r.stem for r in named}
        rows = index.postings.where(F.col("bucket").isin(sorted({_bucket(t) for t in of})) & F.col("term").isin(sorted(of)))
        stem = F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("term")) if of else F.lit(None).cast("string")
    else:
        rows, stem = index.postings.join(forms, "term"), F.col("stem")
    return rows.groupBy("key").agg(F.collect_list(F.struct(stem.alias("stem"), "places")).alias("found"))


def places_of(found: Column, stem: str) -> Column:
    """Where a stem's words stand, in order, the first MOST_PLACES of them."""
    own = F.transform(F.filter(found, lambda x: x["stem"] == stem), lambda x: x["places"])
    return F.slice(F.array_sort(F.flatten(own)), 1, MOST_PLACES)


def any_rank(places: list[Column]) -> Column:
    """Mean over the terms; the j-th place of a term adds PLAIN / j**2, over the limit of the sum."""

    def one(p: Column) -> Column:
        squares = F.aggregate(p, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("j")), lambda a, _: F.struct((a["s"] + 1.0 / ((a["j"] + 1) * (a["j"] + 1))).alias("s"), (a["j"] + 1).alias("j")))
        return F.when(F.size(p) > 0, PLAIN * squares["s"] / ZETA2).otherwise(F.lit(0.0))

    return sum((one(p) for p in places), F.lit(0.0)) / max(1, len(places))


#: ln(1 - weight) of a pair of places by their distance, nearer ones counting more; none for a place with itself, the last for all beyond.
NEAR = [0.0, *[math.log1p(-PLAIN * math.sqrt(1.0 / (1.005 + 0.05 * math.exp(d / 1.5 - 2.0)))) for d in range(1, 101)], math.log1p(-PLAIN * math.sqrt(1e-30))]


@pandas_udf(DOUBLE)
def _all_rank(terms: pd.Series) -> pd.Series:
    """Places of each term, in lists: pairs are counted by distance, not multiplied one by one."""
    logs = np.array(NEAR)

    def one(lists) -> float | None:
        if any(p is None for p in lists):
            return None
        at, apart = [np.asarray(p, np.int64) for p in lists], np.zeros(len(NEAR))
        for i in range(1, len(at)):
            for k in range(i):
                apart += np.bincount(np.minimum(np.abs(at[i][:, None] - at[k]), len(NEAR) - 1).ravel(), minlength=len(NEAR))
        return -math.expm1(float(apart @ logs))

    return terms.map(one)


def all_rank(places: list[Column]) -> Column:
    """Pairs of places of different terms as independent chances; a single term is ranked as any_rank."""
    if len(places) < 2:
        return any_rank(places)
    return _all_rank(F.array(*places))


def ranked(index: Index, question: str) -> DataFrame:
    """(key, has_all, has_any, all_score, any_score) of documents with any of a question's terms."""
    every, some = every_term(question), some_terms(question)
    stems = list(dict.fromkeys(every + some))
    rows = hits(index, stems).select("key", *[places_of(F.col("found"), s).alias(f"p{i}") for i, s in enumerate(stems)])
    at = {s: F.col(f"p{i}") for i, s in enumerate(stems)}
    has = lambda terms, empty: [F.size(at[s]) > 0 for s in terms] or [F.lit(empty)]
    both, either = F.lit(True), F.lit(False)
    for c in has(every, False):
        both = both & c
    for c in has(some, False):
        either = either | c
    return rows.select("key", both.alias("has_all"), either.alias("has_any"), F.when(both, all_rank([F.when(both, at[s]) for s in every])).alias("all_score"), any_rank([at[s] for s in some]).alias("any_score"))


__all__ = ["STOP", "Index", "all_rank", "any_rank", "describe", "every_term", "hits", "places_of", "postings", "ranked", "read", "some_terms", "write"]
