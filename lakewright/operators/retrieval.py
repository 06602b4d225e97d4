"""Lexical and vector retrieval, rank fusion.

Scores over the whole table are plain projections, cut by a bounded top-k.  The k rows
of a retriever are fetched and go on as a table of literals with their positions, so
what follows (fusion, the pool, a listing of six) plans on a handful of rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scalars import distance_to, reciprocal_rank
from ..functions.text import lexemes, query_terms, trigrams
from . import fulltext
from .fulltext import PLAIN, ZETA2, Index

POOL, TOP = 30, 6


def top(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def positioned(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Few rows with their position from 0."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)


def ranking(rows: DataFrame, k: int, *order: Column | str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The first k rows with their position from 0, as a table of literals; k bounds what is fetched."""
    first = top(rows, k, *order).select(*(keep or rows.columns))
    held = first.collect()
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in first.schema] + [pa.field("position", pa.int32())]
    columns = [*zip(*held)] or [()] * len(first.columns)
    table = pa.table([pa.array(c, f.type) for c, f in zip([*columns, range(len(held))], fields)], schema=pa.schema(fields))
    return rows.sparkSession.createDataFrame(table)


def any_rank(doc: Column, terms: Column) -> Column:
    """Rank of a document for any of the terms: for each, plain weights damped by the square of their number.

    All weights being equal, the j-th occurrence adds w / j**2, over the limit of the
    sum; the mean over the terms is the rank.
    """

    def one(term):
        n = F.size(F.filter(doc, lambda w: w == term))
        total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
        return F.when(n > 0, PLAIN * total / ZETA2).otherwise(F.lit(0.0))

    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + one(t)) / F.greatest(F.size(terms), F.lit(1))


def all_rank(doc: Column, terms: Column) -> Column:
    """Rank of a document that has all terms: pairs of places of different terms, nearer ones counting more.

    A pair at distance d has weight sqrt(w * w / (1.005 + 0.05 * exp(d / 1.5 - 2))) and
    the weights combine as independent chances; a single term is ranked as any_rank.
    """
    placed = F.filter(F.transform(doc, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(terms, x["w"]))

    def nearness(d):
        return F.when(d > 100, F.lit(1e-30)).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2.0)))

    def pairs(x):
        later = F.filter(placed, lambda y: (y["i"] > x["i"]) & (y["w"] != x["w"]))
        return F.transform(later, lambda y: F.sqrt(PLAIN * PLAIN * nearness((y["i"] - x["i"]).cast("double"))))

    chances = F.flatten(F.transform(placed, pairs))
    combined = 1.0 - F.aggregate(chances, F.lit(1.0), lambda s, c: s * (1.0 - c))
    return F.when(F.size(terms) > 1, combined).otherwise(any_rank(doc, terms))


def _literals(spark, *columns: Column) -> list[Column]:
    """Arrays made of literals only, evaluated once, so that no row and no lambda makes them again."""
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [F.array(*[F.lit(x) for x in row[i]]) if row[i] else F.array().cast("array<string>") for i in range(len(columns))]


def lexical_tiers(index: Index, question: str, key: str = "slug") -> DataFrame:
    """(key, tier, score): 0 every word, 1 any meaningful word, 2 a like title; each key at its best tier."""
    found = fulltext.ranked(index, question)
    # Nine places, so that equal sums in another order are ties.
    precise = top(found.where("has_all").select("key", F.lit(0).alias("tier"), F.round("all_score", 9).alias("score")), 40, F.desc("score"), "key")
    loose = top(found.where("has_any").select("key", F.lit(1).alias("tier"), F.round("any_score", 9).alias("score")), 40, F.desc("score"), "key")
    (pieces,) = _literals(index.titles.sparkSession, trigrams(F.lit(question)))
    both = F.size(F.array_intersect("grams", pieces))
    like = both / (F.size("grams") + F.size(pieces) - both)  # the pieces of each are distinct
    fuzzy = top(index.titles.select("key", F.lit(2).alias("tier"), like.alias("score")).where("score > 0.25"), 20, F.desc("score"), "key")
    rows = precise.unionByName(loose).unionByName(fuzzy)
    best = rows.groupBy("key").agg(F.min(F.struct("tier", (-F.col("score")).alias("minus"))).alias("x"))
    return best.select(F.col("key").alias(key), "x.tier", (-F.col("x.minus")).alias("score"))


def lexical_candidates(index: Index, question: str, k: int = POOL, key: str = "slug") -> DataFrame:
    return top(lexical_tiers(index, question, key), k, "tier", F.desc("score"), key)


def vector_candidates(vectors: DataFrame, query: list[float], k: int = POOL, key: str = "slug", vector: str = "embedding") -> DataFrame:
    """(key, distance): the nearest vectors by cosine; rows without a vector do not take part."""
    near = vectors.where(F.col(vector).isNotNull()).select(key, F.round(distance_to(vector, query), 9).alias("distance"))
    return top(near, k, "distance", key)


def fuse(rankings: list[DataFrame], key: str = "slug", k: int = 60) -> DataFrame:
    """(key, score, list, position): ranked lists (key, position) combined by reciprocal ranks.

    Ties go to the key that the earlier list, or the earlier place in it, brought.
    """
    rows = None
    for number, ranking in enumerate(rankings):
        one = ranking.select(key, "position", F.lit(number).alias("list"))
        rows = one if rows is None else rows.unionByName(one)
    # Summed in list order, so that the score is the same on every run.
    terms = F.transform(F.array_sort(F.collect_list(F.struct("list", "position"))), lambda x: reciprocal_rank(x["position"], k))
    fused = rows.groupBy(key).agg(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("score"), F.min(F.struct("list", "position")).alias("first"))
    return fused.select(key, "score", F.col("first.list").alias("list"), F.col("first.position").alias("position"))


def fused_top(rankings: list[DataFrame], n: int = POOL, key: str = "slug") -> DataFrame:
    return top(fuse(rankings, key), n, F.desc("score"), "list", "position", key)


def lexical_overlap(terms: Column, text: Column) -> Column:
    """Share of a question's terms that a text has: a stand-in order, not a model's."""
    return F.size(F.array_intersect(terms, lexemes(text))) / F.greatest(F.size(terms), F.lit(1))


def rerank(pool: DataFrame, score: Column, k: int = TOP, order: str = "position") -> DataFrame:
    """The pool's best by a score, equal ones in the order they came."""
    return top(pool.withColumn("rerank_score", score), k, F.desc("rerank_score"), order)


def retrieve(catalogue: DataFrame, vectors: DataFrame, rules: DataFrame, question: str, query: list[float], document: Column, k: int = TOP, pool: int = POOL, reranked: bool = False, index: Index | None = None) -> DataFrame:
    """The fused best of lexical, catalogue-vector and rule-vector retrieval, with their titles.

    `index` is a written full-text index of the catalogue; without one it is computed for
    this question.  Without a reranker the fused order stands.
    """
    index = index or fulltext.describe(catalogue.select("slug", "title", document.alias("__doc")), "slug", F.col("__doc"), "title")
    near = lambda v: ranking(vector_candidates(v, query, pool), pool, "distance", "slug")
    with ThreadPoolExecutor(3) as at_once:  # the retrievers do not wait for each other
        lex = at_once.submit(lambda: ranking(lexical_tiers(index, question), pool, "tier", F.desc("score"), "slug"))
        lists = [lex, at_once.submit(near, vectors), at_once.submit(near, rules)]
        lists = [x.result() for x in lists]
    fused = ranking(fuse(lists), pool, F.desc("score"), "list", "position", "slug", keep=("slug", "score"))
    slugs = [r.slug for r in fused.select("slug").collect()]
    if reranked:
        (terms,) = _literals(catalogue.sparkSession, query_terms(F.lit(question)))
        rows = catalogue.where(F.col("slug").isin(slugs)).select("slug", "title", document.alias("__doc"))
        rows = rerank(rows.join(F.broadcast(fused), "slug"), lexical_overlap(terms, F.col("__doc")), k)
    else:
        rows = index.titles.where(F.col("key").isin(slugs)).withColumnRenamed("key", "slug").join(F.broadcast(fused), "slug")
    return top(rows, k, *([F.desc("rerank_score")] if reranked else []), "position").select("slug", "title", F.round("score", 9).alias("score"), "position")


def in_order(rows: DataFrame, keys: list[str], key: str = "slug", missing: int = 999) -> DataFrame:
    """rows with their place in a list of keys; those not in it are last."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col(key)) - 1
    return rows.withColumn("place", F.when(place >= 0, place).otherwise(missing))
