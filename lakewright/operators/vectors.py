"""An index of vectors by cells, read by the cells that a question can need.

A bounded sample of the vectors is clustered by direction; every vector goes to its
nearest centre, and the cells are folders of files, so that a search prunes by folder.
Beside them lies one row a cell: its centre and its radius, the largest angle between
the centre and a member.  Angles obey the triangle inequality: nothing in a cell is
nearer to a question than the angle to the centre less the radius.

A search reads the nearest cells first.  An approximate one stops there, as a graph
index does; how many it reads is measured when the index is written, so that questions
drawn from the sample find the share RECALL of their true neighbours in it.  An exact
one goes on to every other cell whose bound lies within the k-th distance found.  Both
depend on the vectors: where clusters are clear a few cells do, where directions are
all alike it takes most of them, and a search then costs what a full scan costs.

Defined cases: null vectors and vectors of length zero have no direction and are not
indexed; an empty table gives an index of no cells, which finds nothing; equal
distances are ordered by key.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import cosine_distance, distance_to, dot
from ..shared import cut

#: Vectors that the centres are learned from, about; drawn by a hash of the key.
SAMPLE = 50_000
#: Cells at most.  Centres travel to every task: so many rows of one vector each.
MOST_CELLS = 4096
ROUNDS, SEED = 10, 11
#: Share of the true neighbours that an approximate search is set to find, by so many questions and neighbours.
RECALL, QUESTIONS, NEIGHBOURS = 0.95, 100, 30
#: Angles and distances are compared with this much room for rounding.
ROOM = 1e-6


class VectorIndex(NamedTuple):
    members: DataFrame  #: key, embedding, cell
    cells: DataFrame  #: cell, center, radius (an angle), n, probes (of the whole index)


def write(vectors: DataFrame, path: str, key: str = "slug", vector: str = "embedding", cells: int | None = None) -> None:
    """Cells in folders, and one row a cell; by default as many cells as the root of the vectors' number."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("embedding"))
    rows = rows.where(F.col("embedding").isNotNull()).where(dot("embedding", "embedding") > 0)
    n = rows.count()
    k = cells or min(MOST_CELLS, math.isqrt(n))
    if k < 2:  # one cell; its centre may be any member
        centers, probes = [r.embedding for r in rows.select("embedding").limit(1).collect()], 1
        placed = rows.withColumn("cell", F.lit(0))
    else:
        drawn = rows.where(F.pmod(F.xxhash64("key"), F.lit(2**20)) < min(1.0, SAMPLE / n) * 2**20)
        features = array_to_vector(F.col("embedding").cast("array<double>"))
        sample = cut(drawn.select("embedding"))
        model = KMeans(k=k, seed=SEED, maxIter=ROUNDS, distanceMeasure="cosine", predictionCol="cell").fit(sample.select(features.alias("features")))
        centers = [c / np.linalg.norm(c) for c in model.clusterCenters()]  # at most MOST_CELLS rows
        probes = _probes(np.array(sample.orderBy(F.xxhash64("embedding")).toArrow().column("embedding").to_pylist()), np.array(centers))
        placed = model.transform(rows.withColumn("features", features)).drop("features")
    placed.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/members")
    known = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cell int, center array<double>")
    members = _members(spark, path, rows.schema["key"].dataType.simpleString())
    met = members.join(F.broadcast(known), "cell")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - cosine_distance("embedding", "center"))))
    sums = met.groupBy("cell").agg(F.max(angle).alias("radius"), F.count(F.lit(1)).alias("n"))
    sums.join(F.broadcast(known), "cell").select("cell", "center", "radius", "n", F.lit(probes).alias("probes")).coalesce(1).write.parquet(f"{path}/cells")


def _probes(sample: np.ndarray, centers: np.ndarray) -> int:
    """Nearest cells that hold the share RECALL of the neighbours of questions, both of the sample.

    The whole table has nearer neighbours than its sample, which more often share a cell
    with the question: the recall there is no worse.
    """
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    asked = sample[:QUESTIONS]
    likeness = asked @ sample.T
    likeness[np.arange(len(asked)), np.arange(len(asked))] = -np.inf  # not itself
    few = min(NEIGHBOURS, len(sample) - 1)
    if few < 1:
        return len(centers)
    nearest = np.argpartition(-likeness, few - 1, axis=1)[:, :few]
    own = (sample[nearest.ravel()] @ centers.T).argmax(axis=1).reshape(nearest.shape)
    place = np.argsort(np.argsort(-(asked @ centers.T), axis=1), axis=1)
    places = np.sort(np.take_along_axis(place, own, axis=1).ravel())
    return int(places[math.ceil(RECALL * len(places)) - 1]) + 1


def _members(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.schema(f"key {key}, embedding array<float>, cell int").parquet(f"{path}/members")


def read(spark: SparkSession, path: str, key: str = "string") -> VectorIndex:
    """An index that write() has left, whose key has the type given."""
    return VectorIndex(_members(spark, path, key), spark.read.schema("cell int, center array<double>, radius double, n long, probes int").parquet(f"{path}/cells"))


def search(index: VectorIndex, query: list[float], k: int = 30, exact: bool = True, probes: int | None = None, key: str = "slug") -> DataFrame:
    """(key, distance) of the k nearest by cosine, or with `exact` unset of those in the nearest cells.

    Cells are read nearest first, `probes` of them (by default as many as the index has
    measured) and more until they hold k vectors.
    """
    held = index.cells.collect()  # a row a cell, at most MOST_CELLS
    if not held:
        return _nearest(index.members.limit(0), query, k, key)
    centers, asked = np.array([r.center for r in held]), np.array(query, float)
    cos = centers @ asked / (np.linalg.norm(centers, axis=1) * np.linalg.norm(asked))
    angle = np.arccos(np.clip(cos, -1, 1))
    least = 1 - np.cos(np.maximum(0, angle - np.array([r.radius for r in held]) - ROOM))
    order = np.argsort(angle, kind="stable")
    holds = np.cumsum([held[i].n for i in order])
    first = max(probes or held[0].probes, int(np.searchsorted(holds, k)) + 1)
    near = _nearest(_in(index, [held[i].cell for i in order[:first]]), query, k, key)
    if not exact or first >= len(held):
        return near
    found = near.collect()  # k rows
    within = found[-1].distance + ROOM if len(found) == k else math.inf
    rest = [held[i].cell for i in order[first:] if least[i] <= within]
    near = near.sparkSession.createDataFrame(found, near.schema)
    if not rest:
        return near
    return near.unionByName(_nearest(_in(index, rest), query, k, key)).orderBy("distance", key).limit(k)


def _in(index: VectorIndex, cells: list[int]) -> DataFrame:
    return index.members.where(F.col("cell").isin(sorted(cells)))


def _nearest(rows: DataFrame, query: list[float], k: int, key: str) -> DataFrame:
    near = rows.select(F.col("key").alias(key), F.round(distance_to("embedding", query), 9).alias("distance"))
    return near.orderBy("distance", key).limit(k)
