"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct five-word shingles.  Two documents link when
100 * intersection >= PERCENT * union; the symmetric difference of linked sets of
sizes x and y is at most (x + y) * (100 - PERCENT) / (100 + PERCENT).

Candidates.  Size bands overlap so that any two linkable sizes share one.  In a band
with bound d every set is sketched: shingles are dealt to 2 d + 2 parts by their hash
and each part is the XOR of its shingles' hashes.  A shingle in just one of two sets
changes one part, so the number of parts in which two sketches differ, their Hamming
distance over parts, is at most the symmetric difference, and linked sets agree in all
but d parts.  By the pigeonhole principle two such sketches share an entry among the
first d + 1 of a fixed order; the order puts parts that are not empty first, so empty
parts serve as keys for the few sets that have too few others.  Those d + 1 entries
are the keys; near.link() verifies what collides and finds components.

Exact copies are reduced to their least id beforehand and take its component.

Defined cases: texts without words and null texts have an empty set, link with nothing
and are their own component; a null id passes with a null component and, unless
another document has the same text, size 0; rows of one id are one node; other columns
are ignored by components() and pass through keep_one(), whatever their names.  An empty
table gives an empty result.

Scale: keys are about 0.4 a shingle, packed; a key held by many yields a star, not
pairs.  Copies are counted, and only their narrow rows are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import near, shingles as sh
from .common import bounded_broadcast, cut, drop, own_name, packs, partitions, small_batches

U = np.uint64
PERCENT = 80
FEW_COPIES = 2_000_000
#: Documents packed together; places of ids in a pack fit 16 bits.
PACK = 2048


def bands(upto: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(lo, end, d): any x <= y with 100 x >= percent y lie in the band where x is in [lo, next lo)."""
    out, lo = [], 1
    while lo <= upto:
        following = max(lo + 1, lo * 8 // 5)
        end = (following - 1) * 100 // percent + 1
        out.append((lo, end, sh.distance_bound(following - 1, end - 1, percent)))
        lo = following
    return out


_BANDS: dict[int, list[tuple[int, int, int]]] = {}


def keys_of(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys of a set of shingle hashes, over all its bands."""
    n, out = len(s), []
    if not n:
        return np.zeros(0, U)
    known = _BANDS.get(percent, [])
    if not known or known[-1][0] <= n:
        known = _BANDS[percent] = bands(2 * n + 64, percent)
    for number, (lo, end, d) in enumerate(known):
        if lo > n:
            break
        if end <= n:
            continue
        parts = 2 * d + 2
        to = ((s >> U(33)) % U(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to = to[order]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        value = np.bitwise_xor.reduceat(s[order], first)
        at = to[first][value != 0][: d + 1]
        value = value[value != 0][: d + 1]
        if len(at) <= d:  # too few parts hold anything: empty ones follow, by place
            empty = np.setdiff1d(np.arange(parts), at)[: d + 1 - len(at)]
            at, value = np.r_[at, empty], np.r_[value, np.zeros(len(empty), U)]
        out.append(sh.mix(value ^ sh.mix(at.astype(U) * U(4096) + U(number + 1))))
    return np.concatenate(out)


def _pack(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """Packed keys and sizes of (id, text), for n tasks."""
    buckets = near.BUCKETS * n

    def run(batches):
        salt = 0
        for part in packs(batches, PACK):
            ids = np.array(part.column("id").to_pylist(), np.int64)
            sizes, keys = np.zeros(len(ids), np.int64), []
            for k, t in enumerate(part.column("text").to_pylist()):
                s = sh.shingle_set(t)
                sizes[k] = len(s)
                keys.append(keys_of(s, percent))
            places = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
            salt += 1
            made = near.packed_rows(np.concatenate(keys), places, ids, sizes, buckets, salt * 7 + int(ids[0]))
            if made is not None:
                yield made

    return docs.select("id", "text").mapInArrow(run, near.PACKED_DDL)


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of df."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    narrow = cut(docs.select("id", F.md5(F.col("text").cast("binary")).alias("h")))
    classes = cut(narrow.where("id is not null").groupBy("h").agg(F.min("id").alias("rep"), F.max("id").alias("last")))
    copies = narrow.where("id is not null").join(classes.where("rep <> last"), "h").where("id <> rep").select("id").distinct()
    # An id that also stands for another text must stay.
    copies = copies.join(classes.select(F.col("rep").alias("id")), "id", "left_anti")
    docs = docs.where("id is not null")
    copies = cut(copies)
    originals = docs.join(bounded_broadcast(copies, FEW_COPIES), "id", "left_anti")
    n = partitions(originals)
    met = near.collide(_pack(originals, percent, n), n)
    comps = near.link(met, lambda ids: near.lookup(docs, ids), percent)
    drop(copies)
    sizes = met.where(F.col("kind") == near.SIZE).groupBy(F.col("a").alias("rep")).agg(F.max("b").alias("n"))
    known = classes.join(sizes, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("h", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("comp", "rep").alias("comp"))
    out = narrow.join(known, "h", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.col("comp"))
    return out.select(F.col("id").alias("doc_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), component.cast("long").alias("component_id"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Rows of df whose document is the least id of its component; null ids stay."""
    gone = own_name(df, "gone")
    others = cut(components(df, doc_id, text, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct())
    return df.join(bounded_broadcast(others, FEW_COPIES), F.col(f"`{doc_id}`") == F.col(gone), "left_anti")
