"""Linking of texts by colliding keys: candidates, exact verification, components.

An operator deals (key, id) entries so that any two texts that may link share a key.
Entries travel as packed arrays, one row a key bucket and batch, sorted by bucket: a
task holds the entries of one bucket at a time and returns, for each key held by
several ids, a star of pairs around the least id, and for keys held by three or more
the group itself.  So candidates grow with the entries, never with the square of a
group.

Round one verifies the stars: a parity sketch of each text rejects most pairs, since
its Hamming distance never exceeds the symmetric difference, and the rest are compared
shingle by shingle.  Links form components.  Round two returns to the groups whose
members lie in different components and compares the sketches of those pairs, block by
block inside a task.  A block in which few pairs pass returns them all; one in which
many do returns each member's nearest partner and its group's name.  Round three takes
the groups so named, with their texts: a task compares the shingles of the pairs that
pass and returns only links that join two components, fewer than it has members.
No pair that shares a key is lost: it is linked, rejected by an exact test, or lies in
one component already.  Rows grow with the members times the blocks they meet, never
with the pairs.

Shingles are compared by their 64-bit hashes (see shingles).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shingles as sh
from .common import bounded_broadcast, cut, drop, partitions, slices, small_batches
from .components import components

U = np.uint64
#: Rows of ids up to which a lookup side is broadcast (8 bytes each); beyond, shuffled.
FEW_IDS = 1_000_000
#: Members of a group that one comparison block holds, and shingles where their texts come along.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000
#: Likely pairs that a block returns for each of its members; with more it names its group again.
PAIRS = 2

PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary()), ("places", pa.binary()), ("ids", pa.binary())])
PACKED_DDL = "bucket int, kind tinyint, keys binary, places binary, ids binary"
MET = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])
MET_DDL = "kind tinyint, a long, b long"
SIZE, STAR, GROUP = 0, 1, 2


def packed_rows(keys: np.ndarray, places: np.ndarray, ids: np.ndarray, sizes: np.ndarray | None, buckets: int, salt: int) -> pa.RecordBatch | None:
    """Rows of one batch: entries (keys[i], ids[places[i]]) by bucket; sizes by id ride along."""
    rows = []
    if sizes is not None and len(ids):
        rows.append((salt % buckets, SIZE, sizes.astype("<i8").tobytes(), b"", ids.astype("<i8").tobytes()))
    if len(keys):
        to = (keys >> U(20)) % U(buckets)
        order = np.argsort(to, kind="stable")
        keys, places, to = keys[order], places[order], to[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(to) != 0])
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(to)]):
            used, at = np.unique(places[lo:hi], return_inverse=True)
            rows.append((int(to[lo]), STAR, keys[lo:hi].astype("<u8").tobytes(), at.astype("<u4" if len(used) > 65_535 else "<u2").tobytes(), ids[used].astype("<i8").tobytes()))
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PACKED)], schema=PACKED)


def _meet(keys: np.ndarray, ids: np.ndarray) -> Iterable[pa.RecordBatch]:
    """Stars and groups of the keys held by several ids."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    own = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]
    keys, ids = keys[own], ids[own]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    shared = np.repeat(size > 1, size)
    ids, size = ids[shared], size[size > 1]
    if not len(size):
        return
    start = np.r_[0, np.cumsum(size)[:-1]]
    hub, group = np.repeat(ids[start], size), np.repeat(np.arange(len(size)), size)
    pairs = np.unique(np.stack([hub, ids], 1)[hub != ids], axis=0)
    yield _met(STAR, pairs[:, 0], pairs[:, 1])
    # Many keys are shared by the same ids: one group for each list of members.
    h = sh.mix(ids.astype(U))
    name = sh.mix(np.add.reduceat(h, start) + sh.mix(np.bitwise_xor.reduceat(h, start)))
    first = np.zeros(len(size), bool)
    first[np.unique(name, return_index=True)[1]] = True
    keep = np.repeat(first & (size > 2), size)
    yield _met(GROUP, name[group[keep]].view(np.int64), ids[keep])


def _met(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], schema=MET)


def collide(packed: DataFrame, n: int) -> DataFrame:
    """(kind, a, b) from n tasks: SIZE rows (id, size), STAR rows (hub, member), GROUP rows (group, member)."""

    def run(batches):
        held, keys, ids = None, [], []
        for batch in batches:
            for bucket, kind, k, at, i in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "keys", "places", "ids"))):
                i = np.frombuffer(i, "<i8")
                if kind == SIZE:
                    yield _met(SIZE, i, np.frombuffer(k, "<i8"))
                    continue
                if bucket != held and keys:
                    yield from _meet(np.concatenate(keys), np.concatenate(ids))
                    keys, ids = [], []
                held, k = bucket, np.frombuffer(k, "<u8")
                keys.append(k)
                ids.append(i[np.frombuffer(at, "<u4" if len(at) == 4 * len(k) else "<u2")])
        if keys:
            yield from _meet(np.concatenate(keys), np.concatenate(ids))

    return cut(by_bucket(packed, n).mapInArrow(run, MET_DDL))


def by_bucket(packed: DataFrame, n: int) -> DataFrame:
    """Rows dealt to n tasks and sorted by bucket."""
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket")


#: Key buckets a task, whose entries it holds one after another.
BUCKETS = 8


TextsOf = Callable[[DataFrame], DataFrame]


def _sketches(texts: DataFrame) -> DataFrame:
    """(id, n, sketch) of (id, text)."""
    out = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary())])

    def run(batches):
        for batch in slices(batches):
            sets = [sh.shingle_set(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int32()), pa.array([sh.parity_sketch(s) for s in sets], pa.binary())], schema=out)

    return cut(texts.select("id", "text").mapInArrow(run, "id long, n int, sketch binary"))


def _words(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, "<u8")


def _may_link(n_a: int, x: np.ndarray, n_b: int, y: np.ndarray, percent: int) -> bool:
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b) or not n_a or not n_b:
        return False
    width = min(len(x), len(y))
    return int(np.bitwise_count(sh.fold(x, width) ^ sh.fold(y, width)).sum()) <= sh.distance_bound(n_a, n_b, percent)


def _sketch_filter(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""
    side = lambda k: sketches.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    near = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    met = pairs.join(side("b"), "b").join(side("a"), "a").where(near)
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in slices(batches, 4096):
            cols = (batch.column(c).to_pylist() for c in ("n_a", "sketch_a", "n_b", "sketch_b"))
            keep = pa.array([_may_link(n, _words(x), m, _words(y), percent) for n, x, m, y in zip(*cols)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=out).filter(keep)

    return met.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, texts_of: TextsOf, percent: int) -> DataFrame:
    """Pairs (a, b) that link, by their shingles."""
    pairs = cut(pairs.distinct())
    texts = texts_of(_endpoints(pairs))
    side = lambda k: texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        last, own = None, None
        for batch in slices(batches):
            keep = []
            for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b"))):
                if last is None or last != (a, x):
                    last, own = (a, x), sh.shingle_set(x)
                keep.append(sh.similar(own, sh.shingle_set(y), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=out).filter(pa.array(keep, pa.bool_()))

    links = cut(met.mapInArrow(run, "a long, b long").distinct())
    drop(pairs)
    return links


def _endpoints(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def colliding(met: DataFrame) -> DataFrame:
    """Distinct ids that share a key with another; link() asks for the texts of no others."""
    return cut(_endpoints(met.where(F.col("kind") == STAR).select("a", "b")))


def _dealt(groups: DataFrame, comps: DataFrame, sketches: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Members of groups of several components, dealt to the blocks in which every two of them meet.

    A group's members lie side by side, so its least and largest component combine
    before the shuffle.  Names of groups and components are broadcast while they are few;
    a group may be a large share of all members, which then stay where they are.
    """
    known = bounded_broadcast(comps, FEW_IDS)
    named = groups.join(known, groups["b"] == known["id"], "left").select(F.col("a").alias("gid"), F.col("b").alias("id"), F.coalesce("comp", "b").alias("comp"))
    open_ = cut(named.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gid"))
    members = cut(named.join(bounded_broadcast(open_, FEW_IDS), "gid", "left_semi").distinct().join(sketches.select("id", "n"), "id"))
    sizes = cut(members.groupBy("gid").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles")))
    dealt = members.drop("n").join(bounded_broadcast(sizes, FEW_IDS), "gid").join(sketches, "id")
    blocks = F.ceil(F.col("m") / BLOCK)
    if texts is not None:
        dealt = dealt.join(texts.select("id", "text"), "id")
        blocks = F.greatest(blocks, F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    dealt = dealt.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("gid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp", "n", "sketch", *["text"] * (texts is not None))
    return dealt.repartition(partitions(groups), "gid", "i", "j").sortWithinPartitions("gid", "i", "j")


def _by_block(batches, columns: tuple[str, ...], take=lambda row: row):
    """(gid, i, j, rows) of every block, from rows sorted so."""
    held, rows = None, []
    for batch in slices(batches):
        for gid, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("gid", "i", "j", *columns))):
            if (gid, i, j) != held:
                if len(rows) > 1:
                    yield *held, rows
                held, rows = (gid, i, j), []
            rows.append(take(row))
    if len(rows) > 1:
        yield *held, rows


class _Block:
    """Members of one block by their number of shingles, and the pairs whose sketches allow a link."""

    def __init__(self, i: int, j: int, own, ids, comp, n, sketches, percent: int):
        self.order = np.argsort(np.array(n, np.int64), kind="stable")
        self.own, self.ids, self.comp, self.n = (np.array(x, np.int64)[self.order] for x in (own, ids, comp, n))
        self.words = [_words(sketches[k]) for k in self.order]
        self.one, self.percent = i == j, percent

    def pairs(self):
        """(k, partners, gaps): places of partners behind k, of another component."""
        width_of = np.array([len(w) for w in self.words])
        folded, row_of = {}, np.zeros(len(self.ids), np.int64)
        for k in range(len(self.ids)):
            # sorted by size: partners of k behind it, as far as sizes allow
            upto = np.searchsorted(self.n, self.n[k] * 100 // self.percent, side="right")
            more = np.arange(k + 1, upto)
            more = more[self.comp[more] != self.comp[k]]
            if not self.one:
                more = more[self.own[more] != self.own[k]]
            if not len(more) or not self.n[k]:
                continue
            width = len(self.words[k])
            if width not in folded:  # partners are at most a quarter larger, so at most twice as wide
                some = np.flatnonzero((width_of == width) | (width_of == 2 * width))
                folded = {width: np.stack([sh.fold(self.words[x], width) for x in some])}
                row_of[some] = np.arange(len(some))
            gap = np.bitwise_count(folded[width][row_of[more]] ^ self.words[k]).sum(axis=1, dtype=np.int64)
            may = gap <= sh.distance_bound(self.n[more], self.n[k], self.percent)
            if may.any():
                yield k, more[may], gap[may]


PAIR, AGAIN = 0, 1


def _likely(groups: DataFrame, comps: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(kind, a, b): PAIR rows of two components, AGAIN rows (gid) of groups with more than those."""

    def run(batches):
        for gid, i, j, rows in _by_block(batches, ("own", "id", "comp", "n", "sketch")):
            block = _Block(i, j, *zip(*rows), percent)
            kept, total, most = [], 0, PAIRS * len(rows)
            least, partner = np.full(len(rows), 2**31), np.zeros(len(rows), np.int64)
            for k, more, gap in block.pairs():
                total += len(more)
                if total <= most:
                    kept.append((np.full(len(more), k), more))
                better = gap < least[more]
                least[more[better]], partner[more[better]] = gap[better], k
                best = int(gap.argmin())
                if gap[best] < least[k]:
                    least[k], partner[k] = gap[best], more[best]
            if not total:
                continue
            if total <= most:
                x, y = (np.concatenate(c) for c in zip(*kept))
            else:
                x = np.flatnonzero(least < 2**31)
                y = partner[x]
                yield _met(AGAIN, np.array([gid]), np.array([gid]))
            x, y = block.ids[x], block.ids[y]
            yield _met(PAIR, np.minimum(x, y), np.maximum(x, y))

    return cut(_dealt(groups, comps, sketches).mapInArrow(run, MET_DDL))


def _spanning(groups: DataFrame, comps: DataFrame, sketches: DataFrame, texts_of: TextsOf, percent: int) -> DataFrame:
    """(a, b): verified links that join the components of each block, by comparing all its pairs."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        take = lambda row: (*row[:-1], sh.shingle_set(row[-1]))
        for _, i, j, rows in _by_block(batches, ("own", "id", "comp", "n", "sketch", "text"), take):
            *cols, sets = zip(*rows)
            block = _Block(i, j, *cols, percent)
            sets = [sets[k] for k in block.order]
            root = {c: c for c in block.comp.tolist()}

            def find(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            links = []
            for k, more, _ in block.pairs():
                for x in more.tolist():
                    p, q = find(int(block.comp[k])), find(int(block.comp[x]))
                    if p != q and sh.similar(sets[k], sets[x], percent):
                        root[max(p, q)] = min(p, q)
                        links.append(sorted((int(block.ids[k]), int(block.ids[x]))))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], schema=out)

    texts = texts_of(groups.select(F.col("b").alias("id")).distinct())
    return cut(_dealt(groups, comps, sketches, texts).mapInArrow(run, "a long, b long").distinct())


def link(met: DataFrame, texts_of: TextsOf, percent: int = 80) -> DataFrame:
    """Components (id, comp) of the linked ids.

    `met` is what collide() returns; texts_of(ids) gives (id, text) for a frame of ids.
    """
    small_batches(met.sparkSession)
    stars = met.where(F.col("kind") == STAR).select("a", "b")
    groups = met.where(F.col("kind") == GROUP).select("a", "b")
    ids = colliding(met)
    sketches = _sketches(texts_of(ids))
    links = _verify(_sketch_filter(stars.distinct(), sketches, percent), texts_of, percent)
    comps = cut(components(links))
    likely = _likely(groups, comps, sketches, percent)
    more = _verify(likely.where(F.col("kind") == PAIR).select("a", "b"), texts_of, percent)
    comps = _joined(comps, more)
    again = likely.where(F.col("kind") == AGAIN).select("a").distinct()
    if not again.isEmpty():
        comps = _joined(comps, _spanning(groups.join(again, "a", "left_semi"), comps, sketches, texts_of, percent))
    drop(ids, sketches, links, likely)
    return comps


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links; the old ones count as stars."""
    if links.isEmpty():
        return comps
    new = cut(components(comps.where("id <> comp").select(F.col("comp").alias("a"), F.col("id").alias("b")).unionByName(links)))
    drop(comps, links)
    return new


def lookup(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of table whose key is among the distinct ids; ids are broadcast if counted few."""
    return table.join(bounded_broadcast(ids, FEW_IDS), key, "left_semi")
