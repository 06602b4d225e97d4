"""Substring dedup by paragraph MinHash banding.

A paragraph is a line of at least MIN_WORDS words; its set holds its distinct
five-word shingles.  Its MinHash values are cut into bands, tuned so that paragraphs
of the threshold's Jaccard collide with at least the wanted chance and others as
seldom as that allows.  Colliding paragraphs are compared shingle by shingle, links
form components (near.link), and of all occurrences of a component the first, by
doc_id and line, stays; the others are cut from their documents.

What is left is searched for repeated passages: PASSAGE words or more, word for word,
wherever they begin, inside lines or over line breaks.  Every window of PASSAGE words
is anchored by the least hash of its ANCHOR-word shingles (MinHash of one value), so
equal windows have one anchor, and neighbours mostly share theirs.  Only windows whose
anchor occurs twice are named and met; of equal windows the first, by doc_id and
place, stays, and the words of the others are cut.  In one document a window that
overlaps its first copy stays.

Nodes are distinct paragraphs, named by a 64-bit hash of their words, so a passage
that occurs a million times is one node and its copies cost one narrow row each.

Defined cases: null texts stay null and nothing is cut from them; shorter lines are
never cut as lines, only as parts of passages; blanks behind a cut passage go with it,
a line break behind it stays; words that a cut brings together are not searched again;
rows of one doc_id count as one document (occurrences in both are the same
one); null ids keep all and take no part; a document all of whose lines are cut has
an empty text; ties go to the lower line; other columns pass through, whatever their
names.  An empty table gives an empty result.

Scale: a task holds the entries of one key bucket.  A band or anchor that very many
paragraphs share lies in one bucket, 16 to 28 bytes for each of its holders.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import near, shingles as sh
from .common import bounded_broadcast, cut, drop, own_name, packs, partitions, slices, small_batches

U = np.uint64
MIN_WORDS = 25
PERCENT = 80
RECALL, HASHES = 0.9995, 64
PACK = 1024
PASSAGE, ANCHOR = 50, 25
#: Documents with cut passages up to which their spans are broadcast; beyond, shuffled.
FEW_SPANS = 200_000


def tune(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): least expected collisions below the threshold, at the wanted recall there."""
    best = None
    for rows in range(1, hashes + 1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                below = sum(1 - (1 - (x / 200) ** rows) ** bands for x in range(int(200 * threshold)))
                best = min(best or (below, bands, rows), (below, bands, rows))
                break
    if best is None:
        raise ValueError("no banding of so few hashes has this recall")
    return best[1], best[2]


_random = np.random.Generator(np.random.PCG64(7_654_321))
_FACTOR = _random.integers(1, 2**63, 1024, dtype=np.uint64) * U(2) + U(1)
_SHIFT = _random.integers(1, 2**63, 1024, dtype=np.uint64)


def signatures(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """MinHash values [set, k] of sets laid end to end, each from its start to the next."""
    out = np.empty((len(starts), k), U)
    ends = np.r_[starts[1:], len(hashes)]
    lo = 0
    while lo < len(starts):  # a few thousand hashes at a time: bounded memory
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 4096, side="right")))
        if hi == lo + 1:
            least = np.full(k, np.iinfo(np.uint64).max, U)
            for at in range(starts[lo], ends[lo], 4096):
                part = hashes[at : min(at + 4096, ends[lo])]
                np.minimum(least, (part[:, None] * _FACTOR[:k] + _SHIFT[:k]).min(axis=0), out=least)
            out[lo] = least
        else:
            part = hashes[starts[lo] : ends[hi - 1]]
            out[lo:hi] = np.minimum.reduceat(part[:, None] * _FACTOR[:k] + _SHIFT[:k], starts[lo:hi] - starts[lo], axis=0)
        lo = hi
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys [set, band] of MinHash values [set, bands * rows]."""
    values = sh.mix(values).reshape(len(values), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), values.shape[:2])
    for r in range(rows):
        key = sh.mix(key * U(3) + values[:, :, r])
    return key


@dataclass
class Paragraphs:
    """The lines of a text that are long enough, in order."""

    line: np.ndarray  #: numbers from 0
    name: np.ndarray  #: 64-bit hash of the words in their order
    start: np.ndarray  #: first byte
    end: np.ndarray  #: byte behind the last
    hashes: np.ndarray  #: shingle hashes, laid end to end
    at: np.ndarray  #: where each line's begin


def paragraphs(text: str | None, min_words: int = MIN_WORDS) -> Paragraphs | None:
    data = sh.lowered(text)
    if len(data) < 2 * min_words - 1:
        return None
    w, starts, _ = sh.words(data)
    if len(w) < min_words:
        return None
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(breaks, starts)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    size = np.diff(np.r_[first, len(line)])
    long_ = size >= min_words
    if not long_.any():
        return None
    # The place of a word enters the name, so that order matters.
    place = (np.arange(1, len(w) + 1) - np.repeat(first, size)).astype(np.uint64)
    name = sh.mix(np.bitwise_xor.reduceat(sh.mix(w + place * U(0x9E3779B97F4A7C15)), first) + size.astype(np.uint64))[long_]
    numbers = line[first[long_]]
    edges = np.r_[-1, breaks, len(data)]
    inside = np.repeat(long_, size)[: len(w) - sh.WORDS + 1] & (line[: len(w) - sh.WORDS + 1] == line[sh.WORDS - 1 :])
    at = np.r_[0, np.cumsum(size[long_] - sh.WORDS + 1)[:-1]]
    return Paragraphs(numbers, name.view(np.int64), edges[numbers] + 1, edges[numbers + 1], sh.shingles(w)[inside], at)


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, line, name) of every paragraph."""
    out = pa.schema([("id", pa.int64()), ("line", pa.int32()), ("name", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            found = [(i, p) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) if (p := paragraphs(t, min_words))]
            if found:
                ids = np.repeat(np.array([i for i, _ in found], np.int64), [len(p.line) for _, p in found])
                cols = ids, np.concatenate([p.line for _, p in found]), np.concatenate([p.name for _, p in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, cols[1].astype(np.int32), cols[2]), out)], schema=out)

    return docs.mapInArrow(run, "id long, line int, name long")


def _pack(docs: DataFrame, min_words: int, bands: int, rows: int, n: int) -> DataFrame:
    buckets = near.BUCKETS * n

    def run(batches):
        for batch in packs(batches, PACK):
            names, values = [], []
            for t in batch.column("text").to_pylist():
                if p := paragraphs(t, min_words):
                    names.append(p.name)
                    values.append(signatures(p.hashes, p.at, bands * rows))
            if names:
                names, one = np.unique(np.concatenate(names), return_index=True)
                keys = band_keys(np.concatenate(values)[one], bands, rows)
                yield near.packed_rows(keys.ravel(), np.repeat(np.arange(len(names)), bands), names, None, buckets, 0)

    return docs.select("text").mapInArrow(run, near.PACKED_DDL)


def _texts(docs: DataFrame, ids: DataFrame, min_words: int) -> DataFrame:
    """(id, text) of the named paragraphs, once each."""
    out = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in slices(batches):
            found = {}
            for t in batch.column("text").to_pylist():
                if p := paragraphs(t, min_words):
                    data = t.encode("utf-8", "surrogatepass")
                    for name, start, end in zip(p.name.tolist(), p.start.tolist(), p.end.tolist()):
                        if name not in found:
                            found[name] = data[start:end].decode("utf-8", "surrogatepass")
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], schema=out)

    named = near.lookup(docs.select("text").mapInArrow(run, "id long, text string"), ids)
    return named.groupBy("id").agg(F.min("text").alias("text"))


def removals(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, lines): the line numbers to cut from each document that has any."""
    small_batches(df.sparkSession)
    bands, rows = tune(percent / 100, RECALL, HASHES)
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")
    found = cut(occurrences(docs, min_words))
    n = partitions(docs)
    met = near.collide(_pack(docs, min_words, bands, rows, n), n)
    # One more scan of the documents gives the texts of all that collide; the rounds look them up.
    ids = near.colliding(met)
    texts = cut(_texts(docs, ids, min_words))
    comps = near.link(met, lambda ids: near.lookup(texts, ids), percent)
    drop(ids, texts, met)
    named = found.join(comps.withColumnRenamed("id", "name"), "name", "left").select("id", "line", F.coalesce("comp", "name").alias("comp"))
    first = named.groupBy("comp").agg(F.min(F.struct("id", "line")).alias("first"), F.max(F.struct("id", "line")).alias("last")).where("first <> last")
    again = named.join(first, "comp").where((F.col("id") != F.col("first.id")) | (F.col("line") != F.col("first.line")))
    return again.groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def rolling(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k words, in order."""
    up, down = sh._powers(len(w))
    sums = np.zeros(len(w) + 1, U)
    np.cumsum(w * up[: len(w)], out=sums[1:])
    return sh.mix((sums[k:] - sums[:-k]) * down[: len(w) - k + 1] + U(k))


def anchors(w: np.ndarray, size: int) -> np.ndarray:
    """Least shingle hash of every window of `size` words, in order."""
    anchor = min(ANCHOR, size)
    least, have, want = rolling(w, anchor), 1, size - anchor + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def _anchored(docs: DataFrame, size: int) -> DataFrame:
    """(id, anchor) of the anchors that occur more than once."""
    n = partitions(docs)
    buckets = near.BUCKETS * n
    reach = size - min(ANCHOR, size) + 1

    def pack(batches):
        for batch in packs(batches, PACK):
            ids, values = [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                w, _, _ = sh.words(sh.lowered(t))
                if len(w) >= size:
                    a = anchors(w, size)
                    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                    # One shingle is least in `reach` windows in a row at most: a longer run is of several.
                    ids.append(i)
                    values.append(np.r_[a[first], a[first[np.diff(np.r_[first, len(a)]) > reach]]])
            if ids:
                yield near.packed_rows(np.concatenate(values), np.repeat(np.arange(len(ids)), [len(v) for v in values]), np.array(ids, np.int64), None, buckets, 0)

    out = pa.schema([("id", pa.int64()), ("anchor", pa.int64())])

    def meet(batches):
        for held in _by_bucket(batches, ("keys", "places", "ids")):
            keys = [np.frombuffer(k, "<u8") for k, _, _ in held]
            ids = [np.frombuffer(i, "<i8")[np.frombuffer(at, "<u4" if len(at) == 4 * len(k) else "<u2")] for k, (_, at, i) in zip(keys, held)]
            keys, ids = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            twice = np.r_[False, keys[1:] == keys[:-1]]
            twice |= np.r_[twice[1:], False]
            own = twice & np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(keys[own].view(np.int64))], schema=out)

    packed = docs.select("id", "text").mapInArrow(pack, near.PACKED_DDL)
    return cut(near.by_bucket(packed, n).mapInArrow(meet, "id long, anchor long"))


def _by_bucket(batches, columns: tuple[str, ...]):
    """Rows of each bucket, from rows sorted by bucket."""
    bucket, rows = None, []
    for batch in batches:
        for b, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", *columns))):
            if b != bucket and rows:
                yield rows
                rows = []
            bucket = b
            rows.append(row)
    if rows:
        yield rows


def _windows(docs: DataFrame, anchored: DataFrame, size: int) -> DataFrame:
    """The windows of such anchors, packed by bucket of the anchor: whose, name, first and last character."""
    buckets = near.BUCKETS * partitions(docs)
    out = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("names", "places", "starts", "ends", "ids", "versions"))])

    def run(batches):
        for batch in packs(batches, PACK // 4):
            found = []
            for k, (t, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("anchors").to_pylist())):
                data = sh.lowered(t)
                w, starts, ends = sh.words(data)
                if len(w) < size:
                    continue
                a = anchors(w, size)
                at = np.flatnonzero(np.isin(a, np.array(wanted, np.int64).view(U)))
                raw = np.frombuffer(data, np.uint8)
                chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                # A window ends where the next word begins, or before the line break in between.
                breaks = np.r_[0, np.cumsum(raw == 10)]
                behind = np.r_[starts[1:], len(raw)]
                stop = np.where(breaks[behind] > breaks[ends], ends, behind)
                found.append((a[at], rolling(w, size)[at], np.full(len(at), k), chars[starts[at]], chars[stop[at + size - 1]]))
            if not found:
                continue
            key, name, place, start, end = map(np.concatenate, zip(*found))
            ids, versions = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("id", "version"))
            to = (key >> U(20)) % U(buckets)
            order = np.argsort(to, kind="stable")
            lows = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0])
            rows = []
            for lo, hi in zip(lows, np.r_[lows[1:], len(order)]):
                o = order[lo:hi]
                used, at = np.unique(place[o], return_inverse=True)
                rows.append((int(to[o[0]]), name[o].tobytes(), *(x.astype("<i4").tobytes() for x in (at, start[o], end[o])), ids[used].tobytes(), versions[used].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    wanted = cut(anchored.groupBy("id").agg(F.collect_list("anchor").alias("anchors")))
    met = near.lookup(docs, wanted.select("id")).join(wanted.hint("merge"), "id")
    return met.mapInArrow(run, "bucket int, names binary, places binary, starts binary, ends binary, ids binary, versions binary")


def spans(docs: DataFrame, size: int = PASSAGE) -> DataFrame:
    """(id, version, spans): the characters [s, e) to cut of each (id, version, text) that repeats a passage."""
    out = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])

    def repeated(batches):
        for rows in _by_bucket(batches, ("names", "places", "starts", "ends", "ids", "versions")):
            held = []
            for name, at, start, end, i, v in rows:
                at = np.frombuffer(at, "<i4")
                held.append((np.frombuffer(name, "<u8"), np.frombuffer(i, "<i8")[at], np.frombuffer(v, "<i8")[at], np.frombuffer(start, "<i4"), np.frombuffer(end, "<i4")))
            name, ids, version, start, end = map(np.concatenate, zip(*held))
            order = np.lexsort((start, version, ids, name))
            name, ids, version, start, end = (x[order] for x in (name, ids, version, start, end))
            new = np.r_[True, name[1:] != name[:-1]]
            own = new | np.r_[True, (ids[1:] != ids[:-1]) | (version[1:] != version[:-1])]
            head, mine = (np.maximum.accumulate(np.where(x, np.arange(len(name)), 0)) for x in (new, own))
            gone = np.flatnonzero((ids != ids[head]) | (start >= end[mine]))
            gone = gone[np.lexsort((start[gone], version[gone], ids[gone]))]
            if not len(gone):
                continue
            ids, version, start, end = ids[gone], version[gone], start[gone], end[gone]
            lows = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (version[1:] != version[:-1])])
            highs = np.r_[lows[1:], len(ids)]
            parts = [_merged(start[lo:hi], end[lo:hi]) for lo, hi in zip(lows, highs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lows]), pa.array(version[lows]), pa.array([s.tobytes() for s, _ in parts], pa.binary()), pa.array([e.tobytes() for _, e in parts], pa.binary())], schema=out)

    ddl = "id long, version long, spans array<struct<s:int,e:int>>"
    merged = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])

    def join(batches):
        for batch in slices(batches):
            lists = []
            for s, e in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist()):
                s, e = (np.frombuffer(b"".join(x), "<i4") for x in (s, e))
                order = np.argsort(s, kind="stable")
                lists.append([{"s": x, "e": y} for x, y in zip(*(x.tolist() for x in _merged(s[order], e[order])))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("version"), pa.array(lists, merged.field("spans").type)], schema=merged)

    packed = _windows(docs, _anchored(docs, size), size)
    found = near.by_bucket(packed, partitions(docs)).mapInArrow(repeated, "id long, version long, starts binary, ends binary")
    return found.groupBy("id", "version").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends")).mapInArrow(join, ddl)


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of their starts, those that touch made one."""
    upto = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, start[1:] > upto[:-1]])
    return start[first], upto[np.r_[first[1:], len(start)] - 1]


def cut_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = PASSAGE) -> DataFrame:
    """df without the passages of at least `size` words that occur before; df is read several times."""
    small_batches(df.sparkSession)
    body, version = F.col(f"`{text}`"), F.xxhash64(F.col(f"`{text}`"))
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), version.alias("version"), body.alias("text")).where("id is not null and text is not null")
    own_id, own_version, own_spans = (own_name(df, x) for x in ("id", "version", "spans"))
    found = cut(spans(docs, size)).select(F.col("id").alias(own_id), F.col("version").alias(own_version), F.col("spans").alias(own_spans))
    met = df.join(bounded_broadcast(found, FEW_SPANS), (F.col(f"`{doc_id}`") == F.col(own_id)) & (version == F.col(own_version)), "left")
    since = lambda i: F.coalesce(F.get(own_spans, i)["e"], F.lit(0))
    kept = F.transform(own_spans, lambda x, i: F.substring(body, since(i - 1) + 1, x["s"] - since(i - 1)))
    left = F.concat(F.array_join(kept, ""), F.substring(body, since(F.size(own_spans) - 1) + 1, F.length(body)))
    return met.withColumn(text, F.when(F.col(own_spans).isNull(), body).otherwise(left)).drop(own_id, own_version, own_spans)


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT, removed: str | None = None, passage: int | None = PASSAGE) -> DataFrame:
    """df with the repeated paragraphs, then the repeated passages cut from its texts.

    `removed` names a column for the numbers of cut lines, in place of one of that name;
    without `passage` only lines are cut.
    """
    own_id, own_lines = (own_name(df, x) for x in ("id", "lines"))
    gone = cut(removals(df, doc_id, text, min_words, percent).select(F.col("id").alias(own_id), F.col("lines").alias(own_lines)))
    # By merging at every size: the cut lists grow with the input, and so does the way they take.
    met = df.join(gone.hint("merge"), F.col(f"`{doc_id}`") == F.col(own_id), "left").drop(own_id)
    # Lines are numbered from 0; filter's second argument is the place.
    kept = F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda x, i: ~F.array_contains(own_lines, i))
    body = F.when(F.col(own_lines).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    if removed:
        met = met.withColumn(removed, F.coalesce(own_lines, F.array().cast("array<int>")))
    left = met.withColumn(text, body).drop(own_lines)
    return cut_passages(cut(left), doc_id, text, passage) if passage else left
