"""Document fingerprints from modular prefix arrays.

Let c be the code points of a text, each plus one.  For two primes p below 2**31
the prefix array S[i] = sum of c[j] * B**j for j < i, modulo p, gives the hash of any
span [l, r) as (S[r] - S[l]) * B**-l modulo p, so the equality of any two spans takes
constant time, and the longest common extension of two positions a binary search.
The fingerprint of a text is its prefix arrays: they answer every question about spans
without the text.  Its written form, the digest of the longest span, is the length with
both hashes of the whole; equal texts have equal ones, and likeness needs the arrays.

Likeness of two fingerprints, 0 to 1: code points of the first that lie in
its longest common prefix and suffix with the second, or in blocks of BLOCK code
points that occur anywhere in the rest of the second, each run of blocks extended at
both ends by longest common extensions; over the longer length.  Two empty texts
have likeness 1, an empty and another 0.

The pairing of each document with the next one by doc_id uses a range partitioning by
id, a hash of the text, and place; so rows that share an id, or have none, are split as
others are.  Inside a range rows are streamed in order, so memory holds two texts.  A
task writes its pairs, and the first and the last of its documents; those few meet in
a second step.  Rows with a null doc_id come first; rows with equal ids are ordered by
the hash of their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .common import arrow_schema, cut, partitions, slices, small_batches

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
BLOCK = 32


class _Powers:
    def __init__(self, p: int, base: int):
        self.p = p
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.base, self.inverse = base % p, pow(base, p - 2, p)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, a * np.uint64(pow(b, k, self.p)) % np.uint64(self.p)]))


_POWERS = tuple(_Powers(p, b) for p, b in zip(PRIMES, BASES))


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHashes:
    """The prefix arrays of one text."""

    def __init__(self, text: str | None = None, codes: np.ndarray | None = None):
        c = points(text) if codes is None else codes
        self.n = len(c)
        c = c.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for w in _POWERS:
            w.grow(self.n + 1)
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * w.up[: self.n] % np.uint64(w.p), out=s[1:])
            self.sums.append(s % np.uint64(w.p))

    def span(self, left, right, which: int) -> np.ndarray:
        """Hashes of spans [left, right), one or many, by one of the two moduli."""
        w, s = _POWERS[which], self.sums[which]
        p = np.uint64(w.p)
        return (s[right] + p - s[left]) % p * w.down[left] % p

    def one(self, left: int, right: int, which: int) -> int:
        """Hash of one span, in plain numbers: ten times as fast as an array of one."""
        w, s = _POWERS[which], self.sums[which]
        return (int(s[right]) - int(s[left])) * int(w.down[left]) % w.p

    def fingerprint(self) -> str:
        return f"{self.n:x}-" + "".join(f"{int(self.span(0, self.n, k)):08x}" for k in (0, 1))


def equal_spans(a: PrefixHashes, i, b: PrefixHashes, j, length) -> np.ndarray:
    """Whether a[i:i+length] and b[j:j+length] are equal; arguments may be arrays."""
    return (a.span(i, i + length, 0) == b.span(j, j + length, 0)) & (a.span(i, i + length, 1) == b.span(j, j + length, 1))


def common_extension(a: PrefixHashes, i, b: PrefixHashes, j, most, back: bool = False) -> np.ndarray:
    """Longest common extension from positions i and j (leftwards if back), at most `most`.

    A binary search on span equality, over arrays of positions at once.
    """
    i, j, hi = (np.atleast_1d(np.asarray(x, np.int64)) for x in (i, j, most))
    i, j, hi = np.broadcast_arrays(i, j, hi)
    lo, hi = np.zeros(len(hi), np.int64), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = equal_spans(a, i - mid, b, j - mid, mid) if back else equal_spans(a, i, b, j, mid)
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)
    return lo


def _extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int, most: int, back: bool = False) -> int:
    """common_extension for one pair of positions."""
    lo, hi = 0, most
    while lo < hi:
        n = (lo + hi + 1) // 2
        x, y = (i - n, j - n) if back else (i, j)
        if all(a.one(x, x + n, k) == b.one(y, y + n, k) for k in (0, 1)):
            lo = n
        else:
            hi = n - 1
    return lo


def likeness(a: PrefixHashes, b: PrefixHashes) -> float:
    if not a.n or not b.n:
        return 1.0 if a.n == b.n else 0.0
    least, most = min(a.n, b.n), max(a.n, b.n)
    head = _extension(a, 0, b, 0, least)
    if head == most:
        return 1.0
    tail = _extension(a, a.n, b, b.n, least - head, back=True)
    found = head + tail
    left, right = head, a.n - tail  # what is open in a
    b_left, b_right = head, b.n - tail
    if right - left >= BLOCK and b_right - b_left >= BLOCK:
        starts = np.arange(left, right - BLOCK + 1, BLOCK)
        keys = a.span(starts, starts + BLOCK, 0)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        at = np.arange(b_left, b_right - BLOCK + 1)
        theirs = b.span(at, at + BLOCK, 0)
        place = np.searchsorted(ranked, theirs)
        hit = np.flatnonzero(ranked[np.minimum(place, len(ranked) - 1)] == theirs)
        if len(hit):
            # for each distinct key its first place in b; a's equal blocks all use it
            keys_b, first = np.unique(theirs[hit], return_index=True)
            place = np.minimum(np.searchsorted(keys_b, keys), len(keys_b) - 1)
            mine = np.flatnonzero(keys_b[place] == keys)
            i, j = starts[mine], at[hit[first[place[mine]]]]
            sure = equal_spans(a, i, b, j, BLOCK)
            i, j = i[sure], j[sure]
            found += len(i) * BLOCK
            if len(i):
                begins = np.r_[True, np.diff(i) != BLOCK]
                ends = np.r_[np.diff(i) != BLOCK, True]
                k = np.flatnonzero(begins)
                room = np.minimum(np.minimum(BLOCK - 1, i[k] - left), j[k] - b_left)
                found += int(common_extension(a, i[k], b, j[k], room, back=True).sum())
                k = np.flatnonzero(ends)
                gap = np.r_[i[1:], right][k] - i[k] - BLOCK  # up to the next found block
                behind = common_extension(a, i[k] + BLOCK, b, j[k] + BLOCK, np.minimum(np.minimum(BLOCK - 1, gap // 2), b_right - j[k] - BLOCK))
                found += int(behind.sum())
    return min(1.0, found / most)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: What a range's task writes: results, and its first (0) and last (1) document.
MADE = f"{OUT}, part int, edge int, text string"
FIRST, LAST = 0, 1


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(doc_id: int | None, text: str, own: PrefixHashes, following: str, hashes: PrefixHashes) -> tuple:
    """A row of OUT for a document and the one behind it."""
    changed = edited(text, following)
    other = PrefixHashes(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, own.fingerprint(), other.fingerprint(), likeness(own, other), likeness(own, hashes)


def against_next(df: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness (see OUT)."""
    small_batches(df.sparkSession)
    made, out = (arrow_schema(StructType.fromDDL(x)) for x in (MADE, OUT))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumns({"k": F.coalesce("doc_id", F.lit(-(2**63))), "h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(partitions(rows), "k", "h", "m").sortWithinPartitions("k", "h", "text").select("doc_id", "text")

    def inside(batches):
        part = TaskContext.get().partitionId()
        before = None
        edge = lambda which: (*(before[0], *[None] * 6), part, which, before[1])
        for batch in slices(batches):
            found = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                hashes = PrefixHashes(text)
                if before is not None:
                    found.append((*_compared(*before, text, hashes), None, None, None))
                    before = doc_id, text, hashes
                else:
                    before = doc_id, text, hashes
                    found.append(edge(FIRST))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), made)], schema=made)
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(edge(LAST), made)], schema=made)

    def across(batches):
        for batch in slices(batches):
            found = [_compared(i, t, PrefixHashes(t), after, PrefixHashes(after)) for i, t, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out)

    held = cut(ranged.mapInArrow(inside, MADE))
    parts = held.where(F.col("edge") == FIRST).select("part", F.col("text").alias("after"))
    # A row a task: the next task that has documents, the first one behind the last.
    order = Window.orderBy("part")
    behind = parts.select("part").select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next"))
    last = held.where(F.col("edge") == LAST).select("doc_id", "text", "part").join(behind, "part")
    met = last.join(parts.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "after")
    return held.where("edge is null").select([f.name for f in StructType.fromDDL(OUT)]).unionByName(met.mapInArrow(across, OUT))
