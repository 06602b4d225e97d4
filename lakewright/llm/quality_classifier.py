"""Quality classifier: hashed word n-grams, logistic regression, FTRL.

A text falls into tokens, runs of word characters or of punctuation, case kept.
Features are its tokens and pairs of neighbouring tokens, hashed into 2**BITS weights,
and one for pairs that the text has shown before.  A feature's value is SCALE times
its share of all features, so the score is a sparse dot product over the occurrences,
without building a vector:  sigmoid(bias + SCALE / n * sum of weights[hash]).

The weights are learned by follow-the-regularised-leader updates (per-coordinate
rates, L1 and L2) in one task over a sample of the labelled rows, about SAMPLE of them
drawn by a hash of the id; the task returns the nonzero weights, at most 2**BITS.

Defined cases: null and empty texts have the bias alone as evidence; a table without
labelled rows gives weights of zero and score 0.5 throughout; rows with several labels
count once, with the least; very long texts are scored whole, in blocks that change
nothing; extra columns pass through, one named like the score is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import arrow_schema, bounded_broadcast, slices, small_batches
from .shingles import mix

U = np.uint64
BITS = 18
SAMPLE = 6000
SCALE = 24.0
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1e-3
AGAIN, BIAS = 0, 1  # places of the two features without a token

_random = np.random.Generator(np.random.PCG64(31_415_926))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_KIND = np.zeros(256, np.int8)  # 0 space, 1 word, 2 punctuation
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_BASE, _powers = 0xD1342543DE82EF95, np.ones(1, U)
#: Bytes hashed at once; a token that spans blocks is put together again.
BLOCK = 1 << 20


def _up(n: int) -> np.ndarray:
    global _powers
    while len(_powers) <= n:
        _powers = np.concatenate([_powers, _powers * U(pow(_BASE, len(_powers), 2**64))])
    return _powers


_BACK = pow(_BASE, -1, 2**64)
_back = np.ones(1, U)


def _down(n: int) -> np.ndarray:
    global _back
    while len(_back) <= n:
        _back = np.concatenate([_back, _back * U(pow(_BACK, len(_back), 2**64))])
    return _back


def token_hashes(data: bytes) -> np.ndarray:
    """Hash of every token, block by block, so that what a long text unpacks to is bounded."""
    out, held = [], None  # held: value, length and kind of a token that the block's end cuts
    for at in range(0, len(data), BLOCK):
        raw = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at)
        kind = _KIND[raw]
        edge = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
        ends = np.r_[edge[1:], len(raw)].astype(np.int64)
        real = kind[edge] > 0
        edge, ends = edge[real], ends[real]
        sums = np.zeros(len(raw) + 1, U)
        np.cumsum(_BYTE[raw] * _up(len(raw))[: len(raw)], out=sums[1:])
        values, sizes = (sums[ends] - sums[edge]) * _down(len(raw))[edge], ends - edge
        if held is not None:
            value, size, its = held
            if len(edge) and edge[0] == 0 and kind[0] == its:
                values[0] = U((value + pow(_BASE, size, 2**64) * int(values[0])) % 2**64)
                sizes[0] += size
            else:
                out.append(np.array([value], U))
            held = None
        if len(edge) and ends[-1] == len(raw) and at + BLOCK < len(data):
            held = int(values[-1]), int(sizes[-1]), kind[-1]
            values = values[:-1]
        out.append(values)
    return mix(np.concatenate(out or [np.zeros(0, U)]))


def features(text: str | None) -> np.ndarray:
    """Hashed places of all feature occurrences of a text, the bias not among them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    tokens = token_hashes(data)
    pairs = mix(tokens[:-1] * U(3) + tokens[1:])
    again = len(pairs) - len(np.unique(pairs))
    hashed = (np.concatenate([tokens, pairs]) >> U(64 - BITS)).astype(np.int64)
    return np.concatenate([np.maximum(hashed, 2), np.full(again, AGAIN)])


@dataclass
class Ftrl:
    """Follow-the-regularised-leader state of a logistic regression."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls) -> "Ftrl":
        return cls(np.zeros(1 << BITS), np.zeros(1 << BITS))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(rows: list[tuple[str | None, int]], epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Weights from (text, label) rows; their order does not matter."""
    state, made = Ftrl.empty(), []
    for text, label in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        f = features(text)
        at, n = np.unique(f, return_counts=True)
        made.append((np.r_[at, BIAS].astype(np.int32), np.r_[n * (SCALE / max(1, len(f))), 1.0].astype(np.float32), label))
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for k in order.permutation(len(made)):
            state.update(*made[k])
    return state.weights().astype(np.float32)


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from (doc_id, text, label) rows, about `sample` of them."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("int").alias("label"))
    out = pa.schema([("at", pa.binary()), ("w", pa.binary())])

    def run(batches):
        seen = [r for batch in batches for r in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist())]
        w = train(seen) if seen else np.zeros(1 << BITS, np.float32)
        at = np.flatnonzero(w).astype("<i4")
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([w[at].astype("<f4").tobytes()])], schema=out)

    got = rows.select("text", "label").repartition(1).mapInArrow(run, "at binary, w binary").collect()  # one row
    w = np.zeros(1 << BITS, np.float32)
    for r in got:
        w[np.frombuffer(r.at, "<i4")] = np.frombuffer(r.w, "<f4")
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of about `sample` labelled rows, drawn by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    n = known.count()
    share = min(1.0, sample / max(1, n))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(2**20)) < share * 2**20)
    drawn = bounded_broadcast(drawn, 4 * sample)
    return docs.select("doc_id", "text").join(drawn, "doc_id").select("doc_id", "text", label)


def predict(df: DataFrame, weights: np.ndarray, text: str = "text", score: str = "score") -> DataFrame:
    """df with the score of each whole text."""
    small_batches(df.sparkSession)
    rest = [f for f in df.schema.fields if f.name != score]
    schema = StructType(rest + [StructField(score, DoubleType())])
    out = arrow_schema(schema)
    sent = df.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats

    def run(batches):
        w = sent.value.astype(np.float64)
        for batch in slices(batches):
            scores = []
            for t in batch.column(text).to_pylist():
                f = features(t)
                scores.append(1.0 / (1.0 + np.exp(-np.clip(w[BIAS] + SCALE / max(1, len(f)) * w[f].sum(), -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(out.field(f.name).type) for f in rest] + [pa.array(scores, pa.float64())], schema=out)

    return df.select([F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, schema)
