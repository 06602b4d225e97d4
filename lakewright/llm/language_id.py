"""Language identification by segmentation-marginalised unigrams.

A language is a unigram distribution over the pieces of a fixed public vocabulary,
counted in labelled texts and smoothed.  A marked word's probability in a language is
summed over all its segmentations by a forward pass: f(0) = 1 and f(j) is the sum over
pieces s ending at j of f(j - |s|) * p(s); characters without a piece have one fixed
small probability.  A text's log-probability is the sum over its words, the prediction
the language of the largest, the score its share of the summed probabilities.

No piece crosses a white-space marker, so words are independent and a word's log-
probabilities can be remembered: each task scores a distinct word once, all new words
of a batch together, position by position in numpy.

A model knows the learned languages only, so any text gets one of them.  open_set() adds
a class for what is none of them: all pieces alike, at a prior of OTHER.  The longer a
text, the more its pieces say: a few characters of junk pass for a language, a line
does not.  A language learned from few texts is itself nearly even by its smoothing, and
then takes more of what is foreign.

Learning reads the labelled rows that the caller lets through: languages are counted
over all of them; piece counts come from whole texts of a sample, about DOCS_PER_LANG
documents a language, drawn by a hash of the id.

Defined cases: a null text or one without a letter is UNKNOWN with score 0; rows
without a language teach nothing; if nothing can be learned every row is UNKNOWN;
extra columns pass through, columns named like the results are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_schema, slices, small_batches
from .sentencepiece_codec import MARK, codec

UNKNOWN = "und"
DOCS_PER_LANG = 400
SMOOTHING = 0.1
#: Probability of a character that no piece starts with.
RARE = 1e-9
#: Prior of a text in no learned language, for open_set(); that of each language counts as 1.
OTHER = 1e-4
#: Words that one task remembers; beyond, the memory is emptied, which costs time only.
REMEMBER = 200_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Model:
    """languages, log-free piece probabilities [piece, language] of a vocabulary file, priors (all 1 by default)."""

    model_path: str
    languages: tuple[str, ...]
    probabilities: np.ndarray
    priors: tuple[float, ...] | None = None


def open_set(model: Model, prior: float = OTHER) -> Model:
    """The model with UNKNOWN as one more language, in which all pieces are equally likely."""
    size, n = model.probabilities.shape
    if not n:
        return model
    even = np.full((size, 1), 1.0 / size)
    return Model(model.model_path, (*model.languages, UNKNOWN), np.hstack([model.probabilities, even]), (*(model.priors or (1.0,) * n), prior))


class Trie:
    """The vocabulary's normal pieces as a table of transitions."""

    def __init__(self, pieces: dict[str, int]):
        self.chars = {c: k + 1 for k, c in enumerate(sorted({c for p in pieces for c in p}))}
        width = len(self.chars) + 1
        nodes, self.piece = {"": 0}, [-1]
        edges = {}
        for p, i in sorted(pieces.items()):
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(self.piece)
                    self.piece.append(-1)
                    edges[nodes[p[: k - 1]] * width + self.chars[p[k - 1]]] = nodes[p[:k]]
            self.piece[nodes[p]] = i
        self.width, self.piece = width, np.array(self.piece)
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.first = np.full(width, -1, np.int64)  # from the root, by character
        for k, v in edges.items():
            if k < width:
                self.first[k] = v

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next nodes, -1 where there is none."""
        key = node * self.width + char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


_tries: dict[str, Trie] = {}


def trie(model_path: str) -> Trie:
    if model_path not in _tries:
        lib = codec(model_path).lib
        special = lambda i: lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)
        _tries[model_path] = Trie({lib.id_to_piece(i): i for i in range(lib.vocab_size()) if not special(i)})
    return _tries[model_path]


def forward(words: list[str], known: Trie, probabilities: np.ndarray) -> np.ndarray:
    """Log-probability [word, language] of words, each marked, over all segmentations."""
    n_lang = probabilities.shape[1]
    out = np.zeros((len(words), n_lang))
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        # Words of like length together, so that little is padded; bounded cells.
        n = len(words[order[at]]) + 1
        some = [k for k in order[at : at + max(1, min(4096, 400_000 // (n * n_lang)))] if len(words[k]) + 1 <= max(n + 2, n * 5 // 4)]
        at += len(some)
        out[some] = _forward([MARK + words[k] for k in some], known, probabilities)
    return out


def _forward(marked: list[str], known: Trie, probabilities: np.ndarray) -> np.ndarray:
    size = np.array([len(w) for w in marked])
    n, count, n_lang = int(size.max()), len(marked), probabilities.shape[1]
    chars = np.full((n, count), -1, np.int64)
    get = known.chars.get
    for k, w in enumerate(marked):
        chars[: len(w), k] = [get(c, 0) for c in w]
    reach = 17
    f = np.zeros((n + reach + 1, count, n_lang))
    f[0] = 1.0
    logs = np.zeros((count, n_lang))
    done = np.zeros((count, n_lang))
    for i in range(n):
        if i % 8 == 0 and i:  # keep long words within the range of doubles, language by language
            scale = f[i]
            ahead = f[i : i + reach]
            safe = np.where(scale > 0, scale, 1.0)
            ahead /= safe
            logs += np.log(safe)
        live = np.flatnonzero(chars[i] >= 0)
        here = f[i]
        node = known.first[chars[i][live]]
        lost = live[(node < 0) | (known.piece[np.maximum(node, 0)] < 0)]
        if len(lost):
            f[i + 1, lost] += here[lost] * RARE
        step = 1
        while True:
            alive = node >= 0
            live, node = live[alive], node[alive]
            if not len(live):
                break
            piece = known.piece[node]
            ends = piece >= 0
            if ends.any():
                f[i + step, live[ends]] += here[live[ends]] * probabilities[piece[ends]]
            if i + step >= n:
                break
            char = chars[i + step][live]
            inside = char >= 0
            live, node = live[inside], known.step(node[inside], char[inside])
            step += 1
        last = np.flatnonzero(size == i + 1)
        if len(last):
            done[last] = np.log(np.maximum(f[i + 1, last], 1e-300)) + logs[last]
    return done


def fit(labelled: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Learn from the rows given; those of null text or language are left out."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("text is not null and lang is not null")
    per_lang = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    languages = tuple(sorted(per_lang))
    vocabulary = codec(model_path).lib.vocab_size()
    if not languages:
        return Model(model_path, (), np.zeros((vocabulary, 0)))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_lang / per_lang[k]))])
    drawn = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(2**20)) < F.element_at(share, F.col("lang")) * 2**20)
    out = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("n", pa.int64())])

    def count(batches):
        known, sums = codec(model_path), {}
        for batch in slices(batches):
            for lang_, packed in zip(batch.column("lang").to_pylist(), known.encode([t.lower() for t in batch.column("text").to_pylist()])):
                found = np.bincount(np.frombuffer(packed, "<u4"), minlength=vocabulary)
                sums[lang_] = sums[lang_] + found if lang_ in sums else found
        for lang_, found in sums.items():
            piece = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(piece)), pa.array(piece, pa.int32()), pa.array(found[piece], pa.int64())], schema=out)

    # At most a row for each language and piece reaches the driver.
    counts = drawn.mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((vocabulary, len(languages)), SMOOTHING)
    place = {k: i for i, k in enumerate(languages)}
    np.add.at(table, (counts["piece"].to_numpy(np.int64), np.array([place[k] for k in counts["lang"]], np.int64)), counts["n"].to_numpy(np.float64))
    return Model(model_path, languages, table / table.sum(axis=0))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.trie = model, trie(model.model_path)
        self.place: dict[str, int] = {}
        self.logs = np.zeros((1024, len(model.languages)))
        self.priors = np.log(np.array(model.priors or (1.0,) * len(model.languages)))

    def _learn(self, fresh: list[str]) -> None:
        n = len(self.place)
        if n + len(fresh) > len(self.logs):
            self.logs = np.concatenate([self.logs[:n], np.zeros((max(len(fresh), n), self.logs.shape[1]))])
        self.logs[n : n + len(fresh)] = forward(fresh, self.trie, self.model.probabilities)
        self.place.update(zip(fresh, range(n, n + len(fresh))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for start in range(0, len(texts), 256):
            split = [WORD.findall(t.lower()) if t and any(map(str.isalpha, t)) else [] for t in texts[start : start + 256]]
            fresh = {w for words in split for w in words if w not in self.place}
            if len(self.place) + len(fresh) > REMEMBER:
                self.place.clear()
                fresh = {w for words in split for w in words}
            if fresh and self.model.languages:
                self._learn(list(fresh))
            for words in split:
                if not words or not self.model.languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = self.logs[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0) + self.priors
                best = int(total.argmax())
                langs.append(self.model.languages[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return langs, scores


def predict(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language and its score."""
    small_batches(df.sparkSession)
    rest = [f for f in df.schema.fields if f.name not in (lang_pred, score)]
    schema = StructType(rest + [StructField(lang_pred, StringType()), StructField(score, DoubleType())])
    out = arrow_schema(schema)
    sent = df.sparkSession.sparkContext.broadcast((model.model_path, model.languages, model.probabilities, model.priors))  # vocabulary x languages

    def run(batches):
        scorer = Scorer(Model(*sent.value))
        for batch in slices(batches):
            langs, scores = scorer.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(out.field(f.name).type) for f in rest] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=out)

    return df.select([F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, schema)
