"""Functions that work on a whole Arrow batch at a time: bags, places, evidence.

What they do would be a fold or a search over arrays for every row, which the engine
interprets element by element; here the elements of some hundred rows lie in one
column.  A batch is taken in pieces of PIECE rows, so that what is made on the way
stays small whatever the size of the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

#: Rows of a batch that are worked on at a time.
PIECE = 500

RECALL = StructType([StructField("recall", DoubleType()), StructField("extra", DoubleType())])
PLACED = ArrayType(StructType([StructField("term", StringType()), StructField("places", ArrayType(IntegerType()))]))
_PLACED = pa.list_(pa.struct([("term", pa.string()), ("places", pa.list_(pa.int32()))]))


def _in_pieces(run, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    n = len(columns[0])
    return pa.concat_arrays([run(*[c.slice(at, PIECE) for c in columns]) for at in range(0, n, PIECE)]) if n else pa.array([], kind)


def _tokens(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(rows, tokens) of three or more of [a-z0-9], words parted at line ends rejoined: text.recall_tokens() of a batch."""
    low = pc.utf8_lower(pc.replace_substring_regex(texts, r"-\s+", ""))
    pieces = pc.split_pattern_regex(low, "[^a-z0-9]+")
    rows, words = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    kept = pc.greater_equal(pc.binary_length(words), 3)
    return rows.filter(kept), words.filter(kept)


def _recall(stored: pa.Array, source: pa.Array) -> pa.Array:
    n = len(stored)
    (at, a), (bt, b) = _tokens(stored), _tokens(source)
    mine = np.r_[np.ones(len(a), np.int64), np.zeros(len(b), np.int64)]
    bags = pa.table({"row": pa.concat_arrays([at, bt]), "word": pa.concat_arrays([a, b]), "a": mine, "b": 1 - mine})
    bags = bags.group_by(["row", "word"], use_threads=False).aggregate([("a", "sum"), ("b", "sum")])
    least = np.minimum(bags["a_sum"].to_numpy(), bags["b_sum"].to_numpy())
    both = np.bincount(bags["row"].to_numpy(), least, n).astype(np.int64)
    st, src = np.bincount(at.to_numpy(), minlength=n), np.bincount(bt.to_numpy(), minlength=n)
    return pa.StructArray.from_arrays([pa.array(100 * both / np.maximum(src, 1)), pa.array(100 * (st - both) / np.maximum(st, 1))], ["recall", "extra"])


@arrow_udf(RECALL)
def bag_recall(stored: pa.Array, source: pa.Array) -> pa.Array:
    """Share of the source's tokens that are stored, and of the stored ones that are not the source's, as bags; a null text has none."""
    return _in_pieces(_recall, pa.struct([("recall", pa.float64()), ("extra", pa.float64())]), stored, source)


def searches(patterns: dict[str, str]):
    """A function of a text: struct of whether it has each pattern, case aside; null for a null text."""
    kind = StructType([StructField(k, BooleanType()) for k in patterns])

    @arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pc.match_substring_regex(texts, p, ignore_case=True) for p in patterns.values()], list(patterns))

    return run


def _placed(words: pa.Array) -> pa.Array:
    lengths = np.asarray(pc.fill_null(pc.list_value_length(words), 0), np.int64)
    flat, rows = pc.list_flatten(words), np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    coded = flat.dictionary_encode()
    key = rows * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")  # places stay in order
    key = key[order]
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    term = coded.dictionary.take(coded.indices.take(pa.array(order[begins])))
    places = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(key)], pa.int32()), pa.array(place[order], pa.int32()))
    held = np.bincount(rows[order[begins]], minlength=len(words))
    offsets = np.r_[0, np.cumsum(held)]
    made = pa.StructArray.from_arrays([term, places], ["term", "places"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made, mask=words.is_null())


@arrow_udf(PLACED)
def places(words: pa.Array) -> pa.Array:
    """The distinct words of an array with where each stands, from 0."""
    return _in_pieces(_placed, _PLACED, words)


def row_wise(one):
    """A function of lists of texts, one list after another in Python, as a function of an array column."""
    kind = pa.list_(pa.string())

    @arrow_udf(ArrayType(StringType()))
    def run(values: pa.Array) -> pa.Array:
        return _in_pieces(lambda piece: pa.array(map(one, piece.to_pylist()), kind), kind, values)

    return run
