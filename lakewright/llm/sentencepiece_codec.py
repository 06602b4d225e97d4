"""SentencePiece encoding and decoding by a table of distinct marked words.

In a vocabulary where no piece has a white-space marker behind another symbol, no
merge can join the end of one word to the marker of the next.  The text with its
leading marker then falls into chunks, each a run of markers and the symbols up to
the next marker, and the ids of a text are the ids of its chunks in order.  Every
task keeps a table chunk -> ids; each distinct chunk is segmented once by the
library and the ids are joined back by position.  Vocabularies with crossing pieces
fall back to whole texts as chunks, so the ids are always the library's.

Defined cases: null text counts as empty and has only the two end ids; a literal
U+2581 is the marker itself, as in the library; texts may be of any length.  Columns
besides the text pass through untouched; the two new names replace columns of the
same name.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import arrow_schema, slices, small_batches

MARK = "▁"
CHUNK = re.compile(r" +[^ ]*")
#: Chunks that one task remembers; the table is emptied beyond, which costs time only.
REMEMBER = 300_000
#: Longer chunks are rarely seen twice and are not remembered.
LONG_CHUNK = 64

_codecs: dict[tuple, "ChunkCodec"] = {}


class ChunkCodec:
    """Encodes with a chunk table, decodes with the library."""

    def __init__(self, model_path: str):
        import numpy as np
        import sentencepiece

        self.np = np
        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.vocab_size()))
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces) and self.lib.encode("a b") == self.lib.encode("a") + self.lib.encode("b")
        self.table: dict[str, bytes] = {}
        self.bos, self.eos = (self._pack([i]) for i in (self.lib.bos_id(), self.lib.eos_id()))

    def _pack(self, ids) -> bytes:
        return self.np.asarray(ids, "<u4").tobytes()

    def _segment(self, chunks: list[str]) -> list[bytes]:
        # The library puts a marker in front, so a chunk is given without its own first one.
        alone = self._pack([self.lib.piece_to_id(MARK)])
        return [alone if c == " " else self._pack(ids) for c, ids in zip(chunks, self.lib.encode([c[1:] for c in chunks], num_threads=1))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian 32-bit ids, with begin and end."""
        out, table = [], self.table
        if not self.splits:
            return [self.bos + self._pack(ids) + self.eos for ids in self.lib.encode([t or "" for t in texts], num_threads=1)]
        for text in texts:
            if not text:
                out.append(self.bos + self.eos)
                continue
            chunks = CHUNK.findall(" " + text.replace(MARK, " "))
            fresh = list({c for c in chunks if c not in table})
            if fresh:
                if len(table) + len(fresh) > REMEMBER:
                    table.clear()
                    fresh = list(set(chunks))
                table.update(zip(fresh, self._segment(fresh)))
            out.append(self.bos + b"".join(map(table.__getitem__, chunks)) + self.eos)
            for c in fresh:
                if len(c) > LONG_CHUNK:
                    del table[c]
        return out

    def decode(self, packed: list[bytes]) -> list[str]:
        return [self.lib.decode(self.np.frombuffer(p, "<u4").tolist()) for p in packed]


def codec(model_path: str) -> ChunkCodec:
    if model_path not in _codecs:
        _codecs[model_path] = ChunkCodec(model_path)
    return _codecs[model_path]


def tokenize(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add `ids` (packed ids, see unpack) and, if named, the text they decode to."""
    small_batches(df.sparkSession)
    names = [ids] + [decoded] * bool(decoded)
    rest = [f for f in df.schema.fields if f.name not in names]
    schema = StructType(rest + [StructField(ids, BinaryType())] + [StructField(n, StringType()) for n in names[1:]])
    out, kept = arrow_schema(schema), [f.name for f in rest]

    def run(batches):
        known = codec(model_path)
        for part in slices(batches, 256):  # a few MB of ids at a time
            packed = known.encode(part.column(text).to_pylist())
            cols = [part.column(c).cast(out.field(c).type) for c in kept] + [pa.array(packed, pa.binary())]
            if decoded:
                cols.append(pa.array(known.decode(packed), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, schema=out)

    return df.select([F.col(f"`{f.name}`") for f in rest] + ([] if text in kept else [F.col(f"`{text}`")])).mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text that packed ids stand for; null ids decode to the empty text."""
    small_batches(df.sparkSession)
    rest = [f for f in df.schema.fields if f.name != decoded]
    schema = StructType(rest + [StructField(decoded, StringType())])
    out = arrow_schema(schema)

    def run(batches):
        known = codec(model_path)
        for batch in slices(batches, 256):
            texts = known.decode([p or b"" for p in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(out.field(f.name).type) for f in rest] + [pa.array(texts, pa.string())], schema=out)

    return df.select([F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, schema)


def unpack(packed: bytes) -> list[int]:
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def digests(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    coded = tokenize(df.select("doc_id", "text"), model_path, ids="ids", decoded="decoded")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
