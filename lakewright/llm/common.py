"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..shared import planned_bytes, shared_dir

#: Word separators of every contract here: blank and the five ASCII controls.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Input bytes for which a shuffle gets a partition, where the session asks for fewer.
PART_BYTES = 256 << 20


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of a frame: the session's number, or more where the input is large.

    The size is the planner's estimate from the files that the frame reads; without one
    the session's number stands.
    """
    asked = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(asked, (planned_bytes(df) or 0) // PART_BYTES)


_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again.

    Lineage ends here, and a lost executor costs no recomputation of what came
    before.  Parquet rather than checkpoint() because it is compressed and the
    next reader can prune columns.  drop() and clear() delete what was written.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._cut_path = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.remove(path)


def drop(*frames: DataFrame) -> None:
    """Delete tables of cut() that nothing will read again."""
    for df in frames:
        if (path := getattr(df, "_cut_path", None)) in _written:
            _delete(df.sparkSession, path)


def written() -> int:
    """A mark for clear()."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, *keep: DataFrame) -> None:
    """Delete the tables that cut() has written since a mark, but for those to keep.

    Results that are still lazy must not need them.
    """
    kept = {getattr(df, "_cut_path", None) for df in keep}
    for path in _written[since:]:
        if path not in kept:
            _delete(spark, path)


def bounded_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """Mark a frame for broadcast if it has at most `limit` rows, else leave it.

    The rows are counted first; beyond the limit the planner joins by shuffle, with
    adaptive skew splitting.
    """
    return F.broadcast(df) if df.count() <= limit else df


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's default of 10,000 rows in a batch sent to Python to 500.

    So many texts take tens of MB off the heap in every task, however long they are.
    A session that has set a number of its own keeps it.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "500")


def slices(batches, rows: int = 512):
    """Record batches of at most so many rows, so that what a task unpacks at once is bounded."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: Bytes of rows that a task gathers before it packs them.
PACK_BYTES = 8 << 20


def packs(batches, rows: int, size: int = PACK_BYTES):
    """Tables of so many rows at most, or of about so many bytes, gathered from smaller batches."""
    held, n, held_bytes = [], 0, 0
    for batch in slices(batches, min(rows, 64)):
        held.append(batch)
        n += batch.num_rows
        held_bytes += batch.nbytes
        if n + 64 > rows or held_bytes >= size:
            yield pa.Table.from_batches(held)
            held, n, held_bytes = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def arrow_schema(schema) -> pa.Schema:
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])


def crc_bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    name = f"__{stem}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def is_file(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path
