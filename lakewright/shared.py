"""What driver and executors share: a folder, tables in it, and the size of an input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes a core below which an input is dealt to all cores by rows, however its files are laid out.
SMALL_BYTES = 8 << 20
#: Bytes of a larger input that one task is to read.
TASK_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where all runs on one machine is one made."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lakewright-"))
        found = sc.getCheckpointDir()
    return found


def new_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again, so that what follows does not compute it again."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int | None:
    """The planner's estimate of a frame's size from the files it reads, None without one."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def rows_by_task(df: DataFrame) -> list[int]:
    """Rows that each task of a scan reads, tasks without any left out; no column is read for it."""
    held = df.select(F.spark_partition_id().alias("task")).groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    return [r.n for r in held.collect()]


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """An input dealt evenly to tasks of TASK_BYTES at most, to all cores at least.

    A small input is dealt by rows, a larger one by a key that is different in each row (by
    rows without one), unless its files are so laid out already.  Files say little of that by themselves: a
    row group goes to one task, however large it is.
    """
    cores, size = df.sparkSession.sparkContext.defaultParallelism, planned_bytes(df)
    if size is None:
        return df
    if size < cores * SMALL_BYTES:
        return df.repartition(cores)
    wanted, held = max(cores, -(-size // TASK_BYTES)), rows_by_task(df)
    return df if 2 * sum(held) >= max(held, default=0) * wanted else df.repartition(wanted, *[key] * bool(key))


def stamp(spark: SparkSession, path: str) -> str:
    """Changes when the files under a path do: their bytes, their number, the folder's time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.getContentSummary(at)
    return f"{held.getLength()}-{held.getFileCount()}-{fs.getFileStatus(at).getModificationTime()}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def broadcast_few(df: DataFrame, limit: int) -> DataFrame:
    """A frame marked for broadcast if it is counted to have at most `limit` rows, else left to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
